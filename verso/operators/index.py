"""A stored keyword index that grows by segments.

A segment is what one change has added: blocks of postings, a row for each
chunk with its place and metadata, and for each term and block the number of
chunks and a bound. Chunks that end are noted and leave the statistics by
numbers below zero, which are counted from their postings; nothing is read
again. Segments of about equal size are merged, so that there are few, and what
has ended goes then. All numbers of the corpus (chunks, lengths, chunks of a
term) add up over segments; only the mean over all terms that stands in for
negative weights is taken anew after a change, from those sums.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.operators import blocks
from verso.operators.lexical import EPSILON, asked_terms, top
from verso.operators.manifest import Manifest, alive
from verso.operators.registry import checksum_of, digest_sums, row_digest

METADATA = ("doc_id", "filename", "department", "document_status", "document_type")
#: Questions that are scored together, and terms up to which the reader of the files is told all that are asked for.
TOGETHER, NAMED = 256, 4096
#: Blocks up to which all are scored at once: asking for bounds first costs more than it saves.
FEW = 64
#: Blocks, and chunks of which blocks are made, that a Python step gets at once: it holds them whole.
BLOCKS, TEXTS = 4, 256
BOUNDS = "term string, block string, df long, bound double"


class Segments:
    """The index part of a manifest's state: ``segments``, ``n``, ``length``, ``mean`` (of all raw weights), ``types``, and ``dead`` beside it."""

    def __init__(self, manifest: Manifest):
        self.manifest, self.spark = manifest, manifest.spark

    def _schema(self, state: dict, what: str) -> str:
        kind, more = state["types"]["chunk_id"], "".join(f", {c} {t}" for c, t in state["types"].items() if c != "chunk_id")
        return {"rows": f"chunk_id {kind}, block string, place int, length int, born long{more}", "blocks": f"{blocks.POSTINGS}, chunk_ids array<{kind}>, departments array<string>", "dead": f"chunk_id {kind}, died long", "bounds": BOUNDS}[what]

    def table(self, state: dict, what: str, segments: list[dict] | None = None) -> DataFrame:
        parts = [s[what] for s in (state["segments"] if segments is None else segments)]
        if what == "bounds":
            parts += [m for s in (state["segments"] if segments is None else segments) for m in s["minus"]]
        return self.manifest.read(parts, self._schema(state, what))

    def dead(self, state: dict) -> DataFrame | None:
        return self.manifest.read(state["dead"], self._schema(state, "dead")) if state.get("dead") else None

    def rows(self, state: dict, segments: list[dict] | None = None) -> DataFrame:
        """All chunks that have not ended, with their places and metadata."""
        return alive(self.table(state, "rows", segments), self.dead(state))

    def _segment(self, state: dict, words: DataFrame, meta: DataFrame, n: int, sizes: DataFrame | None = None) -> dict:
        """Write a segment of ``words`` (or ``text``); ``meta`` has ``chunk_id, born`` and metadata."""
        made = self.manifest.write(blocks.build(words, uuid.uuid4().hex, n, sizes), "blocks", TEXTS)
        block = self.manifest.read([made], self._schema(state, "blocks"))
        placed = block.select("block", F.posexplode(F.arrays_zip("chunk_ids", "lengths")).alias("place", "c")).select(F.col("c.chunk_ids").alias("chunk_id"), "block", "place", F.col("c.lengths").alias("length"))
        rows = self.manifest.write(placed.join(meta, "chunk_id"), "rows")
        size = block.agg(F.sum(F.size("chunk_ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).head()
        mean = max(1.0, (size[1] or 0) / max(1, size[0] or 0))
        told = self.manifest.write(blocks.bounds(block, mean), "bounds", BLOCKS)  # in the order of the blocks: a search reads them all, and no row is shuffled
        return {"blocks": made, "rows": rows, "bounds": told, "minus": [], "n": size[0] or 0, "length": size[1] or 0, "at": mean}

    def changed(self, state: dict, added: DataFrame | None, removed: DataFrame | None) -> dict:
        """The state after ending the chunks ``removed`` (``chunk_id``) and adding ``added`` (``chunk_id``, ``text``, metadata), which
        become part of the version after it. A chunk that is removed and added again is replaced."""
        state = {"segments": [], "dead": [], "n": 0, "length": 0, **state}
        version = state["version"] + 1
        if added is not None and "types" not in state:
            state["types"] = {c: added.schema[c].dataType.simpleString() for c in ("chunk_id", *(m for m in METADATA if m in added.columns))}
        if removed is not None and state["segments"]:
            segments, ends = [], removed.select("chunk_id").distinct()
            for s in state["segments"]:
                gone = self.rows(state, [s]).join(ends, "chunk_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("gone"), F.sum("length").alias("length"))
                less = gone.agg(F.sum(F.size("gone")), F.sum("length")).head()
                if less[0]:
                    minus = blocks.lost(self.table(state, "blocks", [s]).join(gone.select("block", "gone"), "block"))
                    minus = self.manifest.write(minus.select("term", F.lit(None).cast("string").alias("block"), "df", F.lit(0.0).alias("bound")), "bounds", BLOCKS)
                    s = s | {"minus": [*s["minus"], minus], "n": s["n"] - less[0], "length": s["length"] - less[1]}
                segments.append(s)
            state |= {"segments": segments, "dead": [*state["dead"], self.manifest.write(ends.withColumn("died", F.lit(version).cast("long")), "dead")]}
        if added is not None and (n := added.count()):
            department = F.coalesce("department", F.lit("")) if "department" in added.columns else F.lit("")
            words = added.select("chunk_id", department.alias("department"), "text")
            kept = [c for c in state["types"] if c != "chunk_id"]
            state["segments"] = [*state["segments"], self._segment(state, words, added.select("chunk_id", F.lit(version).cast("long").alias("born"), *kept), n)]
        state = self._merged({**state, "segments": [s for s in state["segments"] if s["n"]]})
        state |= {"n": sum(s["n"] for s in state["segments"]), "length": sum(s["length"] for s in state["segments"])}
        state["mean"] = self.terms(state).agg(F.avg("raw")).head()[0] or 0.0 if state["segments"] else 0.0
        return state

    def _merged(self, state: dict) -> dict:
        """Merge the last segments while the one before is no more than twice as large."""
        segments = state["segments"]
        first = len(segments) - 1
        while first > 0 and segments[first - 1]["n"] <= 2 * sum(s["n"] for s in segments[first:]):
            first -= 1
        if first >= len(segments) - 1:
            return state
        old = segments[first:]
        here = self.rows(state, old)
        words = blocks.words_of(self.table(state, "blocks", old)).join(here.select("chunk_id", "block"), ["chunk_id", "block"], "left_semi").drop("block")
        new = self._segment(state, words, here.drop("block", "place", "length"), sum(s["n"] for s in old), here.select(F.col("length").alias("size")))
        ended = state["dead"] if first or "chunks" in state else []  # nothing is left that could have ended
        return {**state, "segments": [*segments[:first], new], "dead": ended}

    def terms(self, state: dict) -> DataFrame:
        """``term, df, raw`` of the corpus."""
        df = self.table(state, "bounds").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        return df.withColumn("raw", F.log(F.lit(state["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))

    def scores(self, state: dict, questions: DataFrame, k: int | None = None, keep: Column | None = None) -> DataFrame:
        """``query_id, chunk_id, bm25_score`` of each question's best ``k`` chunks and perhaps others; of all that share a term with it without ``k``.

        Questions are scored in packs, each against whole blocks. With ``k`` and
        more than a few blocks, the one whose bounds promise most is scored
        first; its ``k``-th best is a score that other blocks have to reach by
        their bounds to be read.
        """
        out = questions.select("query_id").withColumn("chunk_id", F.lit(None).cast(state.get("types", {"chunk_id": "string"})["chunk_id"])).withColumn("bm25_score", F.lit(0.0)).filter("false")
        n = questions.count()
        if not state.get("segments") or not n:
            return out
        asked = asked_terms(questions)
        named = [r[0] for r in asked.select("term").distinct().limit(NAMED + 1).collect()]
        told = self.table(state, "bounds")
        told = told.filter(F.col("term").isin(named)) if len(named) <= NAMED else told.join(asked.select("term").distinct(), "term", "left_semi")
        df = told.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
        raw = F.log(F.lit(state["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        weighed = asked.join(df, "term").withColumn("w", F.col("qn") * F.when(raw < 0, EPSILON * state["mean"]).otherwise(raw))
        users = [c for c in ("user_department", "is_admin") if c in questions.columns and "user_department" in questions.columns]
        each = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("tw"))
        if users:
            each = each.join(questions.select("query_id", *users), "query_id")
        pack = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // TOGETHER))).cast("int")
        question = F.struct("query_id", F.col("tw")["term"].alias("terms"), F.col("tw")["w"].alias("weights"), *users)
        packs = each.groupBy(pack.alias("pack")).agg(F.collect_list(question).alias("questions"))
        mean = state["length"] / max(1, state["n"])
        if k is None or state["n"] <= FEW * blocks.CHUNKS:
            every = F.when(F.size("questions") > 0, F.sequence(F.lit(0), F.size("questions") - 1))
            found = self._scored(state, self.table(state, "blocks").crossJoin(packs.withColumn("wanted", every)), mean, k, keep)  # the asked set, in packs
            return found if k is None else self._kept(found, BLOCKS)
        packs = self._kept(packs)
        numbered = packs.select("pack", F.posexplode("questions").alias("pos", "q")).select("pack", "pos", F.col("q.query_id").alias("query_id"), F.explode(F.arrays_zip(F.col("q.terms").alias("term"), F.col("q.weights").alias("w"))).alias("t"))

        slack = max(1.0, mean / min(s["at"] for s in state["segments"]))
        reach = numbered.join(told.filter("block IS NOT NULL").select(F.col("term").alias("asked"), "block", "bound"), F.col("t.term") == F.col("asked"))
        reach = reach.groupBy("pack", "pos", "query_id", "block").agg(F.sum(F.greatest(F.col("t.w") * F.col("bound") * slack, F.lit(0.0))).alias("reach"))
        reach = self._kept(reach.join(reach.groupBy("pack", "pos").agg(F.max_by("block", F.struct("reach", "block")).alias("best")), ["pack", "pos"]))

        def work(open_: DataFrame) -> DataFrame:
            wanted = open_.groupBy("pack", "block").agg(F.collect_list("pos").alias("wanted"))
            return self.table(state, "blocks").join(wanted, "block").join(packs, "pack")

        first = self._kept(self._scored(state, work(reach.filter("block = best")), mean, k, keep), BLOCKS)
        limit = top(first, k).filter(F.col("bm25_rank") == k).select("query_id", F.col("bm25_score").alias("limit"))
        open_ = reach.filter("block != best").join(limit, "query_id", "left").filter("limit IS NULL OR reach >= limit - 2e-6")
        return first.unionByName(self._kept(self._scored(state, work(open_), mean, k, keep), BLOCKS))

    def _kept(self, rows: DataFrame, at_once: int = 1024) -> DataFrame:
        """Rows that several steps read or that come of whole blocks, written once beside the tables."""
        return self.manifest.read([self.manifest.write(rows, "searches", at_once)], rows.schema)

    def _scored(self, state: dict, work: DataFrame, mean: float, k: int | None, keep: Column | None) -> DataFrame:
        none = F.lit(None).cast("array<int>")
        work = work.withColumn("kept", none) if keep is None else work.join(self.table(state, "rows").filter(keep).groupBy("block").agg(F.collect_list("place").alias("kept")), "block")
        if (dead := self.dead(state)) is None:
            work = work.withColumn("gone", none)
        else:
            rows = self.table(state, "rows")
            ended = rows.join(dead.groupBy("chunk_id").agg(F.max("died").alias("died")), "chunk_id").filter("died > born")
            work = work.join(ended.groupBy("block").agg(F.collect_list("place").alias("gone")), "block", "left")
        found = blocks.score(work, mean, k)
        return found.select("query_id", "chunk_id", F.round("score", 6).alias("bm25_score"))


class KeywordIndex:
    """BM25 over the chunks that were current at the last ``refresh``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.manifest = spark, Manifest(spark, folder)
        self.segments = Segments(self.manifest)

    def current(self) -> dict | None:
        """The last version; None before the first."""
        state = self.manifest.state()
        return state if state["version"] else None

    def _state(self) -> dict:
        if (state := self.current()) is None:
            raise RuntimeError("the index has no version: call refresh first")
        return state

    def checksum(self) -> str:
        """The checksum of the indexed corpus, from the sums of its files: no chunk is read."""
        return checksum_of(f["sums"] for f in self._state()["files"].values())

    def _listed(self, paths: list[str]) -> dict[str, list[int]]:
        """Length and time of change of files, asked for by their folders."""
        jvm, out = self.spark._jvm, {}
        paths = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        for folder in {str(p.getParent()): p.getParent() for p in paths}.values():
            for s in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder):
                out[s.getPath().toUri().getPath()] = [s.getLen(), s.getModificationTime()]
        return {str(p): out[p.toUri().getPath()] for p in paths}

    def refresh(self, chunks: DataFrame) -> bool:
        """Index what has changed and publish a version; whether anything has.

        With a column ``file`` (the ``_metadata.file_path`` of each chunk) files
        are told apart by name, length and time: where none has changed nothing
        is read, else only those that have, and of them only chunks that are
        new or different are indexed. Without it all chunks are read and
        compared. Chunks have one row for each ``chunk_id``.
        """
        by_file = "file" in chunks.columns
        chunks = chunks if by_file else chunks.withColumn("file", F.lit(""))
        listed = self._listed(chunks.inputFiles()) if by_file else None

        def build(state: dict) -> dict | None:
            files = state.get("files", {})
            if by_file and {p: f["is"] for p, f in files.items()} == listed:
                return None
            fresh = [p for p, told in listed.items() if files.get(p, {}).get("is") != told] if by_file else [""]
            source = chunks.filter(F.col("file").isin(fresh)) if files or not by_file else chunks
            other = F.xxhash64(*[c for c in METADATA if c in chunks.columns]) if any(c in chunks.columns for c in METADATA) else F.lit(0).cast("long")
            kind = chunks.schema["chunk_id"].dataType.simpleString()
            schema = f"chunk_id {kind}, digest string, other long, file string"
            ledger = self.manifest.write(source.select("chunk_id", row_digest().alias("digest"), other.alias("other"), "file"), "ledger")
            now = self.manifest.read([ledger], schema)
            gone = sorted(set(files) - set(listed)) + [p for p in fresh if p in files] if by_file else [""]
            was = self.manifest.read(sorted({files[p]["ledger"] for p in gone if p in files}), schema).filter(F.col("file").isin(gone))
            if files:
                same = ["chunk_id", "digest", "other"]
                added, removed = now.join(was, same, "left_anti"), was.join(now, same, "left_anti")
                if not by_file and added.isEmpty() and removed.isEmpty():
                    return None
                after = self.segments.changed(state, source.drop("file").join(added.select("chunk_id"), "chunk_id", "left_semi"), removed)
            else:
                after = self.segments.changed(state, source.drop("file"), None)
            sums = {r["file"]: list(r)[1:] for r in now.groupBy("file").agg(*digest_sums(F.col("digest"))).collect()}
            kept = {p: f for p, f in files.items() if p not in gone}
            return after | {"files": kept | {p: {"is": listed[p] if by_file else None, "ledger": ledger, "sums": sums.get(p, [0] * 9)} for p in fresh}}

        before = self.manifest.state()["version"]
        return self.manifest.change(build)["version"] != before

    def terms(self) -> DataFrame:
        """``term, df, idf`` of the corpus."""
        state = self._state()
        return self.segments.terms(state).select("term", "df", F.when(F.col("raw") < 0, EPSILON * state["mean"]).otherwise(F.col("raw")).alias("idf"))

    def scores(self, questions: DataFrame, keep: Column | None = None) -> DataFrame:
        """``query_id, chunk_id, bm25_score`` of all chunks that share a term with a question.

        Questions that carry ``user_department`` and ``is_admin`` score only what their user may read.
        """
        return self.segments.scores(self._state(), questions, None, keep)

    def search(self, questions: DataFrame, k: int = 20, keep: Column | None = None) -> DataFrame:
        """The best ``k`` chunks of each question, of equal scores those with the smallest ids; with their ranks."""
        return top(self.segments.scores(self._state(), questions, k, keep), k)
