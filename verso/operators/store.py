"""Chunks, their keyword index and the registry of documents in one folder, changed together.

A change writes new parts only: the chunks it adds, entries that end the ones
it replaces or removes, a segment of the index and the documents' records. One
version of the manifest names them all, so that chunks, index and registry are
always of the same state, and a writer that was overtaken tries again on the
newer one. Adding a document replaces what it had before: adding it twice is
adding it once. A batch that carries a number is taken once, however often it
comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.operators import registry
from verso.operators.chunking import chunk_pages
from verso.operators.index import NAMED, KeywordIndex
from verso.operators.manifest import alive
from verso.operators.models import embed

SCHEMA = (
    "chunk_id string, doc_id string, filename string, page_num int, chunk_index int, is_table boolean, text string, "
    "embedding array<float>, document_status string, document_type string, department string"
)
RECORD = "doc_id string, filename string, file_hash string, status string, chunk_count long, page_count long, error string"
REQUIRED = ("chunk_id", "doc_id", "text", "embedding")
DEFAULTS = {"filename": "", "page_num": 1, "chunk_index": 0, "is_table": False, "document_status": "chua_xac_dinh", "document_type": "", "department": ""}
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class ChunkStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        #: The keyword index of the chunks; it is searched, and changed by this store alone.
        self.index = KeywordIndex(spark, folder)
        self.manifest, self.segments = self.index.manifest, self.index.segments

    def version(self) -> int:
        """The number of the current version, 0 before the first."""
        return (self.manifest.versions() or [0])[-1]

    def _scan(self, state: dict, columns: list[str] = NAMES) -> DataFrame:
        rows = self.manifest.read([p["path"] for p in state.get("chunks", [])], f"{SCHEMA}, born long").select(*columns, "born")
        return alive(rows, self.segments.dead(state) if state.get("dead") else None)

    def scan(self, vectors: bool = False, version: int | None = None) -> DataFrame:
        """All chunks of a version, the current one if none is named; without their vectors unless asked for."""
        return self._scan(self.manifest.state(version), [c for c in NAMES if vectors or c != "embedding"]).drop("born")

    def documents(self, state: dict | None = None) -> DataFrame:
        """The last record of each document."""
        state = self.manifest.state() if state is None else state
        rows = self.manifest.read([p["path"] for p in state.get("documents", [])], f"{RECORD}, born long")
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c.split()[0] for c in RECORD.split(", ")][1:]), "born").alias("r"))
        return last.select("doc_id", "r.*")

    def change(self, added: DataFrame | None = None, ended: DataFrame | None = None, records: Callable[[DataFrame], DataFrame] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Publish a version with the chunks ``added``, without the documents ``ended`` (``doc_id``) and what the documents of
        ``added`` had; whether there is a new one. ``records`` makes the documents' records from the written chunks.

        ``batch`` names a source and the number of its batch: a number that is
        not greater than the last one taken from that source changes nothing.
        """

        def build(state: dict) -> dict | None:
            if batch and state.get("batches", {}).get(batch[0], -1) >= batch[1]:
                return None
            version, leaving = state["version"] + 1, [] if ended is None else [ended.select("doc_id")]
            state = {"chunks": [], "documents": [], "batches": {}, **state}
            fresh = None
            if added is not None:
                path = self.manifest.write(added.select(*NAMES).withColumn("born", F.lit(version).cast("long")), "chunks")
                fresh = self.manifest.read([path], f"{SCHEMA}, born long")
                n = fresh.count()
                state["chunks"] = [*state["chunks"], {"path": path, "n": n}] if n else state["chunks"]
                leaving.append(fresh.select("doc_id"))
            records_ = None if records is None else self.manifest.write(records(fresh).select(*[c.split()[0] for c in RECORD.split(", ")], F.lit(version).cast("long").alias("born")), "documents")
            if records_:
                state["documents"] = [*state["documents"], {"path": records_}]
                leaving.append(self.manifest.read([records_], f"{RECORD}, born long").select("doc_id"))
            gone = None
            if leaving and state["version"]:
                docs = leaving[0]
                for more in leaving[1:]:
                    docs = docs.unionByName(more)
                gone = self._scan({**state, "chunks": [p for p in state["chunks"] if fresh is None or p["path"] != path]}, ["chunk_id", "doc_id"]).join(docs.distinct(), "doc_id", "left_semi").select("chunk_id")
                gone = self.manifest.read([self.manifest.write(gone, "searches")], "chunk_id string")
                gone = None if gone.isEmpty() else gone
            state["types"] = state.get("types") or {"chunk_id": "string", "doc_id": "string", "filename": "string", "department": "string", "document_status": "string", "document_type": "string"}
            state = self._compacted(self.segments.changed(state, fresh, gone))
            if batch:
                state["batches"] = state["batches"] | {batch[0]: batch[1]}
            return state

        before = self.version()
        return self.manifest.change(build)["version"] != before

    def _compacted(self, state: dict) -> dict:
        """Join the last parts of chunks while the one before is no more than twice as large, and many parts of ended ids."""
        parts = state["chunks"]
        first = len(parts) - 1
        while first > 0 and parts[first - 1]["n"] <= 2 * sum(p["n"] for p in parts[first:]):
            first -= 1
        if 0 <= first < len(parts) - 1:
            path = self.manifest.write(self._scan({**state, "chunks": parts[first:]}), "chunks")
            n = self.manifest.read([path], f"{SCHEMA}, born long").count()
            state = {**state, "chunks": [*parts[:first], *([{"path": path, "n": n}] if n else [])]}
        if len(state["dead"]) > 8:
            one = self.segments.dead(state).groupBy("chunk_id").agg(F.max("died").alias("died"))
            state = {**state, "dead": [self.manifest.write(one, "dead")]}
        if len(state["documents"]) > 8:
            rows = self.manifest.read([p["path"] for p in state["documents"]], f"{RECORD}, born long")
            last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "born").alias("r")).select("doc_id", "r.*")
            state = {**state, "documents": [{"path": self.manifest.write(last, "documents")}]}
        return state

    def add(self, chunks: DataFrame) -> int:
        """Add chunks in place of what their documents had; columns that are not required get their defaults. Returns the version."""
        if missing := [c for c in REQUIRED if c not in chunks.columns]:
            raise ValueError(f"chunks lack {', '.join(missing)}")
        self.change(chunks.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in chunks.columns}))
        return self.version()

    def patch(self, changes: DataFrame) -> int:
        """Set the columns of ``changes`` (one row a ``doc_id``) that are not null; returns the number of chunks met. Only the
        chunks of these documents are written again, and indexed with their new values."""
        hit = self.scan(vectors=True).join(changes.select("doc_id"), "doc_id", "left_semi")
        met = hit.count()
        if met:
            self.change(registry.patch_metadata(hit.select(*NAMES), registry.check_patch(changes)))
        return met

    def delete(self, doc_ids: DataFrame) -> int:
        """Remove the chunks of documents, their postings and their records; returns the number of chunks."""
        met = self.scan().join(doc_ids.select("doc_id"), "doc_id", "left_semi").count()
        known = self.documents().join(doc_ids.select("doc_id"), "doc_id", "left_semi")
        if met:
            self.change(ended=doc_ids, records=lambda _: known.withColumns({"status": F.lit("deleted"), "chunk_count": F.lit(0).cast("long")}))
        return met

    def has(self, chunk_ids: DataFrame) -> DataFrame:
        return chunk_ids.join(self.scan().select("chunk_id"), "chunk_id", "left_semi")

    def held(self, hashes: DataFrame) -> DataFrame:
        """Those of ``file_hash`` that a document holds which has neither failed nor been deleted. Of few, the files are told
        all, and skip what cannot have them."""
        alive_ = self.documents().filter("status NOT IN ('failed', 'deleted')").select("file_hash")
        named = [r[0] for r in hashes.select("file_hash").distinct().limit(NAMED + 1).collect()]
        alive_ = alive_.filter(F.col("file_hash").isin(named)) if len(named) <= NAMED else alive_
        return hashes.select("file_hash").distinct().join(alive_, "file_hash", "left_semi")


def ingest(store: ChunkStore, pages: DataFrame, size: int = 1000, overlap: int = 200, least: int = 50, batch: tuple[str, int] | None = None) -> DataFrame:
    """Pages to stored chunks, postings and records, one version for all: ``doc_id, status, chunk_count, page_count, error`` of each document.

    A document whose pages could not be parsed, or that has no text, is
    ``failed`` with its message, has no chunks and does not stop the others.
    ``pages`` may carry a ``file_hash``. A ``batch`` that was taken before
    changes nothing.
    """
    good = pages.filter("error is null")
    # texts are not sorted for the join: a task holds the names of its documents, however long these are
    named = good.groupBy("doc_id").agg(F.max("filename").alias("filename")).hint("shuffle_hash")
    chunks = chunk_pages(good, size, overlap, least).join(named, "doc_id").withColumn("embedding", embed(F.col("text")))
    full = chunks.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in chunks.columns})
    hashed = F.max("file_hash") if "file_hash" in pages.columns else F.lit(None).cast("string")
    told = pages.groupBy("doc_id").agg(F.count_if(F.col("error").isNull()).alias("page_count"), F.max("error").alias("error"), F.max("filename").alias("filename"), hashed.alias("file_hash"))

    def records(written: DataFrame) -> DataFrame:
        out = told.join(written.groupBy("doc_id").agg(F.count("*").alias("chunk_count")), "doc_id", "left").na.fill(0, ["chunk_count"])
        why = F.when(F.col("error").isNull() & (F.col("chunk_count") == 0), "no text").otherwise(F.col("error"))
        return out.withColumn("error", why).withColumn("status", F.when(why.isNull(), "done").otherwise("failed"))

    store.change(full, records=records, batch=batch)
    return store.documents().join(told.select("doc_id"), "doc_id", "left_semi").select("doc_id", "status", "chunk_count", "page_count", "error")
