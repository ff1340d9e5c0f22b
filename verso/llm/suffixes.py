"""Exact substring removal with a logarithmic family of sparse suffix arrays.

A suffix array of a batch holds the suffixes that start at anchors: the
smallest 64-byte fingerprints of sliding windows of the match length. Equal
windows have the same anchor at the same place, so anchors that differ never
hide a match, and there is one for about 60 bytes. An entry stands for the run
of windows of its anchor. Entries are ordered by the fingerprint of their
64-byte prefix, then of their whole context (all bytes that the run covers).

A new batch is sorted, scanned against itself and merge-scanned against each
existing level, and becomes a level; levels of equal size merge into one of
twice the size. Levels are tables bucketed and sorted by prefix, so that scans
and merges need no shuffle.

Equal contexts are matches as they stand. Where the same prefix has several
contexts, only some of their windows can match: the distinct contexts are
fetched from the texts, and their windows are compared. Fingerprints have 64
bits, and a match takes two that agree.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.llm.common import discard, shared_dir, stored, table, with_few

PREFIX = 64
CHUNK = 1 << 20
#: Contexts that are fingerprinted at once, if no larger group has to be.
SLICE = 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_BYTES = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64((1 << 24) - 1)
_TOP = np.uint64((1 << 64) - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of a concatenation from those of its parts."""
    x = ((a * _A) ^ (b + (a >> np.uint64(31)))) * _B
    return x ^ (x >> np.uint64(32))


def _powers(data: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Fingerprints of all substrings whose length is a power of two up to ``most``."""
    out, size = {1: _BYTES[data]}, 1
    while size * 2 <= most and len(out[size]) > size:
        h = out[size]
        out[size * 2] = _pair(h[: len(h) - size], h[size:])
        size *= 2
    return out


def window_prints(data: np.ndarray, length: int, powers: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Fingerprints of all substrings of ``length`` bytes."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = powers or _powers(data, length)
    out, at = None, 0
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            h = powers[1 << bit][at : at + n]
            out = h if out is None else _pair(out, h)
            at += 1 << bit
    return out


def _anchors(prints: np.ndarray, width: int) -> np.ndarray:
    """The place of the least fingerprint, the leftmost of equals, in each run of ``width``."""
    n = len(prints)
    key = (prints & ~_LOW) | np.arange(n, dtype=np.uint64)
    rows = np.full(-(-n // width) * width, _TOP)
    rows[:n] = key
    rows = rows.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(right[:m], left[width - 1 : width - 1 + m]) & _LOW).astype(np.int64)


def entries(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``prefix, context, first, last``: the anchors of a text with the first and last window of each."""
    parts = []
    for base in range(0, len(data) - length + 1, CHUNK):
        piece = data[base : base + CHUNK + length - 1]
        powers = _powers(piece, length)
        w = window_prints(piece, length, powers)
        at = _anchors(powers[PREFIX], length - PREFIX + 1)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(at)]]) - 1
        anchor = at[first]
        context = _pair(_pair(w[first], w[last]), ((last - first) * 1000 + (anchor - first)).astype(np.uint64) * _A)
        parts.append((powers[PREFIX][anchor], context, first + base, last + base))
    if not parts:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def folded(code: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct codes of a text: where each stands first, and its other places (null if there are none)."""
    _, at, back, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    more = np.full(len(at), None, object)
    if len(at) < len(code):
        order, end = np.argsort(back, kind="stable"), np.cumsum(count)
        for u in np.flatnonzero(count > 1):
            more[u] = place[order[end[u] - count[u] + 1 : end[u]]].astype(np.int32)
    return at, more


def suffix_array(docs: DataFrame, length: int) -> DataFrame:
    """Entries ``key, ctx, doc, first, last, more`` of texts ``doc, text``.

    A context that a text repeats is one entry, with the other places where
    it begins in ``more``; a text of a thousand equal lines makes few entries.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, docs_, held = [], [], 0

            def out() -> pd.DataFrame:
                key, ctx, first, last, more = (np.concatenate(x) for x in zip(*found))
                many = [len(f[0]) for f in found]
                return pd.DataFrame({"key": key.view(np.int64), "ctx": ctx.view(np.int64), "doc": np.repeat(np.array(docs_, np.int64), many), "first": first, "last": last, "more": more})

            for doc, text in zip(batch["doc"], batch["text"]):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) >= length:
                    key, ctx, first, last = entries(data, length)
                    at, more = folded(_pair(key, ctx), first)
                    found.append((key[at], ctx[at], first[at], last[at], more))
                    docs_.append(doc)
                    held += len(found[-1][0])
                    if held > 200_000:
                        yield out()
                        found, docs_, held = [], [], 0
            if found:
                yield out()

    return docs.mapInPandas(look, "key long, ctx long, doc long, first int, last int, more array<int>")


class SuffixIndex:
    """The family of levels; ``levels`` holds (batches, table, folder), the oldest and largest first."""

    def __init__(self, spark: SparkSession, length: int):
        if length < 2 * PREFIX:
            raise ValueError(f"matches must have {2 * PREFIX} bytes at least")
        self.spark, self.length = spark, length
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []
        self.equal: list[DataFrame] = []
        self.mixed: list[DataFrame] = []

    def _save(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"suffixes_{uuid.uuid4().hex}", shared_dir(self.spark, "suffixes")
        rows.write.bucketBy(self.buckets, "key").sortBy("key", "ctx").option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, path)

    def add(self, docs: DataFrame) -> None:
        """Index a batch of texts ``doc, text`` and note what it matches in itself and in the levels."""
        name, path = self._save(suffix_array(docs, self.length).repartition(self.buckets, "key"))
        new = self.spark.table(name).groupBy("key", "ctx").agg(F.sum(1 + F.coalesce(F.size("more"), F.lit(0))).alias("n"))
        equal = [new.filter("n > 1").select("key", "ctx")]
        mixed = [new.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")]
        mine = new.select("key", "ctx")
        for _, level, _ in self.levels:
            old = self.spark.table(level).select("key", "ctx")
            equal.append(mine.join(old, ["key", "ctx"], "left_semi"))
            other = old.select(F.col("key").alias("k"), F.col("ctx").alias("c"))
            mixed.append(mine.join(other, (F.col("key") == F.col("k")) & (F.col("ctx") != F.col("c")), "left_semi").select("key"))
        self.equal += [stored(x, "suffix-equal") for x in equal]
        self.mixed += [stored(x, "suffix-mixed") for x in mixed]
        self.levels.append((1, name, path))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            a, b = self.levels[-2:]
            merged = self._save(self.spark.table(a[1]).unionByName(self.spark.table(b[1])))
            self.levels[-2:] = [(a[0] + b[0], *merged)]
            self._drop(*a[1:])
            self._drop(*b[1:])

    def matches(self) -> tuple[DataFrame, DataFrame]:
        """``doc, start, end`` of the runs whose whole context stands elsewhere, and ``key, ctx, doc, first, last``
        of one entry for each context of the prefixes that have several."""

        def every(parts: list[DataFrame], *keys: str) -> DataFrame:
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return stored(out.distinct().repartition(self.buckets, "key").select(*keys), "suffix-matches")

        equal, mixed = every(self.equal, "key", "ctx"), every(self.mixed, "key")
        whole, some = None, None
        for _, level, _ in self.levels:
            rows = self.spark.table(level)
            a = rows.join(equal, ["key", "ctx"], "left_semi")
            a = a.select("doc", (F.col("last") - F.col("first") + self.length).alias("size"), F.explode(F.concat(F.array("first"), F.coalesce("more", F.array().cast("array<int>")))).alias("start"))
            a = a.select("doc", "start", (F.col("start") + F.col("size")).alias("end"))
            b = rows.join(mixed, "key", "left_semi").groupBy("key", "ctx").agg(F.min(F.struct("doc", "first", "last")).alias("r"))
            whole = a if whole is None else whole.unionByName(a)
            some = b if some is None else some.unionByName(b)
        some = some.groupBy("key", "ctx").agg(F.min("r").alias("r")).select("key", "ctx", "r.*")
        return stored(whole, "suffix-whole"), stored(some, "suffix-some")

    def close(self) -> None:
        for _, name, path in self.levels:
            self._drop(name, path)
        self.levels = []


def _contexts(docs: DataFrame, some: DataFrame, length: int) -> DataFrame:
    """``key, doc, first, bytes``: the contexts of entries, cut from their texts ``doc, text``."""
    wanted = some.groupBy("doc").agg(F.collect_list(F.struct("key", "first", "last")).alias("places"))
    held = docs.join(wanted, "doc")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, places in zip(batch["doc"], batch["text"], batch["places"]):
                data = text.encode()
                rows += [(p["key"], doc, p["first"], data[p["first"] : p["last"] + length]) for p in places]
            yield pd.DataFrame(rows, columns=["key", "doc", "first", "bytes"])

    return held.mapInPandas(cut, "key long, doc long, first int, bytes binary")


def _windows_of(rows: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of contexts: the fingerprint with the prefix, the row, and the place in the text."""
    data = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    size = np.fromiter(map(len, rows["bytes"]), np.int64, len(rows))
    many = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(rows)), many)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = (np.cumsum(size) - size)[row]
    prints = _pair(window_prints(data, length)[begin + inside], rows["key"].to_numpy(np.int64).view(np.uint64)[row])
    return prints, row, rows["first"].to_numpy(np.int64)[row] + inside


def _runs(doc: np.ndarray, place: np.ndarray, length: int) -> pd.DataFrame:
    """``doc, start, end`` of runs of consecutive places."""
    cut = np.flatnonzero((np.diff(place) != 1) | (doc[1:] != doc[:-1])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
    return pd.DataFrame({"doc": doc[first], "start": place[first], "end": place[last] + length})


def _partial(contexts: DataFrame, many: DataFrame, length: int, whole_groups: int) -> DataFrame:
    """``doc, start, end`` of windows of contexts that stand in another context of the same prefix, or twice in one.

    Contexts come sorted by prefix and are compared in whole groups. Prefixes
    with more than ``whole_groups`` contexts (``many``) have their windows
    counted by fingerprint instead, so that no task holds such a group: one of
    fewer takes at most some 100 MB, as a context has less than 400 bytes.
    """
    schema = "doc long, start int, end int"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame({"key": [], "doc": [], "first": [], "bytes": []}).astype({"key": "int64", "doc": "int64", "first": "int64"})

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            prints, row, place = _windows_of(rows, length)
            _, back, count = np.unique(prints, return_inverse=True, return_counts=True)
            twice = count[back] > 1
            return _runs(rows["doc"].to_numpy(np.int64)[row[twice]], place[twice], length) if twice.any() else pd.DataFrame({"doc": [], "start": [], "end": []}).astype("int64")

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                held = pd.concat([held, batch.iloc[at : at + SLICE]], ignore_index=True)
                ready = held["key"] != held["key"].iloc[-1]
                if ready.any():
                    yield done(held[ready])
                    held = held[~ready].reset_index(drop=True)
        if len(held):
            yield done(held)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                prints, row, place = _windows_of(part, length)
                yield pd.DataFrame({"print": prints.view(np.int64), "doc": part["doc"].to_numpy(np.int64)[row], "start": place})

    few = contexts.join(many, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInPandas(compare, schema)
    window = contexts.join(many, "key", "left_semi").mapInPandas(spread, "print long, doc long, start int")
    again = window.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    return few.unionByName(window.join(again, "print", "left_semi").select("doc", "start", (F.col("start") + length).alias("end")))


def remove_repeats(docs: DataFrame, length: int = 200, batches: int = 3, whole_groups: int = 4096) -> DataFrame:
    """Every row of ``docs`` with ``doc_id, n_bytes, n_removed, n_spans, kept`` (kept: the remaining bytes).

    A byte goes if it is in a string of ``length`` bytes that also starts
    anywhere else, in the same text or another; this is judged on the input.
    Of texts that are equal as a whole only the first is indexed: if long
    enough, all of their bytes go. Null and empty texts have no bytes; texts
    are indexed whole, very long ones piece by piece; repeated rows are copies
    of each other; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    row = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("doc"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    copies = row.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").drop("n")
    copies = stored(copies, "suffix-copies")
    marked = with_few(row, copies, "digest", ("doc_id",))
    # one text of each group of copies is indexed, and gives contexts to others
    base = marked.filter("first_id is null or (doc_id <=> first_id)").select("doc", "text")
    index = SuffixIndex(spark, length)
    for i in range(batches):
        index.add(base.filter(F.pmod("doc", F.lit(batches)) == i))
    whole, some = index.matches()
    index.close()
    many = stored(some.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > whole_groups).select("key"), "suffix-many")
    partial = _partial(_contexts(base, some, length), many, length, whole_groups)
    ranges = whole.unionByName(partial).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = value.encode()
                kept, at, removed, spans = [], 0, 0, 0
                end = -1
                for begin, stop in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if begin > end:
                        spans += 1
                        kept.append(data[at:begin])
                        removed += stop - begin
                        at = end = stop
                    elif stop > end:
                        removed += stop - end
                        at = end = stop
                kept.append(data[at:])
                out.append((len(data), removed, spans, b"".join(kept)))
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    alone = (F.col("first_id").isNull()) & (F.col("n_bytes") >= length)
    cut_rows = marked.filter(alone).select("doc", "doc_id", "text").join(ranges, "doc", "left").select("doc_id", "text", "ranges").mapInArrow(cut, schema)
    gone = (F.col("first_id").isNotNull()) & (F.col("n_bytes") >= length)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rest = marked.filter(~alone).select("doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.when(gone, one).otherwise(zero).alias("n_spans"), F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"))
    return cut_rows.unionByName(rest)


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    """What is left of every document; null, empty, repeated and long texts and empty tables as in ``remove_repeats``."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], length: int = 200) -> list[tuple[int, int, int, int, str]]:
    """The same by a dictionary of all windows, for small tables."""
    seen: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in texts]
    for _, d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] = seen.get(d[p : p + length], 0) + 1
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(d)))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
