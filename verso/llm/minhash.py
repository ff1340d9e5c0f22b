"""MinHash near-duplicates with odd sketches.

Each text becomes a set of word shingles. MinHash samples of the set are cut
into bands, whose equality makes candidates, and folded into a parity bitmap
(the odd sketch): the population count of two bitmaps' XOR estimates a high
similarity precisely, so that most false candidates fall without touching their
sets. What is left is confirmed on the full sets.

Texts with equal sets are one node from the start. The nodes of a band bucket
are compared with one pivot each, first the one that shares most buckets, then
others; a pivot that has met all of its bucket leaves it, links join
components, and a bucket whose nodes are all in one component is done. Nodes
that are still apart after the rounds are joined by an exact prefix filter on
their rarest shingles. No bucket is expanded into its pairs, and none is cut
short. Only nodes whose sketches allow a link have their full sets shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.llm.common import even_join, flagged, likely, pieces, stored, table
from verso.llm.components import merge

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SKETCH_BITS, SKETCH_LONGS = 1024, 16
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    words = text.encode().translate(LOWER).split()  # of bytes: splits at the six ASCII blanks alone
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words are one shingle, none give the empty set."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = _mix(out ^ (h[k : len(h) - size + 1 + k] * _M[k % 5] + np.uint64(k)))
    return np.unique(out)


def _odd(bits: np.ndarray) -> np.ndarray:
    """The parity bitmap of bit numbers."""
    return np.packbits((np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


class Sampler:
    """MinHash values, band keys and odd sketches of a shingle set: of its samples, then of the set itself."""

    def __init__(self, bands: int, rows: int, seed: int = 5):
        self.bands, self.rows = bands, rows
        r = np.random.default_rng(seed)
        k = bands * rows
        self.mul = r.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = r.integers(0, 1 << 63, k, np.uint64)
        self.index = _mix(np.arange(1, k + 1, dtype=np.uint64))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(x), 1024):
            np.minimum(low, (self.mul[:, None] * x[None, at : at + 1024] + self.add[:, None]).min(1), out=low)
        keys = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            keys = _mix(keys ^ low[k :: self.rows])
        bits = (_mix(low ^ self.index) % np.uint64(SKETCH_BITS)).astype(np.int64)
        return keys.view(np.int64), np.concatenate([_odd(bits), _odd((x % np.uint64(SKETCH_BITS)).astype(np.int64))])


def _describe(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``docs`` (``doc_id, tie, text``) with ``n, node, bands, sketch`` for the text: node is the digest of the set, null if it is empty.

    Of equal sets that come one soon after the other only the first has bands and a sketch, so copies add few rows to their buckets.
    """
    sampler = Sampler(bands, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces(batches):
            if len(seen) > 1 << 14:
                seen.clear()
            n, nodes, keys, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                x = shingles(text, width)
                node = hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None
                k, s = sampler(x) if node and node not in seen else (None, None)
                seen.add(node)
                n.append(len(x))
                nodes.append(node)
                keys.append(k)
                sketches.append(s)
            longs = pa.list_(pa.int64())
            columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, longs), pa.array(sketches, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n", "node", "bands", "sketch"])

    return docs.mapInArrow(look, f"doc_id {kind}, tie long, n long, node binary, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, x``: the sets of the nodes in ``wanted`` (``node, first``), made from the first document of each."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [shingles(t, width) for t in batch.column(2).to_pylist()]
            nodes = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
            # of rows equal in doc_id and text one is enough; others of a batch would be repeated in the join
            first = sorted({(node, a, b): i for i, (node, a, b) in enumerate(zip(nodes, batch.column(0).to_pylist(), batch.column(1).to_pylist()))}.values())
            columns = [batch.column(0).take(first), batch.column(1).take(first), pa.array([nodes[i] for i in first], pa.binary()), pa.array([sets[i].view(np.int64) for i in first], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "node", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.xxhash64("doc_id", "tie")
    wanted = wanted.select("node", F.xxhash64("first.doc_id", "first.tie").alias("key"))
    made = likely(docs.withColumn("key", key), wanted, "key").drop("key").mapInArrow(look, f"doc_id {kind}, tie long, node binary, x array<long>")
    return made.select(key.alias("key"), "node", "x").join(wanted, ["key", "node"], "left_semi").dropDuplicates(["node"]).select("node", "x")


def sketch_distance(a: str, b: str, first: int = 0) -> Column:
    """Population count of the XOR of two sketch columns, of the sketch that begins at ``first``."""
    out = F.lit(0)
    for i in range(first, first + SKETCH_LONGS):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def most_distance(samples: int, percent: int, sigmas: float = 4.5) -> int:
    """The greatest sketch distance that a pair at the threshold has, but for ``sigmas`` standard deviations.

    At similarity J two samples of size k differ in about 2k(1-J) elements and
    their sketches of n bits in n(1-exp(-4k(1-J)/n))/2.
    """
    j = percent / 100
    low = j - sigmas * (j * (1 - j) / samples) ** 0.5
    mean = SKETCH_BITS * (1 - np.exp(-4 * samples * (1 - low) / SKETCH_BITS)) / 2
    return int(np.ceil(mean + 3 * mean**0.5))


def _can_link(a: str, b: str, na: str, nb: str, percent: int, most: int) -> Column:
    """Whether two sketches allow the similarity.

    Every bit of difference between sketches of whole sets is an element of
    difference at least, so that test loses nothing; sets too large for it to
    tell are left to the sketches of samples.
    """
    surely = sketch_distance(a, b, SKETCH_LONGS) * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & surely & (sketch_distance(a, b) <= most)


def _confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """Pairs (pivot, node), as links (a, b), whose sketches are near and whose full sets have the similarity.

    Only nodes of pairs that the sketches allow have their sets made.
    """
    side = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in ("pivot", "node")]
    near = even_join(pairs.join(side[1], "node"), side[0], "pivot", ("node",), counted=pairs)
    near = stored(near.filter(_can_link("s_pivot", "s_node", "n_pivot", "n_node", percent, most)).select("pivot", "node", "n_pivot", "n_node"), "near-pairs")
    ends = near.select("node").union(near.select("pivot")).distinct()
    sets = stored(_sets(docs, nodes.join(ends, "node").select("node", "first"), width), "near-sets")
    both = F.size(F.array_intersect("x_pivot", "x_node")).cast("long")
    full = near.join(sets.withColumnRenamed("x", "x_node"), "node")
    checked = even_join(full, sets.select(F.col("node").alias("pivot"), F.col("x").alias("x_pivot")), "pivot", ("node",), counted=near).withColumn("both", both)
    return checked.filter(100 * F.col("both") >= percent * (F.col("n_pivot") + F.col("n_node") - F.col("both"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _prefix_pairs(apart: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """All pairs (pivot, node) of different roots in ``node, root, x`` that can have the similarity.

    With shingles ordered from rare to frequent, the smaller of two similar
    sets has one of its first ``n - 2t/(1+t) n`` shingles among the first
    ``n - t n`` of the greater. Copies that were edited in different places
    begin with shingles of their own, which no other has, and pair with none.
    """
    row = apart.select("node", "root", F.size("x").alias("n"), F.explode("x").alias("e"))
    often = row.groupBy("e").agg(F.count("*").alias("df")).filter("df > 1")
    own = W.partitionBy("node")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "e"))
    row = row.join(often, "e").withColumn("place", place)
    probe = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    index = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent) - 1e-9) + 1
    row = stored(row.filter(F.col("place") <= probe).select("e", "node", "root", "n", (F.col("place") <= index).alias("short")), "near-prefixes")
    keys = row.select("e")
    row = row.join(nodes.select("node", "sketch"), "node")
    great = row.select("e", F.col("node").alias("p"), F.col("root").alias("rp"), F.col("n").alias("np"), F.col("sketch").alias("sp"))
    small = row.filter("short").select("e", F.col("node").alias("q"), F.col("root").alias("rq"), F.col("n").alias("nq"), F.col("sketch").alias("sq"))
    fits = (F.col("rp") != F.col("rq")) & ((F.col("nq") < F.col("np")) | ((F.col("nq") == F.col("np")) & (F.col("q") < F.col("p")))) & _can_link("sp", "sq", "np", "nq", percent, most)
    return even_join(great, small, "e", ("p",), counted=keys).filter(fits).select(F.col("p").alias("pivot"), F.col("q").alias("node")).distinct()


def components_of(docs: DataFrame, width: int, percent: int, bands: int, rows: int, pivot_rounds: int) -> DataFrame:
    """``doc_id, tie, n, component`` of documents ``doc_id, tie, text``, where ``component`` is the least
    struct of null flag, doc_id and tie that can be reached."""
    docs = docs.select("doc_id", "tie", F.coalesce("text", F.lit("")).alias("text"))
    known = stored(_describe(docs, width, bands, rows), "near-described")
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tie")
    reps = known.filter("node is not null").groupBy("node").agg(F.min(own).alias("first"), F.min("n").alias("n"))
    bucket = known.select("node", F.explode("bands").alias("bucket"))
    # small digests, of their own in each bucket, are enough to see that a bucket holds two nodes
    digest = F.hash("node", "bucket")
    ends = bucket.select("bucket", digest.alias("h")).groupBy("bucket").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = stored(ends.filter("low != high").select("bucket"), "near-shared")
    maybe = stored(likely(bucket, shared, "bucket").distinct(), "near-maybe")
    member = stored(even_join(maybe, shared, "bucket", ("node",), "left_semi"), "near-buckets")
    wanted = stored(member.select("node").distinct().join(reps, "node"), "near-wanted")
    label = wanted.select("node", F.col("node").alias("root"))
    sketches = likely(known.filter("sketch is not null").select("node", "sketch"), wanted, "node")
    nodes = stored(wanted.join(sketches.dropDuplicates(["node"]), "node"), "near-compared")
    most = most_distance(bands * rows, percent)

    # a text that others were copied from shares more buckets with them than they do among each other
    sizes = member.groupBy("bucket").agg(F.count("*").alias("size"))
    degree = even_join(member, sizes, "bucket", ("node",)).groupBy("node").agg(F.sum("size").alias("degree"))
    rooted = stored(member.join(degree, "node").select("bucket", "node", F.col("node").alias("root"), (-F.col("degree")).alias("rank")), "near-rooted")
    for turn in range(pivot_rounds):
        pivot = rooted.groupBy("bucket").agg(F.min(F.struct("rank", "node", "root")).alias("p")).select("bucket", F.col("p.node").alias("pivot"), F.col("p.root").alias("above"))
        met = stored(even_join(rooted, pivot, "bucket", ("node",)).filter("node != pivot"), "near-met")
        pairs = stored(met.filter("root != above").select("pivot", "node").distinct(), "near-asked")
        label = merge(label, stored(_confirmed(docs, pairs, nodes, width, percent, most), "near-links"))
        # a pivot has met all of its bucket: the others go on where they are of several components
        rest = stored(met.select("bucket", "node").join(label, "node"), "near-rest")
        apart = rest.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
        rooted = stored(even_join(rest, apart, "bucket", ("node",), "left_semi").withColumn("rank", F.xxhash64("node", F.lit(turn))), "near-open")
        if rooted.isEmpty():
            break
    if not rooted.isEmpty():
        apart = stored(rooted.select("node", "root").distinct(), "near-apart")
        apart = apart.join(_sets(docs, nodes.join(apart, "node", "left_semi").select("node", "first"), width), "node")
        pairs = stored(_prefix_pairs(apart, nodes, percent, most), "near-asked")
        label = merge(label, stored(_confirmed(docs, pairs, nodes, width, percent, most), "near-links"))
    joined = label.join(nodes.select("node", "first"), "node")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    joined = stored(even_join(joined, least, "root", ("node",), counted=label).select("node", "component"), "near-components")
    # texts with equal sets: the least of each node, then of its component
    named = reps.join(joined, "node", "left").select("node", F.coalesce("component", "first").alias("component"))
    out = even_join(known.filter("node is not null").select("doc_id", "tie", "n", "node"), named, "node", ("doc_id", "tie"), counted=known.filter("node is not null").select("node")).select("doc_id", "tie", "n", "component")
    return out.unionByName(known.filter("node is null").select("doc_id", "tie", "n", own.alias("component")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, pivot_rounds: int = 2) -> DataFrame:
    """One row a row of ``docs``: ``doc_id, n_shingles, component_id``.

    Texts are linked if 100 times the common shingles are at least ``percent``
    times all shingles of both; ``component_id`` is the smallest doc_id that
    can be reached, null only if all are null. A pair at the threshold shares
    no band with a chance of ``(1 - J**rows)**bands``: about 1e-7 by default.
    Null and empty texts have no shingles and are linked with nothing;
    repeated rows have equal sets and so one component; an empty table gives
    an empty result; texts are taken whole and other columns are ignored.
    """
    found = components_of(docs.select("doc_id", F.lit(0).cast("long").alias("tie"), "text"), width, percent, bands, rows, pivot_rounds)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 5, pivot_rounds: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest doc_id, of equal ids that of
    the smallest digest of the row. Of rows equal in all columns one stays, whatever their text.

    Texts are not shuffled but for those that may have to go: a bitmap of
    hashed keys leaves the others where they are. Null and empty texts stay;
    null ids come last; an empty table stays empty; all columns are kept.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    tie = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull(), *([F.to_json(F.struct(*others))] if others else []))
    # the row is one column from here on, so that its names meet none of those below
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", tie.alias("tie"))
    found = components_of(keyed.select("doc_id", "tie", "text"), width, percent, bands, rows, pivot_rounds)
    stays = F.col("doc_id").eqNullSafe(F.col("component.doc_id")) & (F.col("tie") == F.col("component.tie"))
    each = found.groupBy("doc_id", "tie").agg(F.min(stays).alias("stays"), F.count("*").alias("rows"))
    key = F.xxhash64("doc_id", "tie").alias("key")
    marked = stored(each.filter("not stays or rows > 1").select("doc_id", "tie", key, "stays"), "near-marked")
    all_rows = flagged(keyed.select("row", "doc_id", "tie", key), marked, "key", "asked")
    gone = marked.filter("not stays").select("key", F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie"))
    asked = all_rows.filter("asked").dropDuplicates(["key", "doc_id", "tie"])
    asked = asked.join(gone, (asked["key"] == gone["key"]) & asked["doc_id"].eqNullSafe(gone["gone_id"]) & (asked["tie"] == gone["gone_tie"]), "left_anti")
    return all_rows.filter("not asked").unionByName(asked).select("row.*")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document with its set size and component; null, empty, repeated and long texts as in ``near_duplicates``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, width=3, percent=85, bands=36, rows=6)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(w[i], w[i + 1], w[i + 2]) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
  UNION SELECT doc_id, hash(len(w), array_to_string(w, ' ')) FROM t WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(c.m, t.doc_id)) AS component_id, t.doc_id <= coalesce(c.m, t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
