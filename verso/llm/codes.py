"""Product codes of vectors: Lloyd's rounds by filtering over kd-trees.

A vector's components become integers and are cut into equal parts, each with a
codebook of its own. Every partition cuts its vectors into blocks and builds a
balanced kd-tree over each block's parts of one position: a node keeps its box
and the sum and count of its points. The trees are written once and serve all
rounds. A round walks them level by level with the entries that may still be
nearest to some point of a node: an entry goes where even the corner of the box
that favours it most is nearer to another one. A node with one entry left is
assigned whole, by its sum and count; only in the leaves are points looked at.
All of this is integer arithmetic, so that results are exact, ties included,
and do not depend on how rows lie in partitions.

What comes to the driver is the first entries and, each round, a sum and a count
for each component of each entry, however many vectors there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.llm.common import even_join, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a block, and points of a leaf.
BLOCK, LEAF = 1 << 19, 8
FAR = np.iinfo(np.int64).max


def usable(vector: str) -> Column:
    """Vectors that are there and have no null and no infinite component or NaN."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def whole(values: np.ndarray, width: int) -> np.ndarray:
    """Components as integers, within what keeps all sums of squares in 64 bits."""
    most = math.isqrt((1 << 62) // max(1, PARTS * width)) // 2
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """A row of integers for each vector, zeros after its last component."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), PARTS * width), np.int64)
    rows = np.repeat(np.arange(len(vectors)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole(vectors.flatten().to_numpy(zero_copy_only=False), width)
    return out


def spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after the other."""
    lengths = ends - starts
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class Tree:
    """A balanced kd-tree: node ``i`` of a level has the nodes ``2 i`` and ``2 i + 1`` of the next as children.

    The points of node ``i`` are those from ``bounds[i]`` to ``bounds[i + 1]``
    in the tree's order, so that the number of points tells the shape.
    """

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray):
        self.order, self.points, self.low, self.high, self.total = order, points, low, high, total
        self.depth = self.depth_of(len(points))

    @staticmethod
    def depth_of(n: int) -> int:
        return max(0, (n // LEAF).bit_length() - 1)

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * n) >> level

    @classmethod
    def grown(cls, points: np.ndarray) -> Tree:
        n, order = len(points), np.arange(len(points))
        for level in range(cls.depth_of(n)):
            at, bounds = points[order], cls.bounds(n, level)
            widest = (np.maximum.reduceat(at, bounds[:-1]) - np.minimum.reduceat(at, bounds[:-1])).argmax(1)
            node = np.repeat(np.arange(1 << level), np.diff(bounds))
            order = order[np.lexsort((at[np.arange(n), widest[node]], node))]
        at, starts = points[order], [cls.bounds(n, level)[:-1] for level in range(cls.depth_of(n) + 1)]
        low, high, total = (np.concatenate([f.reduceat(at, s) for s in starts]) for f in (np.minimum, np.maximum, np.add))
        return cls(order, at, low, high, total)

    def packed(self) -> bytes:
        narrow = (self.order, self.points, self.low, self.high)
        return b"".join([self.total.astype("<i8").tobytes(), *(x.astype("<i4").tobytes() for x in narrow)])

    @classmethod
    def unpacked(cls, n: int, width: int, data: bytes) -> Tree:
        nodes, at, out = (2 << cls.depth_of(n)) - 1, 0, []
        for kind, rows, columns in (("<i8", nodes, width), ("<i4", n, 1), ("<i4", n, width), ("<i4", nodes, width), ("<i4", nodes, width)):
            x = np.frombuffer(data, kind, rows * columns, at)
            at += x.nbytes
            out.append(x.astype(np.int64).reshape(rows, columns))
        total, order, points, low, high = out
        return cls(order[:, 0], points, low, high, total)

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each point in the tree's order, the lowest of equally near ones, and the entries' counts and sums."""
        n, k = len(self.points), len(book)
        found, counts, sums = np.empty(n, np.int64), np.zeros(k, np.int64), np.zeros_like(book)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(self.depth + 1):
            base, bounds = (1 << level) - 1, self.bounds(n, level)
            low, high = self.low[base + nodes], self.high[base + nodes]
            from_middle = ((2 * book - (low + high)[:, None]) ** 2).sum(2)
            best = np.where(open_, from_middle, FAR).argmin(1)
            rival = book[best][:, None]
            corner = np.where(book > rival, high[:, None], low[:, None])
            behind = ((book - rival) * (book + rival - 2 * corner)).sum(2)  # how much farther than the rival, at the best corner
            open_ &= (behind < 0) | ((behind == 0) & (np.arange(k) < best[:, None]))
            open_[np.arange(len(nodes)), best] = True
            alone = open_.sum(1) == 1
            settled, entry = nodes[alone], best[alone]
            sizes = bounds[settled + 1] - bounds[settled]
            found[spread(bounds[settled], bounds[settled + 1])] = np.repeat(entry, sizes)
            np.add.at(counts, entry, sizes)
            np.add.at(sums, entry, self.total[base + settled])
            nodes, open_ = nodes[~alone], open_[~alone]
            if not len(nodes):
                return found, counts, sums
            if level < self.depth:
                nodes, open_ = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(open_, 2, 0)
        at = spread(bounds[nodes], bounds[nodes + 1])
        point, entry = np.nonzero(np.repeat(open_, bounds[nodes + 1] - bounds[nodes], 0))
        away = ((self.points[at[point]] - book[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.diff(point, prepend=-1))
        least = np.repeat(np.minimum.reduceat(away, first), np.diff(first, append=len(point)))
        found[at] = np.minimum.reduceat(np.where(away == least, entry, k), first)
        np.add.at(counts, found[at], 1)
        np.add.at(sums, found[at], self.points[at])
        return found, counts, sums


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a partition in tables of ``size`` rows, the last one shorter."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, size - sum(b.num_rows for b in held)))
            batch = batch.slice(held[-1].num_rows)
            if sum(b.num_rows for b in held) == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def plant(vectors: DataFrame, width: int) -> DataFrame:
    """``id, label, vector`` to a row for each block: its ids and labels, and a tree for each part position."""
    schema = "ids array<{}>, labels array<{}>, n int, trees array<binary>".format(*(vectors.schema[c].dataType.simpleString() for c in ("id", "label")))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, max(LEAF, BLOCK // (PARTS * width))):
            points = matrix(block.column("vector").combine_chunks(), width)
            trees = [Tree.grown(points[:, p * width : (p + 1) * width]).packed() for p in range(PARTS)]
            own = [pa.ListArray.from_arrays(pa.array([0, len(points)], pa.int32()), block.column(c).combine_chunks()) for c in ("id", "label")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(points)], pa.int32()), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "n", "trees"])

    return stored(vectors.mapInArrow(grow, schema), "codes-trees")


@dataclass(frozen=True)
class Codebooks:
    """``entries`` has the axes part, entry and component."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, Tree]]:
        """Row, part and tree, one at a time."""
        for row, n in enumerate(batch.column("n").to_pylist()):
            for part, data in enumerate(batch.column("trees")[row]):
                yield row, part, Tree.unpacked(n, self.width, data.as_buffer())

    def moved(self, trees: DataFrame) -> Codebooks:
        """After one of Lloyd's rounds: each entry becomes the floor of the mean of its parts; unused ones stay."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(self.entries.shape[:2], np.int64), np.zeros_like(self.entries)
            for batch in batches:
                for _, part, tree in self.trees(batch):
                    _, n, s = tree.nearest(self.entries[part])
                    counts[part] += n
                    sums[part] += s
            of_each = np.repeat(counts.ravel(), self.width)
            used = np.flatnonzero(of_each)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, of_each[used], sums.ravel()[used])], ["slot", "n", "total"])

        rows = trees.mapInArrow(add, "slot long, n long, total long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        entries = self.entries.copy().ravel()
        for slot, n, total in rows:
            entries[slot] = total // n
        return Codebooks(entries.reshape(self.entries.shape))

    def encode(self, trees: DataFrame) -> DataFrame:
        """``id, label, code, error``: a byte for each part, and the squared distances summed over the parts."""
        kinds = [trees.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code, error = [], []
                for _, part, tree in self.trees(batch):
                    if part == 0:
                        code.append(np.zeros((len(tree.order), PARTS), np.uint8))
                        error.append(np.zeros(len(tree.order), np.int64))
                    found, _, _ = tree.nearest(self.entries[part])
                    code[-1][tree.order, part] = found
                    error[-1][tree.order] += ((tree.points - self.entries[part][found]) ** 2).sum(1)
                if code:
                    codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), sum(map(len, error)), [None, pa.py_buffer(np.concatenate(code).tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("ids").flatten(), batch.column("labels").flatten(), codes, pa.array(np.concatenate(error))], ["id", "label", "code", "error"])

        return trees.mapInArrow(look, f"id {kinds[0]}, label {kinds[1]}, code binary, error long")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """Codebooks fitted to ``id, label, vector``, and the codes of all vectors.

    Vectors that are null or hold null or non-finite components are dropped.
    The first entries are the parts of the vectors with the smallest ids (null
    ids last, equal ids by their vectors); with fewer vectors there are fewer
    entries. Vectors of different lengths count as continued with zeros, as do
    those whose length no number of equal parts makes up. Repeated rows are
    vectors of their own. Components are cut off where a vector's sum of
    squares could leave 64 bits: at 67,108,864 / 256 for 64 components. An
    empty table has no codes. Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    kept = vectors.select("id", "label", "vector").filter(usable("vector"))
    longest = kept.agg(F.max(F.size("vector"))).head()[0] or 0
    width = -(-longest // PARTS)
    kind = kept.schema["vector"].dataType.elementType
    first = [r[0] for r in kept.orderBy(F.asc_nulls_last("id"), "vector").select("vector").limit(entries).collect()]
    start = matrix(pa.array(first, pa.list_(pa.float64() if kind.simpleString() == "double" else pa.float32())), width)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), PARTS, width).transpose(1, 0, 2)))
    trees = plant(kept, max(1, width))
    if not width:
        books = Codebooks(np.zeros((PARTS, max(1, len(start)), 1), np.int64))
    for _ in range(rounds if width else 0):
        books = books.moved(trees)
    return books, books.encode(trees)


def op13_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings. Null and unusable vectors, repeated and equal ids, odd lengths and empty tables as in
    ``compress``; null labels count as equal; null ids are kept."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"))
    books, codes = compress(rows)
    codes = stored(codes.withColumn("key", F.to_json(F.struct("label"))), "codes-rows")
    errors = codes.groupBy("key").agg(F.sum("error").alias("label_error"))
    out = even_join(codes, errors, "key", ("id", "code"))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _nearest(name: str, books: str) -> str:
    """The nearest entry of every part, as a table of that name."""
    return f"""
{name} AS (
  SELECT vec_id, p, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d
  FROM (SELECT q.vec_id, q.p, q.v, b.e, list_sum(list_transform(list_zip(q.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM part q JOIN {books} b USING (p))
  GROUP BY vec_id, p)"""


def _moved(name: str, books: str, nearest: str) -> str:
    """The entries of ``books`` after a round."""
    return f"""
{name} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM {books} b LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c
    FROM (SELECT p, e, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM {nearest}, range(1, 5) r(i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))"""


#: For 64 components and ids that differ, as the given tables have them.
OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x) AS BIGINT)) AS ints, row_number() OVER (ORDER BY vec_id) - 1 AS place
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, p, ints[p * 4 + 1 : p * 4 + 4] AS v FROM kept, range(0, 16) r(p)),
b0 AS (SELECT q.p, k.place AS e, q.v AS c FROM part q JOIN kept k USING (vec_id) WHERE k.place < 64),{_nearest("n0", "b0")},{_moved("b1", "b0", "n0")},{_nearest("n1", "b1")},{_moved("b2", "b1", "n1")},{_nearest("n2", "b2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) FROM b2, range(1, 5) r(i)) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
