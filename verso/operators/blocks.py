"""Blocks of the keyword index: building, bounds and scoring.

A block holds the postings of some chunks of about the same length: its terms,
and for each term the places and frequencies of the chunks that have it. All of
a chunk is in one block, so that scores are summed where the postings are, and
only the best chunks of a block leave its task. For each term and block there
is a bound on what the term can add to a score; a question skips the blocks
whose bounds cannot reach what it has found already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.functions.text import tokens

K1, B = 1.5, 0.75
#: Chunks of a block, its words, about, and postings times questions that are scored at once.
CHUNKS, WORDS, AT_ONCE = 1024, 1 << 19, 1 << 20
#: Characters of a word, about, and classes of length up to twice a length.
LETTERS, CLASSES = 6, 8
#: A block's columns beside the ids of its chunks and their departments.
POSTINGS = "block string, lengths array<int>, terms array<string>, starts array<int>, places array<short>, counts array<int>"


def impact(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What a term of weight one adds to the score of a chunk."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def one(values: pa.Array) -> pa.ListArray:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(rows: pa.Table, name: str) -> pa.RecordBatch:
    words = rows.column("words").combine_chunks()
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    n = len(lengths)
    keys, tf = np.unique(rank[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, place = keys // n, keys % n
    starts = np.searchsorted(term, np.arange(len(order) + 1))
    columns = {
        "block": pa.array([name]), "lengths": one(pa.array(lengths, pa.int32())), "terms": one(coded.dictionary.take(pa.array(order))), "starts": one(pa.array(starts, pa.int32())),
        "places": one(pa.array(place, pa.int16())), "counts": one(pa.array(tf, pa.int32())), "chunk_ids": one(rows.column("chunk_id").combine_chunks()), "departments": one(rows.column("department").combine_chunks()),
    }
    return pa.RecordBatch.from_pydict(columns)


def cells(counts: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """The first cell and the number of cells of each class of length, from ``(class, chunks, words)``: neighbours that fill
    less than a block share a cell, a class that fills more is dealt to several."""
    known = {c: (n, w) for c, n, w in counts}
    first, many, at, held = [], [], 0, (0, 0)
    for c in range(max(known, default=0) + 1):
        n, w = known.get(c, (0, 0))
        k = max(1, -(-7 * n // (6 * CHUNKS)), -(-w // WORDS)) if n > CHUNKS or w > WORDS else 1  # cells are not quite even
        if held[0] and (k > 1 or held[0] + n > CHUNKS or held[1] + w > WORDS):
            at, held = at + 1, (0, 0)
        first.append(at)
        many.append(k)
        at, held = (at + k, (0, 0)) if k > 1 else (at, (held[0] + n, held[1] + w))
    return first, many


def build(words: DataFrame, segment: str, n: int, sizes: DataFrame | None = None) -> DataFrame:
    """``chunk_id, department`` and ``words``, or ``text`` to be cut into words, of ``n`` chunks to a row a block.

    Chunks are dealt by length to cells that fill a block by chunks or words,
    so that a task's work and memory depend neither on how many there are nor
    on how long they are. ``sizes`` has the column ``size``, about the words of
    each chunk, where it is cheaper to read elsewhere.
    """
    kind = words.schema["chunk_id"].dataType.simpleString()
    size = F.coalesce(F.length("text") / LETTERS if "text" in words.columns else F.size("words"), F.lit(0))
    sized = words.withColumn("size", F.greatest(size, F.lit(0)).cast("int"))
    place = F.floor(F.log2(F.col("size") + 1.0) * CLASSES).cast("int")
    found = []
    if n > CHUNKS:
        found = (sized if sizes is None else sizes).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.sum("size").alias("w")).collect()  # a few hundred at most
    first, many = cells([tuple(r) for r in found])

    def at(values: list[int]):
        told = F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
        return F.get(told, F.least(place, F.lit(len(values) - 1)))

    every = first[-1] + many[-1]
    cell = at(first) + F.pmod(F.xxhash64("chunk_id"), at(many)).cast("int")
    dealt = sized.withColumn("cell", cell).drop("size").repartition(min(every, 64 + every // 8), "cell").sortWithinPartitions("cell")
    if "text" in words.columns:
        dealt = dealt.select("chunk_id", "department", tokens(F.col("text")).alias("words"), "cell")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.take(pc.sort_indices(rows.column("chunk_id")))  # equal scores go by id, which is then the place
            return _block(rows, f"{segment}/{rows.column('chunk_id')[0].as_py()}")

        chunks, full, last = 0, 0, None
        for batch in batches:
            begin = 0
            for row, (cell, size) in enumerate(zip(batch.column("cell").to_pylist(), pc.list_value_length(batch.column("words")).to_pylist())):
                if chunks and (cell != last or chunks == CHUNKS or full + size > 2 * WORDS):
                    held.append(batch.slice(begin, row - begin))
                    yield whole()
                    held, begin, chunks, full = [], row, 0, 0
                chunks, full, last = chunks + 1, full + size, cell
            held.append(batch.slice(begin))
        if chunks:
            yield whole()

    return dealt.mapInArrow(cut, f"{POSTINGS}, chunk_ids array<{kind}>, departments array<string>")


def bounds(blocks: DataFrame, mean: float) -> DataFrame:
    """``term, block, df, bound``: what a term of weight one adds at most in a block, for mean lengths up to ``mean`` and in proportion above."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths, starts, places, counts = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in ("lengths", "starts", "places", "counts"))
                most = np.maximum.reduceat(impact(counts, lengths[places], mean), starts[:-1]) if len(starts) > 1 else np.zeros(0)
                terms = batch.column("terms")[row].values
                yield pa.RecordBatch.from_arrays([terms, pa.array([batch.column("block")[row].as_py()] * len(terms), pa.string()), pa.array(np.diff(starts)), pa.array(most)], ["term", "block", "df", "bound"])

    return blocks.select("block", "lengths", "terms", "starts", "places", "counts").mapInArrow(look, "term string, block string, df long, bound double")


def lost(blocks: DataFrame) -> DataFrame:
    """``term, df`` (below zero) of the chunks in ``gone``, places of a block's chunks that end."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ended = np.zeros(len(batch.column("lengths")[row].values), np.int64)
                ended[batch.column("gone")[row].as_py()] = 1
                starts = batch.column("starts")[row].values.to_numpy()
                n = np.diff(np.append(0, np.cumsum(ended[batch.column("places")[row].values.to_numpy()]))[starts])
                yield pa.RecordBatch.from_arrays([batch.column("terms")[row].values.filter(pa.array(n > 0)), pa.array(-n[n > 0])], ["term", "df"])

    return blocks.select("terms", "lengths", "starts", "places", "gone").mapInArrow(look, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def words_of(blocks: DataFrame) -> DataFrame:
    """``chunk_id, block, department, words``: what blocks were built of, words in another order."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                starts, places, counts, lengths = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in ("starts", "places", "counts", "lengths"))
                term, place = np.repeat(np.repeat(np.arange(len(starts) - 1), np.diff(starts)), counts), np.repeat(places, counts)
                words = batch.column("terms")[row].values.take(pa.array(term[np.argsort(place, kind="stable")]))
                listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), words)
                name = pa.array([batch.column("block")[row].as_py()] * len(lengths), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("chunk_ids")[row].values, name, batch.column("departments")[row].values, listed], ["chunk_id", "block", "department", "words"])

    kind = blocks.schema["chunk_ids"].dataType.elementType.simpleString()
    return blocks.mapInArrow(look, f"chunk_id {kind}, block string, department string, words array<string>")


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Pack:
    """Questions that are scored together: terms, and for each the questions that have it with their weights."""

    def __init__(self, questions: list[dict]):
        term = pa.array([t for q in questions for t in q["terms"]], pa.string()).dictionary_encode()
        number = np.repeat(np.arange(len(questions)), [len(q["terms"]) for q in questions])
        index = term.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(index, kind="stable")
        self.terms, self.question = term.dictionary, number[order]
        self.weight = np.array([w for q in questions for w in q["weights"]])[order]
        self.starts = np.searchsorted(index[order], np.arange(len(self.terms) + 1))
        self.admin = np.array([bool(q.get("is_admin")) for q in questions])
        self.department = [q.get("user_department") or "" for q in questions]
        self.n = len(questions)

    def scores(self, block: dict[str, np.ndarray], mean: float) -> tuple[np.ndarray, np.ndarray]:
        """Sums of weighted impacts by question and chunk, and which of them have a term in common."""
        at = pc.index_in(self.terms, value_set=block["terms"])
        there = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        mine = at.drop_null().to_numpy().astype(np.int64)
        first, size = block["starts"][mine], block["starts"][mine + 1] - block["starts"][mine]
        asking = self.starts[there + 1] - self.starts[there]
        n = len(block["lengths"])
        total = np.zeros(self.n * n)
        seen = np.zeros(self.n * n, bool)
        step = np.cumsum(size * asking) // AT_ONCE
        for part in np.split(np.arange(len(there)), np.flatnonzero(np.diff(step)) + 1) if len(there) else ():
            rows = spread(first[part], size[part])
            place, tf = block["places"][rows].astype(np.int64), block["counts"][rows].astype(np.float64)
            value = impact(tf, block["lengths"][place], mean)
            again = np.repeat(asking[part], size[part])  # each posting once for each question that asks for its term
            who = spread(np.repeat(self.starts[there[part]], size[part]), again)
            cell = self.question[who] * n + np.repeat(place, again)
            total += np.bincount(cell, self.weight[who] * np.repeat(value, again), len(total))
            seen[cell] = True
        return total.reshape(self.n, n), seen.reshape(self.n, n)


def score(work: DataFrame, mean: float, k: int | None) -> DataFrame:
    """``query_id, chunk_id, score``: of each row of ``work`` the best ``k`` chunks of every wanted question, ties at the sixth
    decimal included; all that share a term without ``k``.

    A row has a block's columns, ``questions`` (structs of ``query_id, terms,
    weights`` and, with access, ``user_department, is_admin``), ``wanted``
    (which of them), ``kept`` (places that filters let through; null: all) and
    ``gone`` (places that have ended; null: none).
    """
    kinds = {f.name: f.dataType for f in work.schema}
    asked = kinds["questions"].elementType
    out = f"query_id {asked['query_id'].dataType.simpleString()}, chunk_id {kinds['chunk_ids'].elementType.simpleString()}, score double"
    access = "user_department" in asked.names

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, tuple[Pack, pa.Array]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row]  # noqa: B023, E731
                number = value("pack").as_py()
                if number not in packs:
                    packs = {number: (Pack(value("questions").as_py()), value("questions").values.field("query_id"))}  # one at a time
                pack, ids = packs[number]
                block = {c: value(c).values.to_numpy(zero_copy_only=False) for c in ("lengths", "starts", "places", "counts")} | {"terms": value("terms").values}
                total, seen = pack.scores(block, mean)
                kept, gone = value("kept").as_py(), value("gone").as_py()
                if kept is not None:
                    seen &= np.isin(np.arange(seen.shape[1]), kept)
                if gone:
                    seen[:, gone] = False
                if access:
                    names, of = np.unique(np.array(value("departments").as_py(), object), return_inverse=True)
                    may = np.array([[d in ("", own) for d in names] for own in pack.department]) | pack.admin[:, None]
                    seen &= may[:, of]
                which = np.array(value("wanted").as_py(), np.int64)
                q, chunk = np.nonzero(seen[which])
                q = which[q]
                got = total[q, chunk]
                if k is not None and len(got):
                    order = np.lexsort((-got, q))
                    q, chunk, got = q[order], chunk[order], got[order]
                    first = np.searchsorted(q, q)
                    limit = got[np.minimum(first + k, np.searchsorted(q, q, "right")) - 1]
                    best = got >= limit - 2e-6
                    q, chunk, got = q[best], chunk[best], got[best]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), value("chunk_ids").values.take(pa.array(chunk)), pa.array(got)], ["query_id", "chunk_id", "score"])

    return work.mapInArrow(look, out)
