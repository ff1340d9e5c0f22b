"""Benchmark decontamination by weighted shingles of all of an item, ranked by SimHash windows of its size.

Words are runs of letters and digits; five-word shingles weigh as many letters
as they have. A stretch of a document that is similar enough to an item has so
much of the item's weight that it cannot miss a set of shingles that weighs
more than the rest: such a set of each item, its rarest shingles, is looked up
for every shingle of a document, wherever edits fall. Around each hit the
region that a similar stretch can reach is taken. Of several regions those with
a SimHash window of the item's size within the radius are verified first, by
the exact weighted Jaccard similarity of the item with every stretch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from verso.llm.common import count_words, pieces, table

WIDTH = 5
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Shingles are first looked up by so many low bits.
LOW = 20


def runs(words: list[bytes], width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words."""
    m = max(0, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.full(m, np.uint64(width))
    for k in range(width):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of a text and their weights, which are their letters, counted up to 255; texts of fewer than
    five words have none."""
    words = words_of(text)
    if len(words) < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    length = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return runs(words, WIDTH), np.minimum(length[WIDTH:] - length[:-WIDTH], 255).astype(np.int32)


def _prefix(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Prefix sums of the signed weights of each bit."""
    bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    bits *= 2
    bits -= 1
    bits *= w[:, None]
    out = np.zeros((len(x) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def _prints(prefix: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash fingerprints of the windows of ``size`` shingles at ``starts``."""
    return np.packbits(prefix[starts + size] > prefix[starts], axis=1).view(np.uint64)[:, 0]


class Index:
    """The shingles of a block of items that no stretch of similarity ``least`` can do without."""

    def __init__(self, items: list[tuple[int, str]], radius: int = 3, least: float = 0.8):
        self.radius, self.least = radius, least
        self.items, self.known = [], []
        parts = [(item_id, *shingles(text)) for item_id, text in items]
        parts = [(item_id, x, w) for item_id, x, w in parts if len(x)]
        spread = Counter(k for _, x, _ in parts for k in set(x.tolist()))
        keys, owners = [], []
        for item_id, x, w in parts:
            count, weight = Counter(x.tolist()), dict(zip(x.tolist(), w.tolist()))
            total = sum(weight[k] * c for k, c in count.items())
            kept = 0
            for k in sorted(count, key=lambda k: (spread[k], k)):
                keys.append(k)
                owners.append(len(self.items))
                kept += weight[k] * count[k]
                if kept > (1 - least) * total + 1:
                    break
            own = np.array(sorted(count), np.uint64)
            numbers = np.array([(weight[k], count[k]) for k in own.tolist()], np.int64)
            whole = _prints(_prefix(x, w), np.zeros(1, np.int64), len(x))[0]
            self.known.append((own, numbers[:, 0], numbers[:, 1], total, whole))
            self.items.append((item_id, len(x), count, weight))
        #: Items of fewer words than a shingle, by their size: hashes of all their words, and the items.
        self.short: dict[int, dict[int, list]] = {}
        for item_id, words in ((i, words_of(t)) for i, t in items):
            if 0 < len(words) < WIDTH:
                self.short.setdefault(len(words), {}).setdefault(int(runs(words, len(words))[0]), []).append(item_id)
        order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys, self.owners = np.array(keys, np.uint64)[order], np.array(owners, np.int64)[order]
        self.low = np.zeros(1 << LOW, bool)
        self.low[self._low(self.keys)] = True

    @staticmethod
    def _low(x: np.ndarray) -> np.ndarray:
        return (x & np.uint64((1 << LOW) - 1)).astype(np.int64)

    def regions(self, x: np.ndarray, w: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item that may be there: the parts of a text in which every similar stretch lies."""
        at = np.flatnonzero(self.low[self._low(x)])
        first = np.searchsorted(self.keys, x[at])
        many = np.searchsorted(self.keys, x[at], "right") - first
        hit = np.flatnonzero(many)
        if not len(hit):
            return {}
        many = many[hit]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        owner, place = self.owners[np.repeat(first[hit], many) + step], np.repeat(at[hit], many)
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        weight = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
        room = np.array([self.known[i][3] for i in owner.tolist()]) / max(self.least, 1e-9) + 1
        low = np.searchsorted(weight, weight[place + 1] - room)
        high = np.searchsorted(weight, weight[place] + room, "right") - 1
        out: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(owner.tolist(), low.tolist(), high.tolist()):
            parts = out.setdefault(i, [])
            if parts and a <= parts[-1][1]:
                parts[-1] = (parts[-1][0], b)
            else:
                parts.append((a, b))
        return out

    def _ranked(self, item: int, x: np.ndarray, w: np.ndarray, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Regions in order of the least distance of an item-sized window beyond the radius."""
        if len(parts) == 1:
            return parts
        far = []
        for a, b in parts:
            size = min(self.items[item][1], b - a)
            prints = _prints(_prefix(x[a:b], w[a:b]), np.arange(b - a - size + 1), size)
            far.append(max(0, int(np.bitwise_count(prints ^ self.known[item][4]).min()) - self.radius))
        return [parts[i] for i in sorted(range(len(parts)), key=lambda i: (far[i], i))]

    def best(self, item: int, x: np.ndarray, w: np.ndarray, parts: list[tuple[int, int]], least: float) -> tuple[float, int, int]:
        """The greatest weighted Jaccard similarity, ``least`` or more, of an item with any stretch, and the first such stretch.

        The best stretch begins and ends with shingles of the item. From each
        of them on the common weight is summed up, a shingle as often as the
        item has it, as far as a similar stretch can weigh.
        """
        own, weights, counts, total, _ = self.known[item]
        found = []
        for a, b in parts:
            at = np.searchsorted(own, x[a:b])
            at[at == len(own)] = 0
            place = np.flatnonzero(own[at] == x[a:b])
            if weights[at[place]].sum() >= least * total - 1e-6:
                found.append((a, b, place + a, at[place]))
        best = (0.0, 0, 0)
        if len(found) > 1:
            ranks = {part: i for i, part in enumerate(self._ranked(item, x, w, [f[:2] for f in found]))}
            found.sort(key=lambda f: ranks[f[:2]])
        for a, b, place, kind in found:
            gain, cap = weights[kind], counts[kind]
            ahead = np.concatenate([[0], np.cumsum(gain)])
            length = np.concatenate([[0], np.cumsum(w[a:b], dtype=np.int64)])
            start, stop = length[place - a], length[place - a + 1]
            ends = np.searchsorted(stop, start + total / max(least, 1e-9) + 1, "right")
            order = np.argsort(kind, kind="stable")
            new = np.concatenate([[True], np.diff(kind[order]) != 0])
            nth = np.empty(len(kind), np.int64)
            nth[order] = np.arange(len(kind)) - np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0))
            gone = np.zeros(len(own), np.int64)
            for i in range(len(place)):
                e = int(ends[i])
                if ahead[e] - ahead[i] >= max(least, best[0]) * total - 1e-6:
                    common = np.cumsum(np.where(nth[i:e] - gone[kind[i:e]] < cap[i:e], gain[i:e], 0))
                    s = common / (stop[i:e] - start[i] + total - common)
                    j = int(np.argmax(s))
                    best = max(best, (float(s[j]), int(place[i]), int(place[i + j]) + 1), key=lambda t: (t[0], -t[1], -t[2]))
                gone[kind[i]] += 1
        return best

    def similarity(self, item: int, x: np.ndarray, w: np.ndarray, start: int, slack: int = 2) -> tuple[float, int, int]:
        """The best weighted Jaccard similarity of an item with a stretch of about its length, and that stretch."""
        _, m, count, weight = self.items[item]
        best = (0.0, 0, 0)
        mine = sum(weight[k] * c for k, c in count.items())
        for a in range(max(0, start - slack), max(0, start) + slack + 1):
            for b in range(start + m - slack, start + m + slack + 1):
                b = min(b, len(x))
                if b <= a:
                    continue
                there = Counter(x[a:b].tolist())
                common = sum(weight[k] * min(c, there.get(k, 0)) for k, c in count.items())
                total = int(w[a:b].sum()) + mine - common
                best = max(best, (common / total if total else 0.0, a, b), key=lambda t: (t[0], -t[1], -t[2]))
        return best

    def matches(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        """``(item_id, similarity, first word, words)`` of the items that a text holds, the best place of each. An item of fewer
        than five words is there where all its words stand in a row."""
        return self._whole(text) + self._similar(text, least)

    def _whole(self, text: str | None) -> list[tuple[int, float, int, int]]:
        out, words = [], words_of(text) if self.short else []
        for size, known in sorted(self.short.items()):
            x = runs(words, size)
            there = np.flatnonzero(np.isin(x, np.fromiter(known, np.uint64, len(known))))
            first = {k: int(i) for i, k in reversed(list(zip(there, x[there].tolist())))}
            out += [(item, 1.0, i, size) for k, i in sorted(first.items(), key=lambda f: f[1]) for item in known[k]]
        return out

    def _similar(self, text: str | None, least: float) -> list[tuple[int, float, int, int]]:
        x, w = shingles(text)
        if not len(x) or not len(self.keys):
            return []
        best = ((i, self.best(i, x, w, parts, least)) for i, parts in sorted(self.regions(x, w).items()))
        return [(self.items[i][0], s, a, b - a + WIDTH - 1) for i, (s, a, b) in best if s >= least and b > a]


def _blocks(items: DataFrame, most_items: int, most_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about so many at most, each small enough to send to the executors."""
    items = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(count_words(F.col("text"))), F.lit(0)).alias("w")).first()
    many = max(1, -(-size["n"] // most_items), -(-size["w"] // most_words))
    for i in range(many):
        yield [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(many)) == i).orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 3, most_items: int = 4096, most_words: int = 1_000_000) -> DataFrame:
    """``doc_id, item_id, similarity, first_word, n_words`` for every item that a document holds.

    Items go to the executors in blocks of bounded size, a pass over the
    documents for each. Items of fewer than five words match where they stand
    whole, others by stretches of five words and more; null and empty texts and
    items hold and match nothing; repeated documents and items give repeated rows;
    empty tables give none; texts are read whole; other columns are ignored,
    whatever their names.
    """
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long, n_words long"
    found = None
    for block in _blocks(items, most_items, most_words):
        index = Index(block, radius, least)
        index.id_type = to_arrow_type(items.schema["item_id"].dataType)

        def look(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in index.matches(t, least)]
                columns = list(zip(*rows)) or [()] * 5
                values = [pa.array(c, k) for c, k in zip(columns[1:], (index.id_type, pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *values], [c.split()[0] for c in schema.split(", ")])

        part = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(look, schema)
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.8, radius: int = 3, most_items: int = 4096, most_words: int = 1_000_000) -> DataFrame:
    """The documents that hold no item, all columns kept; null texts stay."""
    for block in _blocks(items, most_items, most_words):
        index = Index(block, radius, least)

        def look(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not index.matches(t, least) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(look, docs.schema)
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """The items that each document holds; null, empty, repeated and long texts and empty tables as in ``find_leaks``."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
