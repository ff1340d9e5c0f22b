"""A language model of word n-grams in Elias-Fano tries, trained on and applied to a corpus.

Documents are cut into blocks, which ask shards of the vocabulary for numbers
and counts of their distinct words. Then each block asks for its distinct
n-grams once, dealt to shards by the digest of their first two words, with the
counts of its training documents. A shard adds the counts up, smooths and quantises
them, builds a trie and answers its blocks with a byte or two for each n-gram;
the blocks then score their documents. What crosses the network is distinct
n-grams and bytes, not tokens, and no task holds more than a block or a shard.

A level of a trie holds the words that follow each node of the level above. The
words of a node's children are sorted, and the last word of the ranges before
is added to them, so that the whole level is one monotone sequence; so are the
pointers to the ranges. Both are Elias-Fano coded: low bits in an array, high
bits in unary. A word is looked up as the successor of its value within its
context's range. Levels are read through a memory map.

Probabilities are interpolated with a Dirichlet prior, the shorter context's
distribution: p(w | c) = (n(c w) + m p(w | shorter c)) / (n(c) + m). Both the
first term and the weight of the second, m / (n(c) + m), are kept as bytes:
steps of a 25th of a decade. Words never seen in training share the mass that
the base distribution leaves.
"""

from __future__ import annotations

import math
import mmap
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.llm.common import discard, stored, table
from verso.session import shared_dir

#: Weight of the shorter context's distribution for contexts of one word and of two; chosen on held-out rows of the small tables.
PRIOR = (200.0, 5.0)
#: Bytes of text of a block, and tokens for which there is one shard.
BLOCK, SHARD = 8 << 20, 1 << 20
#: Steps a decade of quantised probabilities; a byte of 0 says that there is none.
STEPS = 25
#: Ends a text; no word has a line break.
END = b"\n"


def pack(*columns: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, by the planes of their bytes, compressed."""
    out = []
    for x in columns:
        x = np.ascontiguousarray(x, "<i8")
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        body = pa.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), "zstd", asbytes=True)
        out += [struct.pack("<qqq", len(x), width, len(body)), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, size = struct.unpack_from("<qqq", data, at)
        planes = np.frombuffer(pa.decompress(data[at + 24 : at + 24 + size], n * width, "zstd"), np.uint8)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = planes.reshape(width, n).T
        out.append(x.view("<i8").reshape(-1))
        at += 24 + size
    return out


def quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(255, 1 + np.rint(-STEPS * np.log10(p))).astype(np.uint8)


#: What the bytes stand for.
VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


# the trie ---------------------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence of whole numbers: the low bits of each, and its high bits in unary, which start with as many ones
    as values share them and end with a zero. Where the ones and zeros are is looked up when the sequence is opened."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        unary = np.unpackbits(high, bitorder="little")
        self.ones, self.zeros = np.flatnonzero(unary), np.flatnonzero(unary == 0)
        self.lows = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))

    @classmethod
    def coded(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = [np.packbits(((values[a : a + (1 << 16), None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, 1 << 16)]
        unary = np.zeros(n + (top >> width) + 1, np.uint8)
        unary[(values >> width) + np.arange(n)] = 1
        return cls(n, width, np.concatenate([*low, np.zeros(8, np.uint8)]), np.packbits(unary, bitorder="little"))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.ones[i] - i << self.width) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.width
        return ((self.lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def _upto(self, high: np.ndarray) -> np.ndarray:
        """How many values have at most these high bits."""
        inside = np.clip(high, 0, len(self.zeros) - 1)
        return np.where(high < 0, 0, self.zeros[inside] - inside)

    def successor(self, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first place from ``start`` on, and before ``end``, whose value is no less; else ``end``."""
        high, low = value >> self.width, value & ((1 << self.width) - 1)
        a, b = np.maximum(start, self._upto(high - 1)), np.minimum(end, self._upto(high))
        stop = np.minimum(end, np.maximum(a, b))
        a, b = np.minimum(a, end), stop
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            less = open_ & (self._low(np.where(open_, middle, 0)) < low)
            a, b = np.where(less, middle + 1, a), np.where(open_ & ~less, middle, b)
        return a


class Trie:
    """Levels of a trie: ``keys`` of each, ``starts`` of the ranges of each but the last, and bytes for each node.

    ``arrays`` are what is stored: for each sequence its low bits and unary
    words, and the bytes of the nodes.
    """

    def __init__(self, arrays: list[np.ndarray]):
        self.keys, self.starts, self.marks = [], [], []
        shape = arrays[0].tolist()
        at = 1
        for level in range(shape[0]):
            for kind, seqs in enumerate((self.keys, self.starts)):
                n, width = shape[1 + 4 * level + 2 * kind : 3 + 4 * level + 2 * kind]
                if n >= 0:
                    seqs.append(EliasFano(n, width, arrays[at].view(np.uint8), arrays[at + 1].view(np.uint8)))
                    at += 2
            self.marks.append((arrays[at].view(np.uint8), arrays[at + 1].view(np.uint8)))
            at += 2

    @staticmethod
    def built(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> bytes:
        """The stored form of ``parent, word, bytes, bytes`` of each level, sorted by parent and word; parents of the first are 0."""
        shape, arrays = [len(levels)], []
        for depth, (parent, word, *marks) in enumerate(levels):
            parents = len(levels[depth - 1][0]) if depth else 1
            starts = np.searchsorted(parent, np.arange(parents + 1))
            last = np.flatnonzero(np.diff(parent, append=parents))
            base = np.zeros(parents, np.int64)
            base[parent[last]] = word[last] + 1
            base = np.cumsum(base) - base
            following = np.searchsorted(levels[depth + 1][0], np.arange(len(word) + 1)) if depth + 1 < len(levels) else None
            assert starts[-1] == len(word)
            for values in (base[parent] + word, following):
                seq = None if values is None else EliasFano.coded(values)
                shape += [-1, 0] if seq is None else [seq.n, seq.width]
                arrays += [] if seq is None else [seq.low, seq.high]
            arrays += marks
        arrays = [np.array(shape, "<i8"), *arrays]
        out = [struct.pack("<q", len(arrays)), struct.pack(f"<{len(arrays)}q", *(x.nbytes for x in arrays))]
        for x in arrays:
            out += [x.tobytes(), b"\0" * (-x.nbytes % 8)]
        return b"".join(out)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie through a map of a file that has no name, and goes with the map."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        (n,) = struct.unpack_from("<q", view)
        at, arrays = 8 + 8 * n, []
        for i, size in enumerate(struct.unpack_from(f"<{n}q", view, 8)):
            arrays.append(np.frombuffer(view, "<i8" if i == 0 else np.uint8, size // 8 if i == 0 else size, at))
            at += size + -size % 8
        return cls(arrays)

    def child(self, level: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node of ``level`` below each parent (a node of the level above, or -1) that has this word, else -1."""
        keys, there = self.keys[level], parent >= 0
        if not keys.n:
            return np.full(len(word), -1)
        inside = np.where(there, parent, 0)
        start, end = (self.starts[level - 1][inside], self.starts[level - 1][inside + 1]) if level else (np.zeros_like(word), np.full_like(word, keys.n))
        value = word + np.where(start > 0, keys[np.maximum(start - 1, 0)] + 1, 0)
        place = keys.successor(start, end, value)
        found = there & (place < end) & (keys[np.minimum(place, keys.n - 1)] == value)
        return np.where(found, place, -1)


# blocks of documents ----------------------------------------------------------------------------------


def digest(word: bytes) -> int:
    """64 bits that stand for a word."""
    return xxhash.xxh3_64_intdigest(word)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens of each text end, all tokens as places in the third: digests of the words, the most frequent first."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(len(texts)), lengths)[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    words = np.fromiter((digest(w) for w in (*coded.dictionary.cast(pa.binary()).to_pylist(), END)), np.uint64, len(coded.dictionary) + 1).view(np.int64)
    ends = np.cumsum(np.bincount(text, minlength=len(texts)) + 1)
    tokens = np.full(ends[-1] if len(ends) else 0, len(words) - 1, np.int32)
    inner = np.ones(len(tokens), bool)
    inner[ends - 1] = False
    tokens[inner] = coded.indices.to_numpy(zero_copy_only=False)
    by_number = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    place = np.empty(len(words), np.int32)
    place[by_number] = np.arange(len(words), dtype=np.int32)
    return ends, place[tokens], words[by_number]


def block_rows(docs: DataFrame) -> DataFrame:
    """``id, text, learn`` to a row for each block: its documents, tokens and words."""
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            edges = np.unique([0, *(np.flatnonzero(np.diff(size // BLOCK)) + 1), len(size)])
            for a, b in zip(edges[:-1], edges[1:]):
                part = batch.slice(a, b - a)
                ends, tokens, words = tokens_of(part.column("text"))
                learn = np.repeat(part.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(ends, prepend=0))
                n = np.bincount(tokens[learn], minlength=len(words))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                columns = [pa.array([block]), one(part.column("id")), one(part.column("learn")), pa.array([pack(ends)], pa.binary()), pa.array([pack(tokens)], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([pack(n)], pa.binary()), pa.array([len(tokens)]), pa.array([len(words)])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "ids", "learn", "ends", "tokens", "words", "n", "size", "distinct"])
                block += 1

    return docs.mapInArrow(cut, f"block long, ids array<{kind}>, learn array<boolean>, ends binary, tokens binary, words binary, n binary, size long, distinct long")


def with_numbers(blocks: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Blocks whose words are replaced by their numbers plus one (0: not in training) and counts, and one row a shard of
    words: ``train_tokens, train_words``.

    Words are dealt to shards by their digests and ranked in each by frequency;
    a word's number is its rank times the shards, plus its shard: frequent
    words have small numbers without a sort of all words.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, n in zip(batch.column("block").to_pylist(), batch.column("words"), batch.column("n")):
                words = np.frombuffer(words.as_buffer(), np.uint64)
                order = np.argsort(words)
                words, n = words[order], unpack(n.as_py())[0][order]
                shard = ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
                edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
                cut = list(zip(edges[:-1], edges[1:]))
                columns = [pa.array(shard[edges[:-1]]), pa.array([block] * len(cut), pa.int64()), pa.array([words[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([pack(n[a:b]) for a, b in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "words", "n"])

    def answer(asked: pa.Table) -> pa.Table:
        parts, shard = [np.frombuffer(w.as_buffer(), np.uint64) for w in asked.column("words")], asked.column("shard")[0].as_py()
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(n.as_py())[0] for n in asked.column("n")]), len(distinct)).astype(np.int64)
        by_number = np.argsort(-total, kind="stable")
        number = np.empty(len(distinct), np.int64)
        number[by_number] = np.arange(len(distinct)) * shards + shard + 1
        number[total == 0] = 0
        replies = [pack(number[x], total[x]) for x in np.split(at, np.cumsum([len(p) for p in parts])[:-1])]
        none = [None] * len(replies)
        return pa.table({"shard": pa.array([shard] * (len(replies) + 1), pa.int32()), "block": pa.array([*asked.column("block").to_pylist(), None], pa.int64()), "reply": pa.array([*replies, None], pa.binary()), "train_tokens": pa.array([*none, int(total.sum())], pa.int64()), "train_words": pa.array([*none, int((total > 0).sum())], pa.int64())})

    asked = blocks.select("block", "words", "n").mapInArrow(ask, "shard int, block long, words binary, n binary")
    replies = stored(asked.groupBy("shard").applyInArrow(answer, "shard int, block long, reply binary, train_tokens long, train_words long"), "lm-words")

    def put(block: pa.Table, replies: pa.Table) -> pa.Table:
        order = np.argsort(np.frombuffer(block.column("words")[0].as_buffer(), np.uint64))
        known = [unpack(replies.column("reply")[int(i)].as_py()) for i in np.argsort(replies.column("shard").to_numpy())]
        number, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        number[order], n[order] = (np.concatenate([k[i] for k in known]) for i in (0, 1))
        return block.drop_columns(["words", "n", "size", "distinct"]).append_column("known", pa.array([pack(number, n)], pa.binary()))

    kept = [f for f in blocks.schema if f.name not in ("words", "n", "size", "distinct")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", known binary"
    told = replies.filter("block IS NOT NULL").select("block", "shard", "reply")
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(put, schema), replies.filter("block IS NULL").select("train_tokens", "train_words")


class Block:
    """The tokens of a block and its distinct n-grams of known words.

    ``pairs`` are sorted by shard, then first and second word; ``triples`` hold
    the place of their pair and the third word. ``pair_at`` and ``triple_at``
    say for each place in ``tokens`` which pair or triple starts there, or -1.
    """

    def __init__(self, ends: bytes, tokens: bytes, known: bytes, learn: np.ndarray, shards: int, order: int):
        (self.ends,), (tokens,), (number, n) = unpack(ends), unpack(tokens), unpack(known)
        word, self.n = (number - 1)[tokens], n[tokens]
        self.size, self.last = len(word), np.zeros(len(word), bool)
        self.last[self.ends - 1] = True
        learn = np.repeat(learn, np.diff(self.ends, prepend=0))
        start = np.flatnonzero(~self.last & (word >= 0) & (np.append(word[1:], -1) >= 0))
        pairs, which, self.pair_n = self._distinct(word[start] << 32 | word[start + 1], learn[start])
        # a multiplication spreads the low bits to the high ones
        shard = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        self.pairs, self.pair_n, self.shard = pairs[by_shard], self.pair_n[by_shard], shard[by_shard]
        place = np.empty(len(pairs), np.int64)
        place[by_shard] = np.arange(len(pairs))
        self.pair_at = np.full(self.size, -1)
        self.pair_at[start] = place[which]
        self.first_n = np.zeros(len(pairs), np.int64)
        self.first_n[place[which]] = self.n[start]
        self.triple_at = np.full(self.size, -1)
        start = start[:0] if order < 3 else start[np.append(self.pair_at[1:], -1)[start] >= 0]
        self.triples, which, self.triple_n = self._distinct(self.pair_at[start] << 32 | word[start + 2 if len(start) else start], learn[start])
        self.triple_at[start] = which

    @staticmethod
    def _distinct(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        distinct, which = np.unique(keys, return_inverse=True)
        return distinct, which, np.bincount(which[learn], minlength=len(distinct))

    def questions(self) -> Iterator[tuple[int, bytes]]:
        """Shard and what is asked of it: pairs with the number of their first word, and triples below them, with counts."""
        below, word = self.triples >> 32, self.triples & 0xFFFFFFFF
        edges = np.flatnonzero(np.diff(self.shard, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            c, d = np.searchsorted(below, (a, b))
            first = self.pairs[a:b] >> 32
            new = np.flatnonzero(np.diff(first, prepend=-1))
            children = np.bincount(below[c:d] - a, minlength=b - a)
            yield int(self.shard[a]), pack(np.diff(first[new], prepend=0), self.first_n[a:b][new], np.diff(new, append=b - a), self.pairs[a:b] & 0xFFFFFFFF, self.pair_n[a:b], children, word[c:d], self.triple_n[c:d])


def question(data: bytes) -> tuple[np.ndarray, ...]:
    """``first, second, first_n, pair_n`` of pairs; ``pair, third, triple_n`` of triples."""
    gap, first_n, size, second, pair_n, children, third, triple_n = unpack(data)
    return np.repeat(np.cumsum(gap), size), second, np.repeat(first_n, size), pair_n, np.repeat(np.arange(len(second)), children), third, triple_n


class Shard:
    """What all blocks ask of a shard: its distinct ``pairs`` and ``triples``, where each question is among them, and their
    numbers in training."""

    def __init__(self, first: np.ndarray, second: np.ndarray, first_n: np.ndarray, pair_n: np.ndarray, pair: np.ndarray, third: np.ndarray, triple_n: np.ndarray):
        self.pairs, self.pair_at = np.unique(first << 32 | second, return_inverse=True)
        self.pair_n = np.bincount(self.pair_at, pair_n, len(self.pairs)).astype(np.int64)
        self.first_n = np.zeros(len(self.pairs), np.int64)
        self.first_n[self.pair_at] = first_n
        self.triples, self.triple_at = np.unique(self.pair_at[pair] << 32 | third, return_inverse=True)
        self.triple_n = np.bincount(self.triple_at, triple_n, len(self.triples)).astype(np.int64)

    def trie(self, prior: tuple[float, ...]) -> bytes:
        """The trie of all pairs and triples that occur in training."""
        seen, seen3, none = self.pair_n > 0, self.triple_n > 0, np.zeros(0, np.uint8)
        pairs, n, triples = self.pairs[seen], self.pair_n[seen], self.triples[seen3]
        word, at = np.unique(pairs >> 32, return_inverse=True)
        more = len(prior) > 1
        levels = [(np.zeros(len(word), np.int64), word, none, none), (at, pairs & 0xFFFFFFFF, quantised(n / (self.first_n[seen] + prior[0])), quantised(prior[1] / (n + prior[1])) if more else none)]
        if more:
            above = (np.cumsum(seen) - 1)[triples >> 32]
            levels.append((above, triples & 0xFFFFFFFF, quantised(self.triple_n[seen3] / (n[above] + prior[1])), none))
        return Trie.built(levels)

    def replies(self, trie: Trie) -> list[np.ndarray]:
        """The bytes of each question's pairs (two kinds) and triples; 0 for what training does not have."""

        def marks(level: int, kind: int, node: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.append(trie.marks[level][kind], np.uint8(0))[node][at]  # -1 is the one after the last

        word, at = np.unique(self.pairs >> 32, return_inverse=True)
        node = trie.child(1, trie.child(0, np.zeros_like(word), word)[at], self.pairs & 0xFFFFFFFF)
        out = [marks(1, 0, node, self.pair_at)]
        if len(trie.keys) > 2:
            out += [marks(1, 1, node, self.pair_at), marks(2, 0, trie.child(2, node[self.triples >> 32], self.triples & 0xFFFFFFFF), self.triple_at)]
        return out


def answers(blocks: DataFrame, shards: int, prior: tuple[float, ...]) -> DataFrame:
    """``shard, block, bytes, trie``: the answers of every shard to every block, and its trie in a row without a block."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(*(batch.column(c)[row].as_py() for c in ("ends", "tokens", "known")), np.array(batch.column("learn")[row].as_py(), bool), shards, len(prior) + 1)
                asked = list(block.questions())
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in asked], pa.int32()), pa.array([batch.column("block")[row].as_py()] * len(asked), pa.int64()), pa.array([q for _, q in asked], pa.binary())], ["shard", "block", "question"])

    def answer(asked: pa.Table) -> pa.Table:
        parts = [question(q.as_py()) for q in asked.column("question")]
        sizes, size3 = [len(p[0]) for p in parts], [len(p[4]) for p in parts]
        offset = np.repeat(np.cumsum([0, *sizes[:-1]]), size3)
        whole = [np.concatenate([p[i] for p in parts]) for i in range(7)]
        whole[4] = whole[4] + offset
        shard = Shard(*whole)
        data = shard.trie(prior)
        replies = shard.replies(Trie.mapped(data))
        cuts = [np.cumsum(size3 if i == 2 else sizes)[:-1] for i in range(len(replies))]
        rows = [pack(*row) for row in zip(*(np.split(r, c) for r, c in zip(replies, cuts)))]
        number = asked.column("shard")[0].as_py()
        return pa.table({"shard": pa.array([number] * (len(rows) + 1), pa.int32()), "block": pa.array([*asked.column("block").to_pylist(), None], pa.int64()), "bytes": pa.array([*rows, None], pa.binary()), "trie": pa.array([None] * len(rows) + [data], pa.binary())})

    asked = blocks.mapInArrow(ask, "shard int, block long, question binary")
    return asked.groupBy("shard").applyInArrow(answer, "shard int, block long, bytes binary, trie binary")


def score(docs: DataFrame, learn: Column, prior: tuple[float, ...] = PRIOR) -> tuple[DataFrame, DataFrame]:
    """Scores of ``id, text`` by a model of the documents for which ``learn`` holds, and the tries of the model (``shard, trie``).

    Words are lower-cased in A-Z and cut at ASCII blanks; each text ends in a
    token of its own. One row a document: ``id, learn, n_tokens, n_known`` (its
    tokens that training has), ``train_tokens`` (all of them), ``base_score``
    (log10 probability by words alone) and ``score`` (by the model). ``prior``
    has the weight for contexts of one word, and of two if it has a second
    number. A null text is empty and is one token; where ``learn`` is null it
    does not hold; repeated rows are documents of their own; texts are read
    whole; an empty table has no rows. Words are told apart by 64-bit digests.
    Other columns are ignored.
    """
    if not 1 <= len(prior) <= 2:
        raise ValueError("contexts have one word or two")
    kind = docs.schema["id"].dataType.simpleString()
    spark, cut = docs.sparkSession, shared_dir(docs.sparkSession, "lm-blocks")
    block_rows(docs.select("id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))).write.parquet(cut)
    blocks = spark.read.parquet(cut)
    size, distinct = (max(1, math.ceil((x or 0) / SHARD)) for x in blocks.agg(F.sum("size"), F.sum("distinct")).head())
    shards, (blocks, totals) = size, with_numbers(blocks, distinct)
    blocks = stored(blocks, "lm-numbered")
    discard(spark, cut)
    total, distinct = totals.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_words"), F.lit(0))).head()
    replies = stored(answers(blocks, shards, prior), "lm-answers")

    def finish(rows: pa.Table, replies: pa.Table) -> pa.Table:
        learnt = np.array(rows.column("learn")[0].as_py(), bool)
        block = Block(*(rows.column(c)[0].as_py() for c in ("ends", "tokens", "known")), learnt, shards, len(prior) + 1)
        in_order = [unpack(replies.column("bytes")[int(i)].as_py()) for i in np.argsort(replies.column("shard").to_numpy())]
        own, weight, own3 = (np.concatenate([r[i] for r in in_order]) if in_order and len(in_order[0]) > i else np.zeros(0, np.int64) for i in range(3))
        p = (block.n + 0.5) / (total + 0.5 * (distinct + 1))
        base, starts = np.log10(p), np.append(0, block.ends[:-1])

        def of(marks: np.ndarray, at: np.ndarray, otherwise: float) -> np.ndarray:
            """Values of the marks at these places; where there is no place or mark, the other value."""
            marks = np.append(marks, 0)[at]
            return np.where(marks > 0, VALUES[marks], otherwise)

        i = np.flatnonzero(~block.last)  # the next token has a context of one word
        n = block.n[i]
        p[i + 1] = of(own, block.pair_at[i], 0.0) + np.where(n > 0, prior[0] / (n + prior[0]), 1.0) * p[i + 1]
        if len(prior) > 1:
            i = i[~block.last[i + 1]]
            p[i + 2] = of(own3, block.triple_at[i], 0.0) + of(weight, block.pair_at[i], 1.0) * p[i + 2]
        sums = [np.add.reduceat(x, starts) for x in (base, np.log10(p), (block.n > 0).astype(np.int64))]
        return pa.table({
            "id": rows.column("ids").combine_chunks().flatten(), "learn": pa.array(learnt), "n_tokens": pa.array(np.diff(block.ends, prepend=0)), "n_known": pa.array(sums[2]),
            "train_tokens": pa.array(np.full(len(learnt), total)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1]),
        })

    schema = f"id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = blocks.groupBy("block").cogroup(replies.filter("block IS NOT NULL").select("block", "shard", "bytes").groupBy("block")).applyInArrow(finish, schema)
    return scored, replies.filter("block IS NULL").select("shard", "trie")


def op12_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose id's CRC-32 is not 1 modulo 5; a null id is learnt from. Null, empty
    and long texts, repeated rows and empty tables as in ``score``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False))
    scored, _ = score(docs, ~held_out)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
