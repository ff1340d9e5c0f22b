"""Elias-Fano tries and language model scores against plain dictionaries."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verso.llm import ngrams

DOCS = "id long, text string, learn boolean, block long, word string"


def docs(spark, rows):
    """Documents with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, x, 1, "w") for i, t, x in rows], DOCS)


@pytest.mark.parametrize("seed", range(8))
def test_elias_fano_sequences(seed):
    rng = np.random.default_rng(seed)
    n, top = int(rng.choice([1, 2, 63, 64, 500, 70_000])), int(rng.choice([1, 3, 1000, 2**20, 2**45]))
    values = np.sort(rng.integers(0, top, n))
    values[n // 2 :] = values[n // 2 :][0] if seed % 4 == 0 else values[n // 2 :]
    seq = ngrams.EliasFano.coded(values)
    assert (seq[np.arange(n)] == values).all()
    start = rng.integers(0, n, 200)
    end = np.minimum(n, start + rng.integers(0, n + 1, 200))
    asked = np.concatenate([rng.integers(0, top + 5, 100), values[rng.integers(0, n, 100)]])
    want = [next((i for i in range(a, b) if values[i] >= x), b) if b - a < 2000 else int(a + np.searchsorted(values[a:b], x)) for a, b, x in zip(start.tolist(), end.tolist(), asked.tolist())]
    assert seq.successor(start, end, asked).tolist() == want


def test_bits_a_value():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 30, 50_000))
    seq = ngrams.EliasFano.coded(values)
    assert (seq.low.nbytes + seq.high.nbytes) * 8 / len(values) < math.log2((1 << 30) / len(values)) + 3


def test_trie_finds_what_is_there():
    rng = random.Random(1)
    grams = sorted({tuple(rng.choice((rng.randint(0, 5), rng.randint(0, 2**31 - 1))) for _ in range(3)) for _ in range(4000)})
    levels, nodes = [], [{(): 0}]
    for d in (1, 2, 3):
        prefixes = sorted({g[:d] for g in grams})
        nodes.append({p: i for i, p in enumerate(prefixes)})
        marks = np.arange(len(prefixes)).astype(np.uint8)
        levels.append((np.array([nodes[d - 1][p[:-1]] for p in prefixes]), np.array([p[-1] for p in prefixes]), marks, marks[:0]))
    trie = ngrams.Trie.mapped(ngrams.Trie.built(levels))
    asked = grams + [(a, b, c + 1) for a, b, c in grams] + [(a, b + 1, c) for a, b, c in grams] + [(rng.randint(0, 9), 3, 3) for _ in range(100)]
    a, b, c = (np.array(x) for x in zip(*asked))
    one = trie.child(0, np.zeros_like(a), a)
    two = trie.child(1, one, b)
    three = trie.child(2, two, c)
    for d, found in ((1, one), (2, two), (3, three)):
        assert found.tolist() == [nodes[d].get(g[:d], -1) for g in asked]
    assert (trie.marks[2][0][three[three >= 0]] == (three[three >= 0] % 256)).all()


def test_packed_columns():
    columns = [np.array([], np.int64), np.array([0, 0]), np.array([1, 2**40, 255, 256])]
    assert [x.tolist() for x in ngrams.unpack(ngrams.pack(*columns))] == [x.tolist() for x in columns]


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + ["\n"]


def plain(rows, prior):
    grams = [collections.Counter() for _ in range(3)]
    for _, text, learn in rows:
        if learn:
            t = tokens(text)
            for d in range(3):
                grams[d].update(tuple(t[i : i + d + 1]) for i in range(len(t) - d))
    total, distinct = sum(grams[0].values()), len(grams[0])
    rounded = lambda p: 10 ** (-min(254, round(-25 * math.log10(p))) / 25) if p else 0.0
    out = []
    for i, text, learn in rows:
        t, base, score = tokens(text), 0.0, 0.0
        for j, w in enumerate(t):
            p = (grams[0][(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p)
            if j:
                n = grams[0][(t[j - 1],)]
                p = rounded(grams[1][(t[j - 1], w)] / (n + prior[0])) + prior[0] / (n + prior[0]) * p
            if j > 1 and len(prior) > 1:
                n = grams[1][tuple(t[j - 2 : j])]
                p = rounded(grams[2][tuple(t[j - 2 : j + 1])] / (n + prior[1])) + (rounded(prior[1] / (n + prior[1])) if n else 1.0) * p
            score += math.log10(p)
        out.append((i, bool(learn), len(t), sum(grams[0][(w,)] > 0 for w in t), total, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def got(df):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "Straße", "漢字", " x y", "a\x1cb"]
    rows = [(i, rng.choice((" ", "\n", "\t ")).join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 90))), i % 5 != 1) for i in range(200)]
    rows += [(1000 + i, "the same words again and The Same words", True) for i in range(100)]  # a third are copies
    return rows + [(None, "w1 w2 new", True), (7, None, True), (8, "", False), (8, "", False), (9, " \t\n", None), (10, "never seen before", False), (2**60 + 1, "w1 " * 5000, False)]


@pytest.mark.parametrize("prior", [(3.0,), (3.0, 2.0)])
def test_scores_against_dictionaries(spark, monkeypatch, prior):
    monkeypatch.setattr(ngrams, "SHARD", 3000)  # several shards
    rows = corpus()
    scored, model = ngrams.score(docs(spark, rows).repartition(5), F.col("learn"), prior)
    assert got(scored) == plain(rows, prior)
    assert model.count() > 1


@pytest.mark.parametrize("learn", ["true", "false"])
def test_scores_where_all_or_none_are_learnt_from(spark, learn):
    rows = [(1, "a b a b a", learn == "true"), (2, "b a c", learn == "true")]
    assert got(ngrams.score(docs(spark, rows), F.expr(learn))[0]) == plain(rows, ngrams.PRIOR)


def test_empty_corpus(spark):
    assert ngrams.score(docs(spark, []), F.col("learn"))[0].collect() == []


def test_the_model_is_a_distribution(spark):
    """Over all words, the unknown one included, probabilities after a context sum to one but for the rounding."""
    rows = [(i, t, True) for i, t in enumerate(("a b c a b d", "a b c", "b c a"))]
    words = ["a", "b", "c", "d", "\n", "unknown"]
    asked = [(100 + i, f"a b {w}", False) for i, w in enumerate(words) if w != "\n"] + [(200, "a b", False)]
    s = {r.id: r.score for r in ngrams.score(docs(spark, rows + asked), F.col("learn"))[0].collect()}
    heads = s[200]
    per_word = {r.id: r for r in ngrams.score(docs(spark, rows + asked), F.col("learn"))[0].collect()}
    assert len(per_word) == len(s) and heads < 0
    p = plain(rows + asked, ngrams.PRIOR)
    assert got(ngrams.score(docs(spark, rows + asked), F.col("learn"))[0]) == p


def test_words_in_context_are_likelier_than_alone(spark):
    """On held-out rows of the given table the model beats the base distribution."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    learn = F.crc32(F.col("id").cast("string")) % 5 != 1
    held = ngrams.score(rows, learn)[0].filter("NOT learn").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).head()
    assert held[1] > held[0] + 0.02 * held[2]


def test_query_holds_out_by_crc(spark):
    found = ngrams.op12_scores(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in found)
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 5 != 1) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {r[0]: r for r in plain(rows, ngrams.PRIOR)}
    assert all((r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][2:5] and math.isclose(r.base_score, want[r.doc_id][5], abs_tol=1e-5) and math.isclose(r.score, want[r.doc_id][6], abs_tol=1e-5) for r in found)
