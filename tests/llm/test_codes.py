"""Vector codes against plain Lloyd rounds over all pairs of parts and entries."""

import hashlib
import math

import numpy as np
import pytest

from verso.llm import codes


def plain(vectors, entries=64, rounds=2):
    """Codes, errors and entries of ``(id, vector)`` by whole distance tables in Python integers."""
    kept = sorted(((i, v) for i, v in vectors), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v in kept), default=0) // 16)
    parts = [[[math.floor(256 * x) for x in (*v, *[0.0] * (16 * width - len(v)))][p * width : (p + 1) * width] for _, v in kept] for p in range(16)]
    books = [part[:entries] for part in parts]

    def nearest(part, book):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book)) for x in part]

    for _ in range(rounds):
        for p in range(16):
            of = {}
            for x, (_, e) in zip(parts[p], nearest(parts[p], books[p])):
                of.setdefault(e, []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*of[e])] if e in of else b for e, b in enumerate(books[p])]
    found = [nearest(parts[p], books[p]) for p in range(16)]
    rows = [(i, "".join(f"{found[p][j][1]:02x}" for p in range(16)), sum(found[p][j][0] for p in range(16))) for j, (i, _) in enumerate(kept)]
    return rows, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_filtering_finds_the_nearest_entries(seed):
    rng = np.random.default_rng(seed)
    width, n, k = int(rng.integers(1, 6)), int(rng.choice([1, 7, 100, 3000])), int(rng.choice([1, 2, 17, 64]))
    points = rng.integers(-9, 9, (n, width))  # many ties
    points[: n // 3] = points[0]  # a third of all points are equal
    book = rng.integers(-9, 9, (k, width))
    book[k // 2] = book[0]
    tree = codes.Tree.unpacked(n, width, codes.Tree.grown(points).packed())
    found, counts, sums = tree.nearest(book)
    want = ((tree.points[:, None] - book) ** 2).sum(2).argmin(1)
    assert (found == want).all() and (tree.points == points[tree.order]).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    assert all((sums[e] == tree.points[want == e].sum(0)).all() for e in range(k))


def test_boxes_settle_whole_subtrees():
    points = np.concatenate([np.full((4000, 2), v) + np.random.default_rng(1).integers(0, 20, (4000, 2)) for v in (-1000, 0, 1000)])
    tree, looked = codes.Tree.grown(points), []
    spread = codes.spread
    codes.spread = lambda a, b: looked.append(int((b - a).sum())) or spread(a, b)
    try:
        found, _, _ = tree.nearest(np.array([[-990, -990], [10, 10], [1010, 1010]]))
    finally:
        codes.spread = spread
    assert sum(looked) == 12000 and looked[-1] < 100 or len(looked) <= tree.depth  # hardly a point is looked at alone
    assert sorted(np.bincount(found).tolist()) == [4000, 4000, 4000]


def test_codes_against_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(150)] + [(5, vectors[7][1]), (2**60 + 1, vectors[9][1])]  # a hot vector, a repeated id
    odd = [(7001, None), (7002, [float("nan")] + [0.0] * 63), (7003, [float("inf")] * 64), (7004, [None] + [1.0] * 63)]
    df = spark.createDataFrame([(i, j % 5 if j % 3 else None, v, "x", "y") for j, (i, v) in enumerate(vectors + odd)], "id long, label int, vector array<float>, n string, trees string").repartition(5)
    monkeypatch.setattr(codes, "BLOCK", 64 * 50)  # several blocks a partition
    books, out = codes.compress(df)
    want, digest = plain(vectors)
    got = sorted((r.id, bytes(r.code).hex(), r.error) for r in out.collect())
    assert got == sorted(want) and books.sha256() == digest


def test_short_ragged_and_empty_vectors(spark):
    rows = [(3, [1.0, 2.0]), (1, [0.5] * 17), (None, [-0.001]), (2, []), (2, [])]
    df = spark.createDataFrame([(i, "a", v) for i, v in rows], "id long, label string, vector array<double>")
    books, out = codes.compress(df)
    want, digest = plain(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.id, bytes(r.code).hex(), r.error) for r in out.collect()), key=key) == sorted(want, key=key) and books.sha256() == digest
    assert codes.compress(df.filter("false"))[1].count() == 0
    assert [(bytes(r.code), r.error) for r in codes.compress(df.filter("size(vector) = 0"))[1].collect()] == [(bytes(16), 0)] * 2


def test_label_errors(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 2, [float(i % 7), float(i)] * 32, "z") for i in range(200)], "vec_id long, label int, embedding array<float>, key string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = codes.op13_codes(spark, str(tmp_path)).collect()
    total = {}
    for r in rows:
        label = None if r.vec_id % 3 == 0 else r.vec_id % 2
        total[label] = total.get(label, 0) + r.error
    assert len(rows) == 200 and all(r.label_error == total[None if r.vec_id % 3 == 0 else r.vec_id % 2] for r in rows)
