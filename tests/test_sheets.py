"""Packing of sheets that span tasks against the array form."""

import random

import pytest
from pyspark.sql import functions as F

from verso.operators import chunking


@pytest.mark.parametrize(("slice_", "most"), [(4096, 200), (50, 50), (64, 60)])
def test_sheets_are_packed_as_arrays_are(spark, monkeypatch, slice_, most):
    monkeypatch.setattr(chunking, "SLICE", slice_)
    rng = random.Random(1)
    rows = [(sheet, i, "x" * (rng.randint(300, 400) if rng.random() < 0.02 else rng.randint(0, 9)), None if rng.random() < 0.1 else f"a|{i}") for sheet, n in (("big", 2500), ("one", 1), ("", 130), (None, 0), ("mid", 401)) for i in range(n)]
    df = spark.createDataFrame(rows, "sheet string, i int, a string, b string").repartition(7)
    got = chunking.pack_sheets(df, "sheet", ["i"], F.array("a", F.coalesce("b", F.lit(""))), ["h1", "h2"], most=most)
    arrays = df.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("i", F.array("a", F.coalesce("b", F.lit(""))).alias("c")))).alias("r"))
    packed = chunking.pack_rows(F.array(F.lit("h1"), F.lit("h2")), F.transform("r", lambda x: x["c"]), sheet=F.col("sheet"), most=most)
    want = arrays.select("sheet", F.posexplode(packed).alias("chunk_index", "text"))
    assert sorted(map(tuple, got.select("sheet", "chunk_index", "text").collect())) == sorted(map(tuple, want.collect()))


def test_no_rows_make_no_chunks(spark):
    df = spark.createDataFrame([], "sheet string, i int, a string")
    assert chunking.pack_sheets(df, "sheet", ["i"], F.array("a"), ["h"]).count() == 0
