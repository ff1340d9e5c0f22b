"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.session import bytes_at_once, shared_dir

#: Words are maximal runs of code points other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys are counted in so many hashed bins to see which of them are hot.
BINS = 1 << 14
#: Bits of a bitmap of hashed keys: 4 MB.
FILTER_BITS = 1 << 25
#: Bytes of one batch that a Python step of a stored table gets.
BATCH = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing.

    Python steps on the way get batches of ``BATCH`` bytes, which both sides hold whole."""
    path = shared_dir(df.sparkSession, label)
    with bytes_at_once(df.sparkSession, BATCH):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, no more than so many at once: what is made of them in Python stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once and only where it is needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_words(text: Column) -> Column:
    """Words of a text, null counting as empty."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).cast("long"), F.lit(0).cast("long"))


def even_join(left: DataFrame, right: DataFrame, key: str, by: tuple[str, ...], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Join on the column ``key`` of both, where one key may hold much of ``left``.

    Rows of ``left`` are counted by ``BINS`` hashed bins of their key, which
    bounds what comes to the driver. A bin with more rows than a shuffle
    partition has on average is dealt by the columns ``by`` to as many tasks as
    it fills, and the rows of ``right`` in that bin are repeated for each.
    ``how`` is a join that keeps rows of ``left`` only. ``counted`` has the
    keys of ``left``, where those are cheaper to read elsewhere.
    """
    counted = left if counted is None else counted
    place = F.pmod(F.xxhash64(key), F.lit(BINS)).cast("int")
    sizes = counted.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    seen = sizes.agg(F.sum("n").alias("rows"), F.collect_list(F.when(F.col("n") > 256, F.struct("bin", "n"))).alias("full")).first()
    share = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) / (seen["rows"] or 1)
    parts = {r["bin"]: math.ceil(r["n"] * share) for r in seen["full"] if r["n"] * share > 1}
    if not parts:
        return left.join(right, key, how)
    # only the full bins are named, fewer than there are partitions: the plans of all queries stay in the driver's memory as text
    bins, many = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>") for x in (parts, parts.values()))
    dealt_to = F.coalesce(F.try_element_at(F.map_from_arrays(bins, many), place), F.lit(1))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*by), dealt_to).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), dealt_to - 1)))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def flagged(rows: DataFrame, wanted: DataFrame, key: str, flag: str = "likely") -> DataFrame:
    """``rows`` with a column that is true where the key may be in ``wanted``: for all that are, and few others.

    A bitmap of hashed keys goes to all tasks: ``FILTER_BITS`` bits at most,
    however many keys. When it fills up, more rows are flagged; none is missed.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    piece, word, place = F.floor(bit / 4096).cast("int"), F.pmod(F.shiftright(bit, 6), F.lit(64)).cast("int"), F.pmod(bit, F.lit(64)).cast("int")
    words = wanted.groupBy(piece.alias("_piece"), word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    pieces = words.groupBy("_piece").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"))
    pieces = pieces.select("_piece", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit(0).cast("long"))).alias("_bitmap"))
    is_set = F.coalesce(F.getbit(F.get("_bitmap", word), place) == 1, F.lit(False))
    return rows.join(F.broadcast(pieces), piece == F.col("_piece"), "left").withColumn(flag, is_set).drop("_piece", "_bitmap")


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The flagged rows alone, so that a join with ``wanted`` shuffles less."""
    return flagged(rows, wanted, key, "_likely").filter("_likely").drop("_likely")


def with_few(rows: DataFrame, few: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    """Left join of ``rows`` with a table that has few of their keys, each once: rows of other keys are not shuffled."""
    seen = flagged(rows, few, key, "_seen")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in few.schema if f.name != key]
    names = [*rows.columns, *(c for c in few.columns if c != key)]
    found = even_join(seen.filter("_seen").drop("_seen"), few, key, by, "left", counted=likely(rows.select(key), few, key))
    return seen.filter("not _seen").select(*rows.columns, *rest).unionByName(found.select(*names))
