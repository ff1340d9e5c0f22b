"""Chat sessions from turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def history(turns: DataFrame, n: int = 6) -> DataFrame:
    """Every turn with the ``n`` turns before it, oldest first."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(before))


def summaries(turns: DataFrame, title: int = 30) -> DataFrame:
    """One row a session: number of messages and a title from its first question."""
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"]
    return turns.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.substring(first, 1, title).alias("title"))


def replace(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored turns with the sessions in ``changed`` replaced as wholes."""
    return stored.join(changed.select("conv_id").distinct(), "conv_id", "left_anti").unionByName(changed)
