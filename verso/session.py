"""Session settings that the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only where none is set and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:  # the setting itself cannot be changed in a running session
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="verso-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """While tables are written whose Python steps shall get no more than so many rows in one Arrow batch: a batch is held
    whole on both sides, and by default takes all that a task reads, up to 10,000 rows however large they are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    own = int(before)
    spark.conf.set(name, min(rows, own) if own > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def bytes_at_once(spark: SparkSession, size: str) -> Iterator[None]:
    """As :func:`rows_at_once`, but a batch ends where its values have so many bytes: rows of long texts come few at once,
    and small ones many."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is made once, and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session(app: str = "verso", master: str | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; sizes of shuffles are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
