"""Streaming jobs: incremental dashboards and ingestion with deduplication."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from verso.operators.observability import limit_key
from verso.operators.store import ChunkStore
from verso.operators.store import ingest as ingest_batch
from verso.session import shared_dir


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests and mean value of each hour of a stream; state older than the watermark goes."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("count"), F.round(F.round(F.avg("value"), 6), 1).alias("avg_value")).select(F.col("window.start").alias("hour"), "count", "avg_value")


def dropbox(spark: SparkSession, folder: str, remove: bool = False) -> DataFrame:
    """Uploaded files as a stream; with ``remove`` each is deleted once a later batch has begun, whether or not it could be parsed."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    return (files.option("cleanSource", "delete") if remove else files).load(folder)


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of files; a table that is one file is streamed from its folder by name."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    return spark.readStream.schema(schema).parquet(path) if folder else spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly dashboard of all events that are there, each hour's last state."""
    last = last_states(hourly(_source(spark, sf_dir, "events")), ["hour"])
    return last.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def last_states(updates: DataFrame, key: list[str], trigger: str = "availableNow") -> DataFrame:
    """Runs a stream of updates over all that is there; the last state of each key. A batch that comes again overwrites itself."""
    spark, values = updates.sparkSession, [c for c in updates.columns if c not in key]
    out, state = shared_dir(spark, "stream-updates"), shared_dir(spark, "stream-state")

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{out}/b{batch_id}")

    updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(**{trigger: True}).start().awaitTermination()
    spark.createDataFrame([], StructType([*updates.schema, StructField("batch", LongType())])).write.parquet(f"{out}/empty")
    done = spark.read.schema(StructType([*updates.schema, StructField("batch", LongType())])).option("recursiveFileLookup", "true").parquet(out)
    return done.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("s")).select(*key, "s.*")


def limited(requests: DataFrame, limit: int = 20, unit: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Requests of each key (``key, at``) in each fixed window of a stream, and how many are over the limit; old windows go."""
    n = requests.withWatermark("at", late).groupBy(F.window("at", unit), "key").agg(F.count("*").alias("requests"))
    return n.select(F.col("window.start").alias("start"), "key", "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("rejected"))


def run_limits(spark: SparkSession, sf_dir: str, limit: int = 2, unit: str = "1 hour") -> DataFrame:
    at = _source(spark, sf_dir, "events").select(limit_key(F.col("user_id"), F.lit("unknown")).alias("key"), F.col("ts").cast("timestamp").alias("at"))
    return last_states(limited(at, limit, unit), ["start", "key"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def remembered(turns: DataFrame, keep: int = 6) -> DataFrame:
    """The last ``keep`` turns of each session of a stream as state: ``conv_id, turns`` (turn numbers), ``texts``, after each batch.

    Turns may come in any order; the state holds no more than ``keep`` of a session.
    """

    def step(key, batches, state):
        held = list(zip(*state.get)) if state.exists else []
        for b in batches:
            held = sorted(held + list(zip(b["turn"], b["text"])), key=lambda x: x[0])[-keep:]
        numbers, texts = [int(n) for n, _ in held], [t for _, t in held]
        state.update((numbers, texts))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [numbers], "texts": [texts]})

    kept = "turns array<long>, texts array<string>"
    said = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return said.groupBy("conv_id").applyInPandasWithState(step, f"conv_id long, {kept}", kept, "update", "NoTimeout")


class LastTurns(StatefulProcessor):
    """The last turns of a session as list state; a session that has been idle for ``idle`` milliseconds leaves the state."""

    def __init__(self, keep: int, idle: int):
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # twice the limit, should a timer not have been set
        self.turns = handle.getListState("turns", "turn long, text string", 2 * self.idle)

    def handleInputRows(self, key, rows, timerValues):
        held = list(self.turns.get()) if self.turns.exists() else []
        for b in rows:
            held = sorted(held + list(zip(b["turn"].tolist(), b["text"])), key=lambda x: x[0])[-self.keep :]
        self.turns.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[int(n) for n, _ in held]], "texts": [[t for _, t in held]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.turns.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession):
    """While streams are started that keep state in several variables with timers, which the default store cannot hold."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remembered_for(turns: DataFrame, keep: int = 6, idle: int = 3_600_000) -> DataFrame:
    """As :func:`remembered`, but sessions leave the state ``idle`` milliseconds after their last turn; start it within :func:`keyed_state`.

    Timers ask for one more batch for ever, so such a stream ends with its
    trigger ``once`` and not with ``availableNow``.
    """
    said = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return said.groupBy("conv_id").transformWithStateInPandas(LastTurns(keep, idle), "conv_id long, turns array<long>, texts array<string>", "Update", "ProcessingTime")


def run_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    with keyed_state(spark):
        return last_states(remembered_for(_source(spark, sf_dir, "conversations")), ["conv_id"], "once")


def run_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_states(remembered(_source(spark, sf_dir, "conversations")), ["conv_id"])


def ingest(stream: DataFrame, registry: str, checkpoint: str):
    """Append documents whose content is new to the registry table; replays of a batch overwrite it."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema("doc_id long, file_hash string, batch long").option("recursiveFileLookup", "true").parquet(registry).filter(F.col("batch") < batch_id)
        first = batch.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash")).groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
        fresh = first.join(known.select("file_hash"), "file_hash", "left_anti").select("doc_id", "file_hash", F.lit(batch_id).cast("long").alias("batch"))
        fresh.write.mode("overwrite").parquet(f"{registry}/b{batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_pages(stream: DataFrame, store: ChunkStore, checkpoint: str, source: str = "stream", **sizes: int):
    """Parse, chunk, embed and index pages as they come: a batch becomes one version of the store, once.

    Pages whose content (``file_hash``) a document holds already, or a smaller
    ``doc_id`` of the same batch, are left out. The number of the batch is part
    of the version that it makes: where a job dies after that, the batch that
    comes again finds its number and changes nothing; where it dies before, no
    reader has seen any of it.
    """

    def put(batch: DataFrame, number: int) -> None:
        if store.manifest.state().get("batches", {}).get(source, -1) >= number:
            return
        first = batch.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
        fresh = first.join(store.held(first), "file_hash", "left_anti").select("doc_id", "file_hash")
        # a task holds the digests of what is new, and texts pass it unsorted
        ingest_batch(store, batch.join(fresh.hint("shuffle_hash"), ["doc_id", "file_hash"], "left_semi"), batch=(source, number), **sizes)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_pages(docs: DataFrame) -> DataFrame:
    """Documents as pages to ingest, one each."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("source", F.lit("")).alias("filename"), F.lit(1).alias("page_num"), text.alias("text"), F.array().cast("array<string>").alias("tables"), F.lit(None).cast("string").alias("error"), F.sha2(text, 256).alias("file_hash"))


def run_store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """A store that all documents have come to as a stream."""
    store = ChunkStore(spark, shared_dir(spark, "stream-store"))
    ingest_pages(document_pages(_source(spark, sf_dir, "documents")), store, shared_dir(spark, "stream-state")).awaitTermination()
    return store


def run_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after all documents have come as a stream."""
    registry, state = shared_dir(spark, "stream-registry"), shared_dir(spark, "stream-state")
    spark.createDataFrame([], "doc_id long, file_hash string, batch long").write.parquet(f"{registry}/empty")
    ingest(_source(spark, sf_dir, "documents"), registry, state).awaitTermination()
    return spark.read.schema("doc_id long, file_hash string, batch long").option("recursiveFileLookup", "true").parquet(registry).drop("batch")
