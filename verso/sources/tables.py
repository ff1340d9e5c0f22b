"""Views of the tables as chunks, questions, logs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.functions.patterns import DEPARTMENTS, STATUSES, TYPES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, with_file: bool = False) -> DataFrame:
    """Each document as a chunk, with metadata derived from its id, and the file it is in if that is asked for."""
    return as_chunks(read(spark, sf_dir, "documents"), with_file)


def as_chunks(docs: DataFrame, with_file: bool = False) -> DataFrame:
    """Rows of ``doc_id, source, text`` as chunks."""
    file = [F.col("_metadata.file_path").alias("file")] if with_file else []

    def pick(values, by: int):
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod("doc_id", F.lit(by)).cast("int"))

    return docs.select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(1).alias("page_num"), F.lit(0).alias("chunk_index"), F.col("source").alias("filename"), "text",
        pick(("", *DEPARTMENTS), 13).alias("department"), pick(STATUSES, 4).alias("document_status"), pick(TYPES, 5).alias("document_type"), *file,
    )


def with_vectors(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, with the vector of the same number where there is one."""
    vec = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).join(vec, "query_id", "left")
