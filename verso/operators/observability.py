"""Request logs: dashboards and rate limits."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

STAGES = ("preprocessing_ms", "retrieval_ms", "rerank_ms", "generation_ms", "total_ms")


def hourly_latency(logs: DataFrame, at: str, values: list[str], as_of: str, days: int = 7) -> DataFrame:
    """Requests and mean latencies (one decimal, nulls left out) of each hour of the last ``days``, at most 30; nested fields by their path."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {min(days, 30)} DAYS")
    hour = F.date_format(F.date_trunc("hour", F.col(at)), "yyyy-MM-dd'T'HH:00:00")
    return logs.filter(F.col(at) >= since).groupBy(hour.alias("hour")).agg(F.count("*").alias("count"), *[F.round(F.round(F.avg(v), 6), 1).alias(f"avg_{v.split('.')[-1]}") for v in values])


def summary(logs: DataFrame, at: str, value: str, flag: Column, as_of: str) -> DataFrame:
    """Requests, flagged requests and mean latency of the last day; the mean is null if there are none."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    return logs.filter(F.col(at) >= since).agg(F.count("*").alias("requests"), F.count_if(flag).alias("flagged"), F.round(F.round(F.avg(value), 6), 1).alias(f"avg_{value}"))


def ocr_rates(docs: DataFrame) -> DataFrame:
    """Failure rate of each document (``doc_id, needing, failed``) that needed recognition, worst first."""
    return docs.filter("needing > 0").select("doc_id", "needing", "failed", F.round(F.col("failed") / F.col("needing"), 3).alias("failure_rate")).orderBy(F.desc("failure_rate"), "doc_id")


def ocr_totals(docs: DataFrame) -> DataFrame:
    total = docs.agg(F.sum("needing").alias("needing"), F.sum("failed").alias("failed"))
    return total.withColumn("failure_rate", F.round(F.try_divide("failed", "needing"), 3))


def rejections(requests: DataFrame, key: str, at: str, tie: str, limit: int, unit: str = "minute") -> DataFrame:
    """Requests beyond the limit of their key in a fixed window."""
    order = W.partitionBy(key, F.date_trunc(unit, F.col(at))).orderBy(at, tie)
    return requests.withColumn("place", F.row_number().over(order)).filter(F.col("place") > limit)


def log_requests(requests: DataFrame, folder: str, enabled: bool = True) -> bool:
    """Append a batch of requests to the log. A log that cannot be written is a warning: it must not stop the answers."""
    if not enabled:
        return False
    try:
        requests.write.mode("append").parquet(folder)
    except (PySparkException, Py4JError) as e:
        log.warning("requests were not logged: %s", e)
        return False
    return True


def limit_key(user: Column, address: Column) -> Column:
    """Requests count for their user, and for their address where there is none."""
    return F.coalesce(F.concat(F.lit("user:"), user.cast("string")), address)
