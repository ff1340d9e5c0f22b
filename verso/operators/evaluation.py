"""Retrieval metrics of ranked results against expected sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.functions.text import tokens


def holders(docs: DataFrame, items: DataFrame, block: int = 4096) -> DataFrame:
    """``query_id, doc_id`` of documents (``doc_id, text``) that hold the whole ``passage`` of an item (``query_id, passage``).

    The first and the last token of an item may stand inside longer words of a
    document, the others are whole words. So items of seven tokens or more are
    joined on their second to sixth, then verified. Shorter ones, a stated
    query set, meet all documents in blocks of about ``block`` items.
    """
    five = 5
    asked = items.filter("passage is not null").withColumn("_t", tokens(F.col("passage")))
    long_ = asked.filter(F.size("_t") >= five + 2).select("query_id", "passage", F.array_join(F.slice("_t", 2, five), " ").alias("k"))
    words = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("i", "w"))
    # a document can hold an item only where the item's second token stands; the five from there are compared next
    at = words.join(long_.select(F.substring_index("k", " ", 1).alias("w")).distinct(), "w", "left_semi").groupBy("doc_id").agg(F.collect_list("i").alias("at"))
    placed = docs.select("doc_id", tokens(F.col("text")).alias("all")).join(at, "doc_id").select("doc_id", "all", F.explode("at").alias("i"))
    keyed = placed.select("doc_id", F.array_join(F.slice("all", F.col("i") + 1, five), " ").alias("k")).distinct()
    out = keyed.join(long_, "k").join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "passage")).select("query_id", "doc_id")
    short = asked.filter(F.size("_t") < five + 2).select("query_id", "passage")
    blocks = -(-short.count() // block)
    for b in range(blocks):
        part = short.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        out = out.unionByName(docs.join(F.broadcast(part), F.contains("text", "passage")).select("query_id", "doc_id"))
    return out.distinct()


def matches(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Ranked results (``query_id, rank, filename, page_num``) with the first expected source that each meets.

    A null page of an expected source (``query_id, source_id, filename, page_num``) meets every page.
    """
    e = expected.select("query_id", "filename", F.col("page_num").alias("want_page"), "source_id")
    hit = ranked.join(e, ["query_id", "filename"], "left").withColumn("source_id", F.when(F.col("want_page").isNull() | (F.col("want_page") == F.col("page_num")), F.col("source_id")))
    return hit.groupBy("query_id", "rank", "filename", "page_num").agg(F.min("source_id").alias("source_id"))


def metrics(ranked: DataFrame, expected: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Hit rate, reciprocal rank, recall and precision of each question (``query_id, category``).

    Precision divides by k. A question that expects nothing scores 1 if nothing
    was retrieved and 0 otherwise; where ``questions`` has ``refused``, it scores
    1 if the answer refuses and 0 otherwise.
    """
    m = matches(ranked, expected)
    found = F.col("source_id").isNotNull()
    got = m.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.min(F.when(found, F.col("rank"))).alias("first"),
        *[F.count_distinct(F.when(F.col("rank") <= k, F.col("source_id"))).alias(f"c{k}") for k in ks],
        *[F.count_if(found & (F.col("rank") <= k)).alias(f"p{k}") for k in ks],
    )
    want = expected.groupBy("query_id").agg(F.count_distinct("source_id").alias("wanted"))
    row = questions.join(got, "query_id", "left").join(want, "query_id", "left").na.fill(0, ["n", "wanted", *[f"{a}{k}" for a in "cp" for k in ks]])
    none = F.when(F.col("refused") if "refused" in questions.columns else F.col("n") == 0, 1.0).otherwise(0.0)

    def of(value):
        return F.when(F.col("wanted") == 0, none).otherwise(value)

    return row.select(
        "query_id", "category",
        of(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"),
        of(F.coalesce(F.round(1 / F.col("first"), 6), F.lit(0.0))).alias("mrr"),
        *[of(F.round(F.try_divide(F.col(f"c{k}"), F.col("wanted")), 6)).alias(f"recall_{k}") for k in ks],
        *[of(F.round(F.col(f"p{k}") / k, 6)).alias(f"precision_{k}") for k in ks],
    )


def roll_up(scored: DataFrame, by: str = "category") -> DataFrame:
    """Means to three places of each category, and of all together."""
    names = [c for c in scored.columns if c not in ("query_id", by)]
    out = scored.rollup(by).agg(F.count("*").alias("count"), *[F.round(F.avg(c), 3).alias(c) for c in names])
    return out.withColumn(by, F.coalesce(by, F.lit("all")))


def compare(scored: dict[str, DataFrame], value: str) -> DataFrame:
    """One column for each condition, one row a question."""
    rows = reduce(DataFrame.unionByName, [d.select("query_id", F.lit(c).alias("condition"), value) for c, d in scored.items()])
    return rows.groupBy("query_id").pivot("condition", list(scored)).agg(F.max(value))


SET = "id string, question string, category string, expected_sources array<struct<filename:string,page_num:int>>, ground_truth string"


def load_set(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON arrays, with nulls for what a question does not have."""
    return spark.read.schema(SET).json(path, multiLine=True)


def resolved(expected: DataFrame, docs: DataFrame) -> DataFrame:
    """Expected sources with the ids of the documents of their names; names that no document has fall out."""
    return expected.join(docs.select("filename", "doc_id"), "filename")


def refusals(scored: DataFrame, *by: str) -> DataFrame:
    """Of each group: questions, mean score to three places, share of refusals, and answerable questions refused despite a hit.

    ``scored`` has ``category, refused, hit_rate``. A negative question scores 1
    if it is refused, else 0; others score their hit rate.
    """
    negative = F.col("category") == "negative"
    score = F.when(negative, F.col("refused").cast("double")).otherwise(F.col("hit_rate"))
    despite = ~negative & F.col("refused") & (F.col("hit_rate") == 1)
    return scored.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.round(F.round(F.avg(score), 6), 3).alias("score"),
        F.round(F.round(F.avg(F.col("refused").cast("double")), 6), 3).alias("refusal_rate"),
        F.count_if(despite).alias("refused_despite_hit"),
        F.count_if(~negative).alias("answerable"),
    )


def write_report(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)
