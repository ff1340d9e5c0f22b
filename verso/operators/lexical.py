"""BM25 retrieval over tables.

Statistics are those of the whole corpus and are never filtered; filters apply
to what is scored. Only the postings of the questions' terms are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.functions.text import tokens
from verso.operators.predicates import readable
from verso.session import stored

K1, B, EPSILON = 1.5, 0.75, 0.25


def statistics(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term, df, idf`` of the corpus and one row ``n, avgdl``.

    A negative idf becomes ``EPSILON`` times the mean over all terms, negatives
    included.
    """
    own = chunks.select(F.size(tokens(F.col("text"))).alias("dl"))
    corpus = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = chunks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(corpus)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf")), corpus


def asked_terms(questions: DataFrame) -> DataFrame:
    """``query_id, term, qn``: how often each question asks for each term."""
    return questions.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))


def weight(avgdl: Column) -> Column:
    return F.col("qn") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))


def rank_hits(hit: DataFrame, part: Column) -> DataFrame:
    return hit.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("bm25_score"))


def allowed(hit: DataFrame, questions: DataFrame) -> DataFrame:
    """The hits that the user of each question may read, if questions carry ``user_department`` and ``is_admin``."""
    if "user_department" not in questions.columns or "department" not in hit.columns:
        return hit
    users = questions.select("query_id", "user_department", "is_admin")
    return hit.join(users, "query_id").filter(readable(F.col("user_department"), F.col("is_admin")))


def scores(chunks: DataFrame, questions: DataFrame, keep: Column | None = None) -> DataFrame:
    """``query_id, chunk_id, bm25_score`` of every chunk that has a term of the question.

    ``keep`` filters what is scored, after the statistics, and so does the
    access of users. Repeated terms of a question count again; scores are
    rounded to six places before ranking. Without a stored index the corpus is
    read anew: for many searches use :class:`verso.operators.index.KeywordIndex`.
    """
    terms, corpus = statistics(chunks)
    asked = asked_terms(questions).join(terms, "term")
    row = chunks if keep is None else chunks.filter(keep)
    dept = [c for c in ("department",) if c in chunks.columns]
    post = row.select("chunk_id", *dept, tokens(F.col("text")).alias("all")).select("chunk_id", *dept, F.size("all").alias("dl"), F.explode("all").alias("term"))
    post = post.join(asked.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", *dept, "term", "dl").agg(F.count("*").alias("tf"))
    hit = allowed(post.join(asked, "term"), questions).join(F.broadcast(corpus.select("avgdl")))  # one row
    return rank_hits(hit, weight(F.col("avgdl")))


def top(scored: DataFrame, k: int, score: str = "bm25_score", rank: str = "bm25_rank") -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def search(chunks: DataFrame, questions: DataFrame, k: int = 20, keep: Column | None = None) -> DataFrame:
    return top(scores(chunks, questions, keep), k)


def search_padded(chunks: DataFrame, questions: DataFrame, k: int = 20, index=None) -> DataFrame:
    """As :func:`search`, filled up to ``k`` with chunks of score zero in corpus order.

    A zero ranks above a negative score. Only questions with fewer than ``k``
    positive scores are filled, and only of these all scores are made: from the
    first chunks, ``k`` more than any of them has scored, so that ``k`` unscored
    ones are among them. ``index`` is a stored index of the chunks. What is
    found is read several times, so it is written once.
    """
    found = stored(search(chunks, questions, k) if index is None else index.search(questions, k), "padded-found")
    up = found.groupBy("query_id").agg(F.count_if(F.col("bm25_score") > 0).alias("up"))
    needy = questions.join(up.filter(F.col("up") >= k), "query_id", "left_anti")
    every = stored(scores(chunks, needy) if index is None else index.scores(needy), "padded-every")
    many = needy.select("query_id").join(every.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").na.fill(0, ["n"])
    deepest = many.agg(F.max("n")).first()[0] or 0
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(k + deepest).withColumn("place", F.row_number().over(W.orderBy("chunk_id")))
    fill = many.select("query_id", F.explode(F.sequence(F.lit(1), (F.col("n") + k).cast("int"))).alias("place")).join(first, "place").drop("place")
    fill = fill.join(every.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("bm25_score", F.lit(0.0))
    names = ["query_id", "chunk_id", "bm25_score"]
    full = found.join(needy.select("query_id"), "query_id", "left_anti").select(names)
    return top(full.unionByName(every.select(names)).unionByName(fill.select(names)), k)
