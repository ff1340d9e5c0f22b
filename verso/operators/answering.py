"""From questions to answers with sources, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.operators import fusion
from verso.operators.guardrails import input_reason, sanitize, unverified
from verso.operators.index import KeywordIndex
from verso.operators.models import embed, extractive_answer, overlap_score
from verso.operators.planner import plan
from verso.operators.predicates import readable
from verso.session import stored


def rerank(found: DataFrame, prior: str, k: int = 3, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The best ``k`` of each question by a score of question and text; ties keep the prior rank."""
    row = found.withColumn("rerank_score", score(F.col("question"), F.col("text")))
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), prior)
    return row.withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= k)


def first_chunks(chunks: DataFrame, doc_ids: DataFrame, limit: int = 10, order: str = "reference") -> DataFrame:
    """The first chunks of documents (``query_id, doc_id``): by chunk then page number, or by page first."""
    by = ("chunk_index", "page_num") if order == "reference" else ("page_num", "chunk_index")
    row = doc_ids.join(chunks, "doc_id").withColumn("score", F.lit(1.0))
    place = W.partitionBy("query_id", "doc_id").orderBy(*by)
    return row.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)


def sources(found: DataFrame, rank: str) -> DataFrame:
    """Distinct documents and pages in the order in which they first appear: ``query_id, sources``."""
    one = found.groupBy("query_id", "doc_id", "page_num").agg(F.min(rank).alias("r"))
    listed = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "doc_id", "page_num"))).alias("s"))
    return listed.select("query_id", F.transform("s", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["page_num"].alias("page_num"))).alias("sources"))


def contexts(found: DataFrame, rank: str, separator: str = "\n\n") -> DataFrame:
    """Texts of each question joined in rank order: ``query_id, context``."""
    block = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col("text"))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("t")))).alias("s"))
    return listed.select("query_id", F.array_join(F.transform("s", lambda x: x["t"]), separator).alias("context"))


def candidates(asked: DataFrame, chunks: DataFrame, strategy: str = "hybrid", keep: Column | None = None, index: KeywordIndex | None = None, embed_query: Callable[[Column], Column] = embed) -> DataFrame:
    """``query_id, chunk_id, prior``: what is found for planned questions (``query_id, question, query_vector, plan``), in prior order.

    A question with parts is asked part by part; a chunk counts with its best
    score and the best 15 stay. Any other is asked once, by keywords as it
    stands and by the vector of its rewritten form, if there is one.
    """
    rank, by = ("fusion_rank", "rrf_score") if strategy == "hybrid" else ("vector_rank", "vector_score")
    several = F.size("plan.sub_queries") > 1
    vector = F.when(F.col("plan.rewritten_query").isNotNull(), embed_query(F.coalesce("plan.rewritten_query", F.lit(""))).cast("array<float>")).otherwise(F.col("query_vector").cast("array<float>"))
    once = fusion.retrieve(strategy, chunks, asked.filter(~several).withColumn("query_vector", vector), keep=keep, index=index)
    once = once.select("query_id", "chunk_id", F.col(rank).cast("int").alias("prior"))
    parts = asked.filter(several).select("*", F.posexplode("plan.sub_queries").alias("sub_id", "part"))
    parts = parts.withColumn("query_vector", embed_query(F.col("part")).cast("array<float>")).withColumn("question", F.col("part")).withColumn("key", F.concat_ws("/", F.col("query_id").cast("string"), "sub_id"))
    keyed = parts.withColumnRenamed("query_id", "asked_by").withColumnRenamed("key", "query_id")
    found = fusion.retrieve(strategy, chunks, keyed, keep=keep, index=index).select(F.col("query_id").alias("key"), "chunk_id", F.col(by).alias("part_score"))
    merged = fusion.merge_subqueries(found.join(parts.select("key", "query_id", "sub_id"), "key").drop("key"), "part_score")
    return once.unionByName(merged.select("query_id", "chunk_id", F.col("merged_rank").cast("int").alias("prior")))


def answer(questions: DataFrame, chunks: DataFrame, strategy: str = "hybrid", generate: Callable[[Column, Column], Column] = extractive_answer, keep: Column | None = None, index: KeywordIndex | None = None, guard_input: bool = True, guard_retrieval: bool = True, guard_output: bool = True, embed_query: Callable[[Column], Column] = embed) -> DataFrame:
    """``query_id, reason, query_type, answer, finish_reason, sources, unverified_citations, sanitized_chunks, citation_warning`` of every question.

    ``questions`` has ``query_id, question, query_vector, doc_id, has_history``
    and the user's ``user_department, is_admin``; without these the user is
    unknown and sees open chunks alone. Columns ``plan_reply``,
    ``rewrite_reply`` and ``decompose_reply`` carry what a planning model has
    said of a question; rewritten questions and parts get their vectors from
    ``embed_query``. ``keep`` filters chunks. What a user
    may not read is as if it were not there, on every path.
    Blocked questions end with their reason; a summary without a document is
    NO_DOC, one of a document without chunks EMPTY_DOC, a question without hits
    NO_DOCS. Each guard can be switched off; where it is off, or a question ends
    early, its columns have their defaults (no citations, 0 chunks, no warning).
    """
    if "user_department" not in questions.columns:
        questions = questions.withColumns({"user_department": F.lit(None).cast("string"), "is_admin": F.lit(False)})
    if "department" not in chunks.columns:
        chunks = chunks.withColumn("department", F.lit(""))
    q = questions.withColumn("reason", input_reason(F.col("question")) if guard_input else F.lit(None).cast("string"))
    said = [F.col(c) if c in questions.columns else None for c in ("plan_reply", "rewrite_reply", "decompose_reply")]
    q = q.withColumn("plan", plan(F.col("question"), F.coalesce("has_history", F.lit(False)), *said)).withColumn("query_type", F.col("plan.query_type"))
    open_ = q.filter("reason is null")
    summary, asked = open_.filter("plan.bypass_retrieval"), open_.filter("not plan.bypass_retrieval")
    told_of = summary.filter("doc_id is not null").select("query_id", "doc_id", "user_department", "is_admin")
    mine = chunks if keep is None else chunks.filter(keep)
    seen = told_of.join(mine, "doc_id").filter(readable(F.col("user_department"), F.col("is_admin")))
    place = W.partitionBy("query_id", "doc_id").orderBy("chunk_index", "page_num")
    ours = seen.withColumn("place", F.row_number().over(place)).filter("place <= 10").select("query_id", "chunk_id", "doc_id", "page_num", "text", F.col("place").alias("rank"))
    hits = stored(candidates(asked, chunks, strategy, keep, index, embed_query), "answer-hits")  # few rows, which go to the chunks
    hits = hits.join(chunks, "chunk_id").join(asked.select("query_id", "question"), "query_id")
    theirs = rerank(hits, "prior").select("query_id", "chunk_id", "doc_id", "page_num", "text", F.col("rerank_rank").alias("rank"))
    found = ours.unionByName(theirs)
    found = sanitize(found) if guard_retrieval else found.withColumns({"sanitized": F.lit(False), "substrings_redacted": F.lit(0)})
    found = stored(found, "answer-found")  # read three times
    touched = found.groupBy("query_id").agg(F.count_if("sanitized").alias("sanitized_chunks"))
    told = q.join(contexts(found, "rank"), "query_id", "left").join(touched, "query_id", "left").na.fill(0, ["sanitized_chunks"]).join(sources(found, "rank"), "query_id", "left")
    end = (
        F.when(F.col("reason").isNotNull(), "BLOCKED")
        .when(F.col("plan.bypass_retrieval") & F.col("doc_id").isNull(), "NO_DOC")
        .when(F.col("context").isNull() & F.col("plan.bypass_retrieval"), "EMPTY_DOC")
        .when(F.col("context").isNull(), "NO_DOCS")
        .otherwise("STOP")
    )
    told = told.withColumn("finish_reason", end).withColumn("answer", F.when(F.col("finish_reason") == "STOP", generate(F.col("question"), F.col("context"))))
    cited = unverified(F.col("answer"), F.col("context")) if guard_output else F.array().cast("array<string>")
    told = told.withColumn("unverified_citations", cited).withColumn("citation_warning", F.size("unverified_citations") > 0)
    return told.select("query_id", "reason", "query_type", "answer", "finish_reason", "sources", "unverified_citations", "sanitized_chunks", "citation_warning")


def prompt(question: Column, context: Column) -> Column:
    """What a generator is asked: the blocks of the context, then the question. Fixed wording."""
    return F.concat(F.lit("[TÀI LIỆU THAM KHẢO]\n\n"), F.coalesce(context, F.lit("")), F.lit("\n\n---\n\nCâu hỏi: "), F.coalesce(question, F.lit("")), F.lit("\n\nCâu trả lời:"))


def messages(history: Column, asked: Column) -> Column:
    """Turns for a generator (``role, text``): all but the user's are the model's; the prompt comes last."""
    said = F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,text:string>>")), lambda m: F.struct(F.when(m["role"] == "user", "user").otherwise("model").alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))
    return F.concat(said, F.array(F.struct(F.lit("user").alias("role"), asked.alias("text"))))
