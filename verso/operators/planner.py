"""Rule-based planning of questions, and decoding of what a planning model says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verso.functions.patterns import COMPARISON, REFERENTIAL, SUMMARY
from verso.functions.text import word_count

SHORT, LONG = 8, 20


def _one_of(words) -> str:
    return r"(?iu)(?U:\b)(" + "|".join(words) + r")(?U:\b)"


def fast_path(question: Column, has_history: Column) -> Column:
    """``query_type, bypass_retrieval, source``: summary, simple, or left to a planning model."""
    words = word_count(question)
    summary = question.rlike("(?iu)" + "|".join(SUMMARY))
    ask = question.rlike(_one_of(REFERENTIAL)) | (has_history & (words < SHORT)) | question.rlike(_one_of(COMPARISON)) | (words >= LONG)
    kind = F.when(summary, "summary").when(~ask, "simple")
    return F.struct(kind.alias("query_type"), summary.alias("bypass_retrieval"), F.when(kind.isNotNull(), "fast_path").otherwise("model").alias("source"))


REPLY = "query_type string, operations struct<expansion:boolean,hyde:boolean,decomposition:boolean>, retrieval struct<bypass_retrieval:boolean,strategy:string,top_k:int>"


def decode_reply(reply: Column) -> Column:
    """A planning model's JSON with defaults; what cannot be read is a simple plan."""
    plan = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), REPLY)
    ops = F.array_compact(F.array(*[F.when(plan["operations"][o], F.lit(o)) for o in ("expansion", "hyde", "decomposition")]))
    return F.struct(
        F.coalesce(plan["query_type"], F.lit("simple")).alias("query_type"),
        F.coalesce(plan["retrieval"]["bypass_retrieval"], F.lit(False)).alias("bypass_retrieval"),
        plan["retrieval"]["strategy"].alias("strategy_hint"),
        F.coalesce(ops, F.array().cast("array<string>")).alias("unimplemented_operations"),
        F.when(plan.isNull() | plan["query_type"].isNull(), "fallback").otherwise("model").alias("source"),
    )


def subqueries(reply: Column) -> Column:
    """Sub-queries of a decomposition: two to four, else none."""
    found = F.filter(F.transform(F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "sub_queries array<string>")["sub_queries"], lambda q: F.trim(q)), lambda q: q != "")
    return F.when(F.size(found).between(2, 4), found).otherwise(F.array().cast("array<string>"))


def decode_rewrite(reply: Column) -> Column:
    """The question as a model has rewritten it, null where it says that it need not be, or gives none."""
    said = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "rewrite boolean, rewritten_query string")
    text = F.trim(said["rewritten_query"])
    return F.when(F.coalesce(said["rewrite"], F.lit(False)) & (text != ""), text)


#: Types of questions that are taken apart.
DECOMPOSED = ("complex", "comparison", "reasoning")


def plan(question: Column, has_history: Column, classified: Column | None = None, rewritten: Column | None = None, decomposed: Column | None = None) -> Column:
    """``query_type, bypass_retrieval, source, rewritten_query, sub_queries`` of a question.

    What the rules leave to a model is read from its replies: the class, the
    question rewritten by its history, and the parts of a question of a type
    that is taken apart. A reply that is null or cannot be read means a simple
    question, one that is not rewritten, and one without parts.
    """
    none = F.lit(None).cast("string")
    fast, model = fast_path(question, has_history), decode_reply(none if classified is None else classified)
    asks = fast["source"] == "model"
    kind = F.coalesce(fast["query_type"], model["query_type"])
    bypass = fast["bypass_retrieval"] | (asks & model["bypass_retrieval"])
    again = F.when(asks & has_history, decode_rewrite(none if rewritten is None else rewritten))
    parts = F.when(kind.isin(*DECOMPOSED) & ~bypass, subqueries(none if decomposed is None else decomposed))
    source = F.when(asks, model["source"]).otherwise(fast["source"])
    return F.struct(kind.alias("query_type"), bypass.alias("bypass_retrieval"), source.alias("source"), again.alias("rewritten_query"), F.coalesce(parts, F.array().cast("array<string>")).alias("sub_queries"))
