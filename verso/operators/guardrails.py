"""Guards on questions, retrieved text and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.functions.patterns import CITATION, INJECTION, JAILBREAK, PERSONAL, REDACTED, any_of
from verso.functions.text import strip


def input_reason(question: Column, least: int = 2, most: int = 2000) -> Column:
    """Why a question is refused, null if it is not: the first failing check wins."""
    q = strip(F.coalesce(question, F.lit("")))
    return F.when(F.length(q) < least, "too_short").when(F.length(q) > most, "too_long").when(q.rlike(any_of(INJECTION)), "prompt_injection").when(q.rlike(any_of(JAILBREAK)), "jailbreak")


def personal_flags(text: Column) -> Column:
    """Kinds of personal data in a text, which never block it."""
    return F.array_compact(F.array(*[F.when(text.rlike(any_of((p,)) if name != "email" else p.replace(r"\w", r"(?U:\w)")), F.lit(name)) for name, p in PERSONAL]))


def redact(text: Column, passes: tuple[str, ...] | None = None, mark: str = REDACTED) -> tuple[Column, Column]:
    """The text with every match replaced, pass by pass, and the number of matches."""
    count = F.lit(0)
    for p in passes or (any_of(INJECTION), any_of(JAILBREAK)):
        count = count + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, F.lit(p), F.lit(mark.replace("\\", "\\\\").replace("$", "\\$")))
    return text, count


def sanitize(chunks: DataFrame, passes: tuple[str, ...] | None = None, mark: str = REDACTED) -> DataFrame:
    """``chunks`` with redacted ``text``, ``sanitized`` and ``substrings_redacted``."""
    text, count = redact(F.col("text"), passes, mark)
    return chunks.withColumns({"substrings_redacted": F.coalesce(count, F.lit(0)), "text": text}).withColumn("sanitized", F.col("substrings_redacted") > 0)


def citations(answer: Column) -> Column:
    """Distinct cited articles, sorted."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("(" + any_of((CITATION,)) + ")"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def unverified(answer: Column, context: Column) -> Column:
    """Cited articles that the context does not hold, whatever the case of letters."""
    low = F.lower(F.coalesce(context, F.lit("")))
    return F.filter(citations(answer), lambda c: ~F.contains(low, F.lower(c)))


def sanitize_report(sanitized: DataFrame) -> DataFrame:
    """One row for a batch: chunks, chunks with something redacted, and substrings redacted."""
    return sanitized.agg(F.count("*").alias("chunks"), F.count_if("sanitized").alias("chunks_sanitized"), F.coalesce(F.sum("substrings_redacted"), F.lit(0)).alias("substrings_redacted"))
