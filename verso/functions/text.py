"""Text functions, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verso.functions.patterns import REFUSALS

TOKEN = r"([\p{L}\p{N}_]+)"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def word_count(text: Column) -> Column:
    """Words between Unicode blanks."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility composition; plain ASCII texts stay in the engine."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, text).otherwise(F.pandas_udf(_composed, "string")(F.when(~plain, text)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tidy(text: Column) -> Column:
    """Cleaning after composition: invisible signs, hyphens at line ends, blanks and empty lines."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[\u00ad\ufeff\u200b]", "")
    out = F.regexp_replace(out, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean(text: Column) -> Column:
    """Composition, then :func:`tidy`; null is empty."""
    return tidy(nfkc(F.coalesce(text, F.lit(""))))


#: Markdown marks and what stays of them, in order.
MARKDOWN = ((r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?s)`{3}.*?`{3}", ""), (r"`([^`]+)`", "$1"), (r"(?m)^#{1,6}(?U:\s)+", ""), (r"\*{1,2}([^*]+)\*{1,2}", "$1"), (r"(?m)^[-*+] ", ""), (r"(?m)^>{1,} ?", ""))


def markdown_to_plain(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern, stays in MARKDOWN:
        out = F.regexp_replace(out, pattern, stays)
    return out


def is_refusal(answer: Column) -> Column:
    head = F.substring(F.lower(strip(F.coalesce(answer, F.lit("")))), 1, 200)
    out = F.lit(False)
    for marker in REFUSALS:
        out = out | F.contains(head, F.lit(marker))
    return out


def table_line(cells: Column) -> Column:
    """A row of a markdown table: bars escaped, newlines as blanks, null as empty."""
    safe = F.transform(cells, lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("| "), F.array_join(safe, " | "), F.lit(" |"))


def clean_plain(text: Column) -> Column:
    """Composition, then no control or format signs but newline and tab, single blanks, one empty line at most; null is empty."""
    out = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"[\p{C}&&[^\n\t]]", "")
    return strip(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def truncate(text: Column, most: int = 100, suffix: str = "...") -> Column:
    """Texts longer than ``most`` cut at their last blank before it, if there is one, with a suffix."""
    head = F.substring(text, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.+) ", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(whole == "", head).otherwise(whole), F.lit(suffix)))


def title(question: Column, most: int = 50) -> Column:
    """A session's title: the question without punctuation, truncated."""
    return truncate(F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)[^\w\s]", ""), most)
