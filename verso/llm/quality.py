"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a lazily evaluated condition that rejects a text. On a bounded,
deterministic sample the cascade measures what each rule costs and how often it
rejects, and asks the rules in the order of rejections per cost. A text that
one rule rejects is not shown to the next; the verdict does not depend on the
order, which only decides how soon a bad text is dropped.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.llm.common import let, table

#: Runs of blanks between words, and characters that count as symbols.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _long(c: Column) -> Column:
    return c.cast("long")


def n_words(text: Column, words: Column) -> Column:
    return _long(F.size(words))


def word_chars(text: Column, words: Column) -> Column:
    return _long(F.length(F.array_join(words, "")))


def n_symbols(text: Column, words: Column) -> Column:
    return _long(F.regexp_count(text, F.lit(SYMBOLS)))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column, words: Column) -> Column:
    return let(_lines(text), lambda x: _long(F.size(x) - F.size(F.array_distinct(x))))


def n_dup_line_words(text: Column, words: Column) -> Column:
    """Words of the lines that equal an earlier line."""

    def count(lines: Column, distinct: Column) -> Column:
        first = F.size(words_of(F.array_join(distinct, "\n")))
        return _long(F.when(F.size(distinct) < F.size(lines), F.size(words) - first).otherwise(F.lit(0)))

    return let(_lines(text), lambda x: let(F.array_distinct(x), lambda d: count(x, d)))


def n_repeat_words(text: Column, words: Column) -> Column:
    """Words covered by five-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash: within one text of a million words
    two different windows meet with a chance below one in ten million.
    """
    zero = F.lit(0).cast("long")

    def moved(x: Column, by: int) -> Column:
        return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))

    def pairs(x: Column, y: Column, by: int) -> Column:
        return F.zip_with(x, moved(y, by), lambda a, b: F.xxhash64(a, b))

    def windows(one: Column) -> Column:
        """From hashes of words to those of two, four and then five words; the last four places have no whole window."""
        four = let(pairs(one, one, 1), lambda two: pairs(two, two, 2))
        return F.slice(pairs(four, one, 4), F.lit(1), F.greatest(F.size(one) - (WINDOW - 1), F.lit(0)))

    def covered(ordered: Column) -> Column:
        again = F.transform(ordered, lambda x, i: F.when((x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]), x["p"]))
        places = F.sort_array(F.filter(again, lambda p: p.isNotNull()))
        start = F.struct(F.lit(-WINDOW).alias("last"), zero.alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, covered)).otherwise(zero)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda one: let(windows(one), count))


#: Each takes the text and its words, which are cut once for all.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_dup_line_words": n_dup_line_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``test`` of the features is true; ``needs`` are the features that it reads."""

    name: str
    needs: tuple[str, ...]
    test: Callable[..., Column]


#: The first two are the base rules; the others reject what is plainly not prose.
BASE_RULES = (
    Rule("too_short", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n),
)
MORE_RULES = (
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 30 * n)),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 2 * s > 3 * n),
    Rule("duplicate_lines", ("n_words", "n_dup_line_words"), lambda n, d: 100 * d > 30 * n),
)


def with_features(docs: DataFrame, text: str = "text", names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """``docs`` with the named feature columns, in place of columns of these names; null text counts as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    found = let(words_of(value), lambda w: F.struct(*[FEATURES[n](value, w).alias(n) for n in names]))
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    return docs.select(kept.alias("row"), found.alias("found")).select("row.*", "found.*")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = 256) -> list[tuple[Rule, float, float]]:
    """Rules with their seconds and rejected share on ``sample_rows`` texts, best rejection per cost first.

    The sample has the texts of the least digests, so it does not depend on
    the order of files; it is bounded and only steers the order.
    Each rule runs twice, and the faster run counts, so that compiling does not.
    """
    digest = F.xxhash64(F.col(text))
    edge = docs.select(digest.alias("d")).orderBy("d").limit(sample_rows).agg(F.max("d")).first()[0]
    sample = docs.filter(digest <= F.lit(edge)) if edge is not None else docs
    sample = sample.select(F.coalesce(F.col(text), F.lit("")).alias("text")).limit(sample_rows).repartition(1).cache()
    size = max(1, sample.count())
    measured = []
    for rule in rules:
        asked = sample.select(F.sum(failed_rule([rule], F.col("text")).isNotNull().cast("int")).alias("n"))
        cost, rejected = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            rejected = asked.first()["n"] or 0
            cost = min(cost, time.perf_counter() - began)
        measured.append((rule, cost, rejected / size))
    sample.unpersist()
    return sorted(measured, key=lambda m: (-(m[2] + 0.5 / size) / m[1], m[0].name))


def failed_rule(rules: list[Rule], text: Column | None = None) -> Column:
    """The first rule that rejects, else null: from feature columns, or computed from ``text``, whose words are
    cut once. Later rules are not evaluated, nor are the features that only they need."""

    def cascade(words: Column | None) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(rules):
            found = rule.test(*[F.col(n) if words is None else FEATURES[n](text, words) for n in rule.needs])
            out = F.when(F.coalesce(found, F.lit(False)), F.lit(rule.name)).otherwise(out)
        return out

    return cascade(None) if text is None else let(words_of(text), cascade)


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", sample_rows: int = 256) -> DataFrame:
    """The documents that no rule rejects, all columns kept.

    Null and empty texts have no words and fail ``too_short``; repeated rows
    are judged alike; an empty table stays empty.
    """
    ordered = [r for r, _, _ in order_rules(docs, rules, text, sample_rows)]
    return docs.filter(failed_rule(ordered, F.coalesce(F.col(text), F.lit(""))).isNull())


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Features and verdict of every document; ``kept`` is false where a base rule or one of the cascade rejects.

    Null and empty texts have no words and fail; repeated rows are judged alike; texts are read whole; an empty
    table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = [r for r, _, _ in order_rules(docs, BASE_RULES + MORE_RULES)]
    base = failed_rule(list(BASE_RULES)).isNotNull()
    out = with_features(docs).drop("text")
    return out.select("doc_id", *FEATURES, base.alias("base_failed"), failed_rule(ordered).isNull().alias("kept"))


OP1_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
win AS (
  SELECT k, i, words[i:i + 4] AS five FROM (SELECT k, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
again AS (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS n FROM win),
cover AS (
  SELECT k, least(5, i - coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), i - 5)) AS c FROM again WHERE n > 1),
rep AS (SELECT k, sum(c) AS n FROM cover GROUP BY k),
lines AS (
  SELECT k, CAST(sum(times - 1) AS BIGINT) AS n, CAST(sum((times - 1) * len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_again
  FROM (SELECT k, line, count(*) AS times FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line) GROUP BY k),
f AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lines.n_again, 0) AS BIGINT) AS n_dup_line_words
  FROM w LEFT JOIN rep USING (k) LEFT JOIN lines USING (k))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 30 * n_words
            OR 2 * n_symbols > 3 * n_words OR 100 * n_dup_line_words > 30 * n_words) AS kept
FROM f
"""
