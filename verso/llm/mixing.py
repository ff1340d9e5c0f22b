"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are permuted within their source by a seeded digest and cut into
blocks of about ``sqrt(rows)`` documents, so that no task ever sees a whole
source, and the tree splits no more than ``sqrt(rows)`` blocks and one a source.
Water-filled word targets decide how many blocks each source gives (a source
may be passed over twice). A binary tree then splits the exact block quotas of
all sources among the output shards: at each node half of the remaining blocks
go left, drawn without replacement, so a child's quotas follow the multivariate
hypergeometric law and the leaves add up to the root. The permuted blocks of a
source are dealt to the shards by these quotas and shuffled within each shard.

Everything is DataFrame operations; the tree works on one row a node whose
array has one entry a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.llm.common import count_words, even_join, stored, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def source_targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Word targets of sources (``skey, source, source_size``).

    ``share`` of all words is dealt by weight; a target stops at ``cap`` times
    its source and the excess goes to the others by weight, until none is
    above. That fixed point is a water level: sorted by cap per weight, it is
    the first level at which the next source is not full.
    """
    by_name, by_fill = W.orderBy(F.asc_nulls_last("source")), W.orderBy("fill", "skey")
    everything = W.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    filled = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("fill", F.col("most") / F.col("weight"))
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    level = (
        filled.withColumn("spent", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("spent")) / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "skey", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return level.withColumn("target", target).select("skey", "source", "rank", "source_size", "target")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Split ``rank, quota`` (blocks a source gives) among ``shards`` leaves: ``rank, ends`` where
    ``ends[i]`` is the number of blocks of that source in the shards up to ``i``.

    ``shards`` is a power of two. Each node draws half of its blocks for its
    left child by selection sampling, source after source.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("have")).withColumn("node", F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")

    def left_of(have: Column, node_id: Column, level: int) -> Column:
        total = F.aggregate(have, zero, lambda a, x: a + x["quota"])

        def one_source(state: Column, x: Column) -> Column:
            def one_block(s: Column, j: Column) -> Column:
                goes = _uniform(F.lit(seed), F.lit(level), node_id, x["rank"], j) * s["rest"] < s["left"]
                return F.struct((s["rest"] - 1).alias("rest"), (s["left"] - goes.cast("long")).alias("left"), (s["got"] + goes.cast("long")).alias("got"))

            blocks = F.when(x["quota"] > 0, F.sequence(F.lit(1).cast("long"), x["quota"])).otherwise(F.array().cast("array<bigint>"))
            drawn = F.aggregate(blocks, F.struct(state["rest"].alias("rest"), state["left"].alias("left"), zero.alias("got")), one_block)
            return F.get(
                F.transform(F.array(drawn), lambda d: F.struct(d["rest"].alias("rest"), d["left"].alias("left"), F.concat(state["got"], F.array(F.struct(x["rank"].alias("rank"), d["got"].alias("quota")))).alias("got"))),
                F.lit(0),
            )

        start = F.struct(total.alias("rest"), F.expr("0L").alias("left"), F.array().cast("array<struct<rank:int,quota:bigint>>").alias("got"))
        start = start.withField("left", F.floor(total / 2).cast("long"))
        return F.aggregate(have, start, one_source, lambda s: s["got"])

    for level in range(int(math.log2(shards))):
        cut = node.withColumn("low", left_of(F.col("have"), F.col("node"), level))
        high = F.zip_with("have", "low", lambda h, g: F.struct(h["rank"].alias("rank"), (h["quota"] - g["quota"]).alias("quota")))
        kids = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("low").alias("have")), F.struct((F.col("node") * 2 + 1).alias("node"), high.alias("have")))
        node = cut.select(F.explode(kids).alias("kid")).select("kid.node", "kid.have")
    leaf = node.select("node", F.explode("have").alias("x")).select("node", "x.rank", "x.quota")
    running = F.sum("quota").over(W.partitionBy("rank").orderBy("node"))
    return leaf.withColumn("end", running).groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def plan_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, shards: int = 8, seed: int = 7) -> DataFrame:
    """One row a document: ``doc_id, size, source, source_size, target, taken, copies`` where ``copies``
    lists ``(pass, words, shard, place)`` of each time the document is drawn.

    A source's words in the mix are its target rounded down: whole documents
    in permuted order, the last one of a pass cut after as many words as are
    missing. ``place`` orders a shard. Null text counts no words and is never
    drawn; a null source is a source of its own, sorted last; repeated rows
    are documents of their own; an empty table gives an empty mix. Other
    columns are ignored.
    """
    doc = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("draw"))
    doc = stored(doc.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))), "mix-sizes")
    many = stored(doc.groupBy("skey").agg(F.count("*").alias("rows")), "mix-rows")
    every = math.sqrt(many.agg(F.sum("rows")).first()[0] or 1)
    spot = F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    doc = even_join(doc, many.select("skey", F.ceil(F.col("rows") / every).alias("blocks")), "skey", ("draw",))
    doc = doc.withColumn("block", F.floor(spot * F.col("blocks")).cast("int")).drop("blocks")
    block = doc.groupBy("skey", "block").agg(F.first("source").alias("source"), F.sum("size").alias("words"))
    block = stored(block, "mix-blocks")
    sources = block.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    target = stored(source_targets(sources, share, cap, weights).withColumn("first", F.least(F.floor("target"), F.col("source_size"))).withColumn("second", F.floor("target") - F.col("first")), "mix-targets")

    before = F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = block.drop("source").withColumn("before", before).join(target, "skey")
    draws = placed.select("skey", "rank", "block", F.explode(F.array(*[F.struct(F.lit(i).alias("pass"), ((F.col("words") > 0) & (F.col("before") < F.col(c))).alias("drawn")) for i, c in ((1, "first"), (2, "second"))])).alias("d")).filter("d.drawn").select("skey", "rank", "block", "d.pass")
    ends = split_quotas(draws.groupBy("rank").agg(F.count("*").alias("quota")), shards, seed)
    order = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.lit("deal"), "rank", "pass", "block"), "pass", "block")
    dealt = draws.withColumn("n", F.row_number().over(order)).join(ends, "rank").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("n"))))
    dealt = dealt.groupBy("skey", "block").agg(F.max(F.when(F.col("pass") == 1, F.col("shard"))).alias("shard_1"), F.max(F.when(F.col("pass") == 2, F.col("shard"))).alias("shard_2"))
    placed = placed.join(dealt, ["skey", "block"], "left").drop("words", "rank", "source")

    inside = W.partitionBy("skey", "block").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    doc = doc.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))).join(placed, ["skey", "block"])

    def words_of(limit: str) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col(limit) - F.col("before") - F.col("offset")))

    def copy_of(i: int, limit: str) -> Column:
        return F.struct(F.lit(i).alias("pass"), words_of(limit).alias("words"), F.col(f"shard_{i}").alias("shard"), F.xxhash64(F.lit(seed), F.lit(i), "draw").alias("place"))

    # what no shard has drawn is not in the mix
    copies = F.filter(F.array(copy_of(1, "first"), copy_of(2, "second")), lambda c: (c["words"] > 0) & c["shard"].isNotNull())
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return doc.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "copies")


def mixed_rows(plan: DataFrame) -> DataFrame:
    """The mix itself: a row for each draw (``shard, place, doc_id, source, pass, words``), one partition range a shard, in shuffled order."""
    rows = plan.select("doc_id", "source", F.explode("copies").alias("c")).select("c.shard", "c.place", "doc_id", "source", "c.pass", "c.words")
    return rows.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", "doc_id")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """What the shards of the mix draw of every document; null texts and sources, repeated rows and empty tables as in ``plan_mix``."""
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_shards(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` as the tree deals it: ``shard, place, doc_id, source, pass, words`` of every draw, each shard
    in its shuffled order; null texts and sources, repeated rows and empty tables as in ``plan_mix``."""
    return mixed_rows(plan_mix(table(spark, sf_dir, "documents")))


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('7:' || CAST(doc_id AS VARCHAR)) AS draw
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([3, 1, 2][((rank - 1) % 3) + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS most FROM src),
filled AS (
  SELECT *, most / weight AS fill,
         coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
         sum(source_size) OVER () * 1.5::DOUBLE AS goal
  FROM weighed),
lev AS (SELECT arg_min((goal - spent) / open, (fill, rank)) AS level FROM filled WHERE fill >= (goal - spent) / open),
target AS (
  SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target,
         least(CAST(floor(least(most, coalesce(level * weight, most))) AS BIGINT), source_size) AS r1
  FROM filled LEFT JOIN lev ON true),
placed AS (
  SELECT s.*, t.source_size, t.target, t.r1, CAST(floor(t.target) AS BIGINT) - t.r1 AS r2,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, r1 - c)) + greatest(0, least(size, r2 - c)) AS BIGINT) AS taken
FROM placed
"""
