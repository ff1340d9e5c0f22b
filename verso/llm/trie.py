"""A trie of conversations by their turns.

A turn is the digest of its role and text; texts are not shuffled. Equal
conversations are one sequence that carries their number, the smallest id and
the digest of all ids. Sequences are dealt by the digest of their first turn:
those that start alike meet in one group, where a pointer trie of dictionaries
is built and folded from its leaves up. First turns with too many turns below
them are not built there: the chain of turns that all of their sequences share
is made by an aggregation, and what lies below it is dealt again by the next
turn, where sequences part, until no part is too large. The totals of the parts
then flow back up, chain by chain.

A conversation is one row: an array of 64 characters and a number for each of
its turns. That row is all that has to fit a task, and bounds a conversation to
some ten million turns; groups of conversations are not bounded.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.llm.common import count_words, even_join, stored, table, with_few

#: Turns of a part that is built as one trie.
MOST = 1 << 13
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(rows: DataFrame, group: Column) -> DataFrame:
    """``conv_id, turn, role, text`` to ``group, conv_id, turns``: the digest and the words of each turn, in order.

    A null turn comes first and equal turns go by their digest; null roles and
    texts count as empty, repeated rows as turns of their own; rows without a
    conv_id are one conversation; other columns are ignored. ``group`` is a
    function of conv_id: conversations that share it stay in one partition.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), count_words(text).alias("words"))
    ordered = rows.select(group.alias("group"), "conv_id", turn.alias("t")).repartition("group").groupBy("group", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))))


def digests_of_ids(rows: DataFrame) -> DataFrame:
    """``seq, conv_id`` to ``seq, ends``: SHA-256 of the ids of each sequence in ascending order, joined by commas, a null as "null" at the end.

    Ids are packed by ranges of 4,096 first; a task then reads the packs of a
    sequence in order and holds one at a time.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda c: c.cast("string")), ",")
    packs = rows.groupBy("seq", F.shiftright("conv_id", 12).alias("range")).agg(ids.alias("pack")).withColumn("pack", F.when(F.col("range").isNull(), F.lit("null")).otherwise(F.col("pack")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for seq, pack in zip(batch.column("seq").to_pylist(), batch.column("pack").to_pylist()):
                if seq == at:
                    state.update(b",")
                else:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = seq, hashlib.sha256()
                state.update(pack.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["seq", "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], ["seq", "ends"])

    return packs.repartition("seq").sortWithinPartitions("seq", F.asc_nulls_last("range")).select("seq", "pack").mapInArrow(run, "seq string, ends string")


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller id, null last."""
    return b if a is None or (b is not None and b < a) else a


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries over sequences of one part. A node whose parent lies outside has that one's key in ``top``."""
    roots: dict[str, dict[str, int]] = {}
    kids: list[dict[str, int]] = []
    up, depth, convs, least, words, ends, top = [], [], [], [], [], [], []
    for above, skip, digests, sizes, n, first, ended in zip(*(rows[c] for c in ("top", "skip", "digests", "sizes", "n", "first", "ends"))):
        here, parent, first = roots.setdefault(above, {}), -1, None if pd.isna(first) else int(first)
        for d, (digest, size) in enumerate(zip(digests, sizes), skip + 1):
            node = here.get(digest)
            if node is None:
                node = here[digest] = len(up)
                for column, value in zip((up, depth, convs, least, words, ends, top, kids), (parent, d, 0, None, int(size), NO_ENDS, above if parent < 0 else None, {})):
                    column.append(value)
            convs[node] += int(n)
            least[node] = smaller(least[node], first)
            parent, here = node, kids[node]
        ends[parent] = ended
    leaves, saved = [0] * len(up), [0] * len(up)
    for node in range(len(up) - 1, -1, -1):  # parents are made before their children, so this is a postorder
        leaves[node] += not kids[node]
        saved[node] += (convs[node] - 1) * words[node]
        if up[node] >= 0:
            leaves[up[node]] += leaves[node]
            saved[up[node]] += saved[node]
    show = lambda x: None if x is None else str(x)  # noqa: E731  ids as text: pandas has no integers with nulls
    return pd.DataFrame(
        {"first": [show(x) for x in least], "depth": depth, "parent": [show(least[u]) if u >= 0 else None for u in up], "n": convs, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved": saved, "ends": ends, "top": top}
    )


def prefix_trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """One row for each distinct prefix of ``conv_id, turns``, the empty one included.

    ``conv_id`` is the smallest of its conversations, ``parent_conv_id`` that
    of its parent (null for the root). ``n_convs`` counts conversations that
    start with it, ``n_children`` its children, ``n_leaves`` the childless
    nodes of its subtree, itself included; ``saved_tokens`` sums, over its
    subtree, the words of the last turn times the conversations beyond the
    first; ``ends_sha256`` is the digest of the ids of conversations that end
    there. A conversation without turns ends at the root; a null id counts and
    is never the smallest; no conversations have no nodes. ``most`` turns are
    built as one trie; the result does not depend on it.
    """
    spark = conversations.sparkSession
    seq = conversations.withColumn("seq", F.sha2(F.array_join(F.col("turns.digest"), ""), 256))
    each = seq.groupBy("seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("turns").alias("turns"))
    each = stored(each.join(digests_of_ids(seq.select("seq", "conv_id")), "seq"), "trie-sequences")
    size = F.size("turns")
    root = each.agg(F.sum("n"), F.min("first"), F.max(F.when(size == 0, F.col("ends"))), F.sum(size)).head()
    if not root[0]:
        return spark.createDataFrame([], NODE)

    rest, parts, chains = each.filter(size > 0).withColumns({"skip": F.lit(0), "top": F.lit(""), "key": F.col("turns")[0]["digest"]}), [], []
    while True:
        large = stored(rest.groupBy("key").agg(F.sum(size - F.col("skip")).alias("weight")).filter(F.col("weight") > most), "trie-large")
        if large.isEmpty():
            parts.append(rest)
            break
        split = stored(with_few(rest, large, "key", ("seq",)), "trie-split")
        parts.append(split.filter("weight IS NULL").drop("weight"))
        split = split.filter("weight IS NOT NULL").drop("weight")
        guide = split.groupBy("key").agg(F.first(F.col("turns")["digest"]).alias("guide"))
        differs = F.array_position(F.zip_with(F.col("turns")["digest"], F.col("guide"), lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False)).cast("int")
        split = stored(even_join(split, guide, "key", ("seq",)).withColumn("same", F.when(differs == 0, size).otherwise(differs - 1)).drop("guide"), "trie-same")
        reach, words = F.min("same"), F.first(F.col("turns")["words"])
        chain = split.groupBy("key").agg(F.first("top").alias("top"), F.first("skip").alias("skip"), F.sum("n").alias("n"), F.min("first").alias("first"), reach.alias("reach"), words.alias("words"), F.when(F.min(size) == reach, F.min_by("ends", size)).alias("ends"))
        chain = stored(chain.withColumn("words", F.slice("words", F.col("skip") + 1, F.col("reach") - F.col("skip"))), "trie-chains")
        chains.append(chain)
        rest = even_join(split.drop("top", "skip", "same"), chain.select("key", "reach"), "key", ("seq",)).filter(size > F.col("reach"))
        rest = stored(rest.select("seq", "turns", "n", "first", "ends", F.col("reach").alias("skip"), F.col("key").alias("top"), F.sha2(F.concat("key", F.get("turns", F.col("reach"))["digest"]), 256).alias("key")), "trie-rest")

    below = F.slice("turns", F.col("skip") + 1, size - F.col("skip"))
    dealt = [p.select("top", "skip", below["digest"].alias("digests"), below["words"].alias("sizes"), "n", F.col("first").cast("string").alias("first"), "ends", F.pmod(F.xxhash64("key"), F.lit(math.ceil(root[3] / most) or 1)).alias("part")) for p in parts]
    built = reduce(DataFrame.unionByName, dealt).groupBy("part").applyInPandas(grow, "first string, depth long, parent string, n long, n_children long, n_leaves long, saved long, ends string, top string")
    built = stored(built.withColumns({c: F.col(c).cast("long") for c in ("first", "parent")}), "trie-nodes")

    def folded(nodes: DataFrame) -> DataFrame:
        return nodes.groupBy("top").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))

    def beneath(chains: list[DataFrame]) -> DataFrame:
        """Totals by the node they hang on, of built parts and of the chains made last."""
        return reduce(DataFrame.unionByName, [tops, *map(folded, chains)]).groupBy("top").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")])

    tops, made = stored(folded(built.filter("top IS NOT NULL")), "trie-tops"), []
    for chain in reversed(chains):
        whole = chain.join(beneath(made[-1:]).select(F.col("top").alias("key"), "n_children", F.col("n_leaves").alias("l"), F.col("saved").alias("under")), "key", "left")
        whole = whole.fillna(0, ["n_children", "under"]).withColumn("n_leaves", F.coalesce("l", F.lit(1))).drop("l")
        made.append(stored(whole.withColumn("saved", F.col("under") + (F.col("n") - 1) * F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + w)), "trie-upper"))

    from_root = beneath(made[-1:]).filter("top = ''").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_children", "n_leaves", "saved")]).head()
    n_convs, first, ends, _ = root

    def shown(nodes: DataFrame, parent: Column) -> DataFrame:
        return nodes.select(F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), *[F.col(c).cast("long").alias(c) for c in ("n_children", "n_leaves")], F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))

    out = [spark.createDataFrame([(first, 0, None, n_convs, from_root[0], from_root[1] or 1, from_root[2], ends or NO_ENDS)], NODE), shown(built.filter("top IS NULL"), F.col("parent"))]
    tops = [built.filter("top IS NOT NULL").drop("parent")]
    if made:
        links = reduce(DataFrame.unionByName, made).select("*", F.posexplode("words").alias("place", "size"))
        upward = W.partitionBy("key").orderBy(F.desc("place")).rowsBetween(W.unboundedPreceding, 0)
        last = F.col("place") == F.size("words") - 1
        links = links.withColumns({"depth": F.col("skip") + F.col("place") + 1, "saved": F.col("under") + (F.col("n") - 1) * F.sum("size").over(upward), "n_children": F.when(last, F.col("n_children")).otherwise(1), "ends": F.coalesce(F.when(last, F.col("ends")), F.lit(NO_ENDS))})
        out.append(shown(links.filter("place > 0"), F.col("first")))
        tops.append(links.filter("place = 0").select(*tops[0].columns))
    tops = reduce(DataFrame.unionByName, tops)
    out.append(shown(tops.filter("top = ''"), F.lit(first)))
    if made:
        above = reduce(DataFrame.unionByName, made).select(F.col("key").alias("top"), F.col("first").alias("parent"))
        out.append(shown(even_join(tops.filter("top != ''"), above, "top", ("first", "depth", "ends")), F.col("parent")))
    return reduce(DataFrame.unionByName, out)


def rebuilt(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``, where each conversation starts with the first turns of the one whose id is the next multiple
    of 20 towards zero: as many as its id's CRC-32 says, 0 to 3. The conversation without an id stays as it is."""
    own = turns_of(rows, F.col("conv_id") - F.col("conv_id") % 20)
    head = F.first(F.when(F.col("conv_id") == F.col("group"), F.slice("turns", 1, 3)), ignorenulls=True).over(W.partitionBy("group"))
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 4, F.lit(0)).cast("int")
    taken = F.coalesce(F.slice("head", 1, h), F.slice("turns", 1, 0))
    return own.withColumn("head", head).select("conv_id", F.concat(taken, F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h))).alias("turns"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations. Null turns, roles, texts and ids, equal turns and repeated rows as
    in ``turns_of``; empty tables as in ``prefix_trie``; other columns are ignored."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


#: CRC-32 of a decimal number, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

OP11_SQL = f"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos
  FROM (SELECT conv_id, turn, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations)),
convs AS (SELECT conv_id, {CRC32.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
joined AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.digest, t.words FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.digest, t.words FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
path AS (
  SELECT conv_id, d, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, max(d) OVER (PARTITION BY conv_id) = d AS ends
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM joined)
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM joined) FROM convs),
node AS (
  SELECT path, d, min(conv_id) AS first, any_value(words) AS words, count(*) AS n, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends) AS ids
  FROM path GROUP BY path, d),
kids AS (
  SELECT c.*, p.path AS up, q.first AS up_first FROM node c
  LEFT JOIN path p ON p.conv_id = c.first AND p.d = c.d - 1 LEFT JOIN node q ON q.path = p.path AND q.d = p.d),
numbers AS (SELECT up, d - 1 AS d, count(*) AS n FROM kids WHERE up IS NOT NULL GROUP BY up, d),
tree AS (
  SELECT p.path, p.d, count(*) FILTER (k.n IS NULL) AS leaves, sum((v.n - 1) * v.words) AS saved
  FROM node v JOIN path p ON p.conv_id = v.first AND p.d <= v.d LEFT JOIN numbers k ON k.up = v.path AND k.d = v.d GROUP BY p.path, p.d)
SELECT c.first AS conv_id, CAST(c.d AS BIGINT) AS depth, c.up_first AS parent_conv_id, c.n AS n_convs, coalesce(k.n, 0) AS n_children,
       t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(c.ids, '')) AS ends_sha256
FROM kids c JOIN tree t USING (path, d) LEFT JOIN numbers k ON k.up = c.path AND k.d = c.d
"""
