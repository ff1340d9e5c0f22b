"""Connected components by hooking and pointer jumping, in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.common import even_join, stored


def _jump(parent: DataFrame) -> DataFrame:
    """Replace every parent by the root above it."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        parent = stored(even_join(parent, up, "root", ("node",)).select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "cc-jump")
        if parent.filter("moved").isEmpty():
            return parent.drop("moved")


def merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after adding ``links`` (a, b), whose ends all have labels.

    Only links between different roots are kept, so each round works on a
    contracted graph whose roots at least halve; roots are smallest nodes of
    what they stand for at the time, and only name the component. A node with
    many links and a root of many nodes are dealt to several tasks.
    """
    while True:
        of = labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = stored(even_join(even_join(links, of[0], "a", ("b",)), of[1], "b", ("a",)).filter("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-links")
        if links.isEmpty():
            return labels
        # every greater root hooks to its smallest neighbour; parents are smaller, so there is no cycle
        hooks = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        tops = links.select(F.col("a").alias("node")).distinct().join(hooks.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
        parent = _jump(stored(hooks.unionByName(tops), "cc-parents"))
        moved = even_join(labels, parent.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", ("node",), "left")
        labels = stored(moved.select("node", F.coalesce("above", "root").alias("root")), "cc-labels")
