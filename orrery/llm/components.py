"""Connected components of links, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import dropped, staged


def components(links: DataFrame) -> DataFrame:
    """node, root of every node of links (a, b): the least node that can be reached.

    Every round, a node takes the least root among its own and its neighbours', then the root's root.
    The number of rounds grows with the logarithm of the longest way; each is written to the shared
    folder, so a lost executor costs one round; what a round no longer needs is deleted.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    roots = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    old: list[DataFrame] = []
    while True:
        roots = staged(roots, "roots")
        dropped(*old)
        lower = (
            both.join(roots.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("low"))
            .join(roots, "node")
            .select("node", F.least("low", "root").alias("root"), (F.col("low") < F.col("root")).alias("moved"))
        )
        lower = staged(lower, "lower")
        if not lower.where("moved").limit(1).count():
            dropped(lower, both)
            return roots
        old = [roots, lower]
        roots = (
            lower.select("node", "root")
            .join(lower.select(F.col("node").alias("root"), F.col("root").alias("next")), "root")
            .select("node", F.least("root", "next").alias("root"))
        )
