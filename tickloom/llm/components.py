"""Connected components by alternating star contraction, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def stars(edges: DataFrame) -> DataFrame:
    """edges (child, parent), bigint, child > parent -> one row (child, parent) for each child, parent being the smallest node of its component.

    Each round first hangs what points to a parent under that parent's smallest neighbour, then gathers each child's
    parents under the smallest of them. Both joins read written tables on both sides, so that adaptive execution can
    split the partition of a node with very many neighbours. The number of rounds grows with the logarithm of the
    component's diameter. Rows with equal or null ends must not occur. No edges: no rows.
    """
    now = kept(edges.select("child", "parent").distinct(), "edges")
    while True:
        least = kept(now.groupBy("child").agg(F.min("parent").alias("least")), "least")
        up = least.select(F.col("child").alias("parent"), F.col("least"))
        large = kept(now.join(up, "parent", "left").select("child", F.coalesce("least", "parent").alias("parent")).distinct(), "large")
        least = kept(large.groupBy("child").agg(F.min("parent").alias("least"), F.count(F.lit(1)).alias("n")), "least")
        several = least.where("n > 1").select("child", "least")
        rest = large.join(several, "child").where("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
        after = kept(least.select("child", F.col("least").alias("parent")).union(rest).distinct(), "edges")
        # done: each child has one parent and no parent is a child
        if after.groupBy().count().first()[0] == least.count() and after.join(after.select(F.col("child").alias("parent")), "parent", "left_semi").isEmpty():
            return after
        now = after
