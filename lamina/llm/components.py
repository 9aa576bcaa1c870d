"""Connected components by alternating large-star and small-star steps.

Each step replaces edges by edges to the smallest neighbour, which keeps components and shortens
paths; it takes about log n rounds until every node points to its component's smallest. Neighbours
are never gathered: a node's smallest is a grouped minimum, joined back to its edges. Each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def components(edges: DataFrame, scratch: Scratch, rows_per_task: int = 50_000) -> DataFrame:
    """edges: a, b (long). -> node, component (the smallest node). Nodes without edges don't occur; edges with nulls are ignored.

    The edges get fewer with each round; each round's tasks are as many as its edges call for.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = scratch.written(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        n = min(most, 1 + before[0] // rows_per_task)
        few = lambda df, n=n: df.coalesce(n)
        edges = few(edges)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = few(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))
        large = few(large.unionByName(few(edges.groupBy("a").agg(F.min("b").alias("b")))).distinct())
        least = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(least, "a")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b")
        after_edges = scratch.written(few(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
        after = _mark(after_edges)
        edges = after_edges
        if after == before:
            break
        before = after
    found = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct().join(found.select("node"), "node", "left_anti"))
