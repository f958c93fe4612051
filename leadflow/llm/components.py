"""Connected components of an edge table, without a driver-side copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import stored

#: Rows up to which Spark may broadcast a stored table, which it sizes by its compressed files; longer ones are merged.
FEW = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); the
    component is its smallest node.

    Rounds of large-star and small-star: each hangs a node's neighbours under the
    smallest node in sight, keeping components whole; the rounds end when no edge
    changes (a logarithmic number). Each round's edges go through a stored table.
    A star is taken by aggregating per node (with partial aggregation) and joining
    back, so a node with very many links is never gathered in one task.
    """
    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_of = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = tuple(cur.agg(*print_of).first())
    while seen[0]:
        both = cur.select("a", "b").unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        # Large-star: neighbours larger than the node go under the node's minimum.
        large = both.filter("b > a").join(low if seen[0] <= FEW else low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small-star: the node and its smaller neighbours go under the smallest of them.
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(small_low.select("a", F.col("m").alias("b"))))
        cur = stored(small.filter("a <> b").distinct(), "edges")
        now = tuple(cur.agg(*print_of).first())
        if now == seen:
            break
        seen = now
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
