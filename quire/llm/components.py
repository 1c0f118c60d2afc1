"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import PARTITION_ROWS, compact, cut, gather, join_groups, sized


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def components(edges: DataFrame, steps: int = 100) -> DataFrame:
    """edges: (u, v), longs. A row (node, label) for every node but the least of each component; label is that least node.

    Each step is two aggregations and joins over the edges, in as many partitions as the edges fill: few edges take one task a step,
    many take the session's. A node with many neighbours costs one partial row a task in the aggregation, and is kept out of the shuffle of
    the join (join_groups). The driver sees two numbers a step.

    Defined results: repeated edges, both directions and loops count as one or none; an edge with a null end is ignored; no
    edges give no rows.
    """
    ends = edges.where("u is not null and v is not null and u <> v")
    low, rows = sized(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    few = 2 * rows <= PARTITION_ROWS
    now = _mark(low)
    for _ in range(steps):
        both = low.union(low.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = both.coalesce(1) if few else both
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        up = both.where("v > u")
        met = up.join(least, "u") if few else join_groups(up, gather(least), "u", "n")
        large = cut(compact(met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows))
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        small = small.coalesce(1) if few else small
        low = cut(compact(small.distinct(), rows))
        before, now = now, _mark(low)
        if now == before:
            break
    else:
        raise RuntimeError("components: not settled")
    return low.select(F.col("u").alias("node"), F.col("v").alias("label"))
