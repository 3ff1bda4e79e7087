"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, release


#: Nodes that may be broadcast because they have very many links: at most so many of twice the links can have the share that makes one.
HEAVY = 20_000
#: Links of a node that are never too many for one task.
LIGHT = 1_000_000


def _minimum(pairs: DataFrame) -> DataFrame:
    """u, m, n: the least of u and its neighbours, and their number, combined before the shuffle."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))


def _with_minimum(pairs: DataFrame, stats: DataFrame, total: int) -> DataFrame:
    """pairs(u, v) with m of u. Nodes with over LIGHT and over total / HEAVY of the links, of which there are at most HEAVY, are broadcast, so that the centre of a star is no hot key; the others are joined."""
    limit = max(LIGHT, total // HEAVY)
    if total <= LIGHT:
        return pairs.join(stats.select("u", "m"), "u")
    heavy = F.broadcast(stats.where(F.col("n") > limit).select("u", "m"))
    light = stats.where(F.col("n") <= limit).select("u", "m")
    return pairs.join(heavy, "u").unionByName(pairs.join(heavy.select("u"), "u", "left_anti").join(light, "u"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root for every node of edges(u, v); root is the least node that links reach.

    Alternates large-star and small-star steps until the edges are stars around
    the least nodes. Every round is written to the shared checkpoint folder. Only counts and
    checksums reach the driver. Nulls and loops are ignored; no edges give no rows. Rounds grow with the logarithm of the
    longest path; more than max_rounds are an error.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = None
    total = current.count()
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours greater than u now point to the least of u's neighbourhood
        large = _with_minimum(both.where("v > u"), _minimum(both), 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: u and its lesser neighbours point to the least of them
        lesser = _minimum(large)
        small = _with_minimum(large, lesser, 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(lesser.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = after.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")
        ).first()
        release(current)
        current, total = after, state["n"]
        if state["n"] == 0 or (seen is not None and tuple(state) == seen):
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
