"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, join_spread, materialise

#: Edges from which on a node may have so many that one task should not join them all; 16 bytes each.
WIDE = 1 << 20


def _with_least(edges: DataFrame, least: DataFrame, wide: bool) -> DataFrame:
    """``edges`` with m of their u; the edges of a hub are dealt to many tasks."""
    return join_spread(edges, least, "u", "n") if wide else edges.join(least, "u")


def _folded(edges: DataFrame, wide: bool, used: list[DataFrame]) -> DataFrame:
    """u, the least v as m, and the number of edges as n; written first where a salted join reads it several times."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if wide:
        used.append(least := materialise(least, "least"))
    return least


def _large_star(edges: DataFrame, wide: bool, used: list[DataFrame]) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _folded(both, wide, used).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter(F.col("v") > F.col("u")), least, wide).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, wide: bool, used: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    if wide:
        used.append(down := materialise(down, "down"))
    least = _folded(down, wide, used)
    rest = _with_least(down, least, wide).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that has an edge to a smaller root; columns u and v are longs.

    A node absent from the result is its own root. Minima are folded before
    each shuffle. A table of under ``WIDE`` edges holds no hub worth splitting;
    in a larger one the edges of a hub are salted before they are joined.
    Rounds go on until the edges are stars.
    """
    now, before = edges.select("u", "v").filter(F.col("u") != F.col("v")), None
    while True:
        wide, used = now.count() >= WIDE, []
        now = materialise(_small_star(_large_star(now, wide, used), wide, used), "stars")
        discard(edges.sparkSession, *used)
        if before is not None:
            discard(edges.sparkSession, before)
        before = now
        # done when the edges are stars: no root has a root itself, no node has two
        roots = now.select(F.col("v").alias("u"), F.lit(1).alias("n")).distinct()
        more = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).unionByName(roots.withColumn("n", F.lit(1).cast("long")))
        if more.groupBy("u").agg(F.sum("n").alias("n")).filter("n > 1").isEmpty():
            return now.select("u", F.col("v").alias("root"))
