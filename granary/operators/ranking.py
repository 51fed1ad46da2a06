"""Ranking operators over rows keyed by query: normalise, dedupe, fuse, merge, reorder.

Every order ends with a unique column, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_max(df: DataFrame, by: str = "query_id", score: str = "score") -> DataFrame:
    """Scores to 0..1 within each group; where all are equal, 1 if positive, else unchanged."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when(high > low, (F.col(score) - low) / (high - low)).when(high > 0, F.lit(1.0)).otherwise(F.col(score)))


def min_max_documents(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """As ``min_max``, but groups of one row and flat groups stay as they are."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(score, F.when((F.count(F.lit(1)).over(w) >= 2) & (high > low), (F.col(score) - low) / (high - low)).otherwise(F.col(score)))


def first_by(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def best_of_origin(df: DataFrame, by: str, origin: str, score: str, seq: str, standalone: Column | None = None) -> DataFrame:
    """One row per origin, the best by score (the first of equals); rows without origin, or standalone ones, all stay.

    Adds ``place``: groups in order of first appearance, then the others.
    """
    loose = F.col(origin).isNull() | (F.col(origin) == "")
    loose = loose | standalone if standalone is not None else loose
    w = Window.partitionBy(by, origin)
    ranked = df.withColumn("__loose", loose).withColumn("__first", F.when(F.col("__loose"), F.col(seq)).otherwise(F.min(seq).over(w)))
    ranked = ranked.withColumn("__n", F.row_number().over(Window.partitionBy(by, origin, "__loose").orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), seq)))
    kept = ranked.filter(F.col("__loose") | (F.col("__n") == 1))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__loose", "__first"))).drop("__loose", "__first", "__n")


def top(df: DataFrame, k: int | Column, by: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; a constant k prunes before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def fuse(lists: DataFrame, key: str, *, k: int = 30, weighted: bool = True, zero_based_rank: bool = True) -> DataFrame:
    """Reciprocal rank fusion: query_id, key, score.

    ``lists`` has query_id, list_no, rank (from 1), weight and the key column.
    Weighted: each list's weight over the sum of the query's list weights,
    divided by k + rank. Unweighted: 1 / (k + rank - 1). A key that recurs in
    one list counts each time.
    """
    if weighted:
        weights = lists.groupBy("query_id", "list_no").agg(F.first("weight").alias("weight")).groupBy("query_id").agg(F.sum("weight").alias("__all"))
        lists = lists.join(weights, "query_id").withColumn("__part", F.col("weight") / F.col("__all") / (k + F.col("rank")))
    else:
        lists = lists.withColumn("__part", 1 / (k + F.col("rank") - (1 if zero_based_rank else 0)))
    return lists.groupBy("query_id", key).agg(F.sum("__part").alias("score"))


def sandwich(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """``place``: the best first and last, the weakest in the middle; up to three rows keep their order."""
    w = Window.partitionBy(by).orderBy(*order)
    n, r = F.count(F.lit(1)).over(Window.partitionBy(by)), F.row_number().over(w)
    ranked = df.withColumn("__n", n).withColumn("__r", r)
    key = F.when((F.col("__n") <= 3) | (F.col("__r") % 2 == 1), F.col("__r")).otherwise(2 * F.col("__n") + 2 - F.col("__r"))
    return ranked.withColumn("__key", key).withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("__key"))).drop("__n", "__r", "__key")


def above_or_first(df: DataFrame, by: str, score: str, rank: str, least: float) -> DataFrame:
    """Rows of at least ``least``; where a group has none, its first row."""
    some = F.max((F.coalesce(F.col(score), F.lit(0.0)) >= least).cast("int")).over(Window.partitionBy(by))
    return df.withColumn("__some", some).filter((F.col(score) >= least) | ((F.col("__some") == 0) & (F.col(rank) == 1))).drop("__some")


def with_relaxation(df: DataFrame, by: str, matches: Column, least: int = 2) -> DataFrame:
    """Rows that match the filter; all rows of a group where fewer than ``least`` do."""
    n = F.sum(F.coalesce(matches, F.lit(False)).cast("int")).over(Window.partitionBy(by))
    return df.withColumn("__hit", F.coalesce(matches, F.lit(False))).withColumn("__n", n).filter(F.col("__hit") | (F.col("__n") < least)).drop("__hit", "__n")


def guaranteed(df: DataFrame, by: str, group: str, k: int, slots: int, order: list[Column], rerank: list[Column]) -> DataFrame:
    """``slots`` rows of each group by ``order`` first, the places left over by ``rerank``; adds ``rank``."""
    own = F.row_number().over(Window.partitionBy(by, group).orderBy(*order))
    ranked = df.withColumn("__own", own).withColumn("__safe", F.col("__own") <= slots)
    place = F.row_number().over(Window.partitionBy(by, "__safe").orderBy(*rerank))
    safe_place = F.row_number().over(Window.partitionBy(by, "__safe").orderBy(group, "__own"))
    placed = ranked.withColumn("__place", F.when(F.col("__safe"), safe_place).otherwise(place))
    return placed.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("__safe").desc(), "__place"))).filter(F.col("rank") <= k).drop("__own", "__safe", "__place")


def merge_collections(hits: DataFrame, budgets: DataFrame, max_total: int = 15) -> DataFrame:
    """Merge per-collection hits of each query: dedupe by content over collections, normalise and keep the best
    chunk of an origin within each, cut at its budget, order by priority, cut at the total.

    ``hits``: query_id, collection, seq (unique in a query), content_key, origin, score; ``budgets``: query_id,
    collection, budget, priority. Adds ``rank``.
    """
    hits = hits.join(budgets, ["query_id", "collection"], "left").withColumn("priority", F.coalesce("priority", F.lit(99)))
    hits = first_by(hits, [F.col("query_id"), F.col("content_key")], [F.col("seq")])
    hits = min_max_documents(hits, ["query_id", "collection"])
    hits = hits.withColumn("__group", F.concat_ws("/", "query_id", "collection"))
    hits = best_of_origin(hits, "__group", "origin", "score", "seq")
    own = F.row_number().over(Window.partitionBy("__group").orderBy(F.col("score").desc(), "place"))
    hits = hits.withColumn("__own", own).filter(F.col("budget").isNull() | (F.col("__own") <= F.col("budget")))
    ranked = top(hits, max_total, "query_id", [F.col("priority"), F.col("collection"), F.col("__own")])
    return ranked.drop("__group", "__own", "place")


def bounded_budgets(queries: DataFrame, *, retrieval_k: int = 4, max_total: int = 15, least: int = 3) -> DataFrame:
    """query_id, domain, budget, priority from query_id, domains (array) and k: an equal share for each domain."""
    n, k = F.size("domains"), F.least(F.col("k"), F.lit(retrieval_k))
    most = F.greatest(F.lit(max_total), n * retrieval_k)
    share = F.when((n > 1) & (k * n > most), F.greatest(F.lit(least), F.floor(most / n))).otherwise(k)
    return queries.select("query_id", share.cast("int").alias("budget"), F.posexplode("domains").alias("__i", "domain")).select("query_id", "domain", "budget", (F.col("__i") + 1).alias("priority"))


def proportional_budgets(queries: DataFrame, *, max_total: int = 15, primary_ratio: float = 0.6, many_ratio: float = 0.5) -> DataFrame:
    """As ``bounded_budgets``, the first domain taking a fixed share of the total."""
    n = F.size("domains")
    first = F.when(n == 1, F.least(F.col("k"), F.lit(max_total))).when(n == 2, F.ceil(F.lit(max_total * primary_ratio))).otherwise(F.ceil(F.lit(max_total * many_ratio)))
    rest = F.when(n == 2, max_total - first).otherwise(F.greatest(F.lit(1), F.floor((max_total - first) / F.greatest(n - 1, F.lit(1)))))
    budget = F.when(F.col("__i") == 0, F.col("__first")).otherwise(F.col("__rest"))
    return queries.select("query_id", first.alias("__first"), rest.alias("__rest"), F.posexplode("domains").alias("__i", "domain")).select("query_id", "domain", budget.cast("int").alias("budget"), (F.col("__i") + 1).alias("priority"))
