"""Evaluation of answers and retrieval by rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import contains_term


def _share(answer: Column, terms: Column) -> Column:
    """Part of the terms that the answer contains; null without terms."""
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.size(F.filter(terms, lambda t: contains_term(answer, t))) / F.size(terms))


def contextual(answer: Column, directives: Column, context: Column, forbidden: Column) -> Column:
    """struct(directive_coverage, context_adherence, conflict_free, score): the score is the mean of those that apply."""
    a, b = _share(answer, directives), _share(answer, context)
    clean = F.when(F.size(F.coalesce(forbidden, F.array().cast("array<string>"))) > 0, F.when(F.exists(forbidden, lambda t: contains_term(answer, t)), 0.0).otherwise(1.0))
    parts = F.array_compact(F.array(a, b, clean))
    score = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))
    return F.struct(a.alias("directive_coverage"), b.alias("context_adherence"), clean.alias("conflict_free"), score.alias("score"))


def ci_gate(runs: DataFrame, floors: dict[str, float], *, most_timeouts: int, most_ratio: float, timeout: str = "timeout") -> DataFrame:
    """One row: each metric's mean over runs that have it, and whether all floors and timeout limits hold.

    A metric that no run has, or that is no column, is skipped.
    """
    held = {m: f for m, f in floors.items() if m in runs.columns}
    n_out = F.sum(F.coalesce(F.col(timeout), F.lit(False)).cast("int"))
    one = runs.agg(*[F.avg(m).alias(m) for m in held], F.coalesce(n_out, F.lit(0)).alias("timeouts"), F.count(F.lit(1)).alias("runs"))
    for m, f in held.items():
        one = one.withColumn(f"{m}_passed", F.coalesce(F.col(m) >= f, F.lit(True)))
    one = one.withColumn("count_passed", F.col("timeouts") <= most_timeouts).withColumn("ratio_passed", F.coalesce(F.try_divide(F.col("timeouts"), F.col("runs")), F.lit(0.0)) <= most_ratio)
    passed = F.col("count_passed") & F.col("ratio_passed")
    for m in held:
        passed = passed & F.col(f"{m}_passed")
    return one.withColumn("passed", passed)


def aligned_claims(claims: DataFrame, nearest: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Coverage per question and, with a null id and ``overall`` set, over all claims: share of claims whose best distance is within the threshold.

    ``claims``: question_id, claim_id; ``nearest``: claim_id, distance (any
    number of rows; a claim without one is not covered).
    """
    best = nearest.groupBy("claim_id").agg(F.min("distance").alias("best"))
    per = claims.join(best, "claim_id", "left").withColumn("covered", F.coalesce(F.col("best") <= threshold, F.lit(False)))
    return per.rollup("question_id").agg((F.grouping("question_id") == 1).alias("overall"), F.avg(F.col("covered").cast("int")).alias("coverage"), F.count(F.lit(1)).alias("n_claims"))


def swept(plan: Callable[..., DataFrame], base: dict[str, Any], overrides: dict[str, dict[str, Any]]) -> DataFrame:
    """The rows of ``plan(**settings)`` under ``base`` and under each stated override of it, with the name as ``config``.

    Each configuration is a plan of its own, so a setting may change any step;
    what the plans have in common is shuffled once, as Spark reuses equal
    exchanges. Unknown settings raise an error.
    """
    strange = {k for o in overrides.values() for k in o} - base.keys()
    if strange:
        raise ValueError(f"unknown settings: {', '.join(sorted(strange))}")
    runs = [plan(**base | o).withColumn("config", F.lit(name)) for name, o in ({"base": {}} | overrides).items()]
    return reduce(DataFrame.unionByName, runs)


def config_grid(runs: DataFrame, scores: Sequence[str], digits: int = 6) -> DataFrame:
    """config, the mean of each score, and place by the first; one row for each configuration of a stated grid."""
    means = runs.groupBy("config").agg(*[F.round(F.avg(c), digits).alias(c) for c in scores])
    return means.withColumn("place", F.rank().over(Window.orderBy(F.col(scores[0]).desc())))


def toggle_sweep(runs: DataFrame, config: str, score: str, base: str, digits: int = 6) -> DataFrame:
    """config, mean, diff to the base configuration, and place; one row for each configuration of a stated grid."""
    means = runs.groupBy(config).agg(F.round(F.avg(score), digits).alias("mean"))
    first = means.filter(F.col(config) == base).select(F.col("mean").alias("__base"))
    both = means.join(F.broadcast(first), F.lit(True), "left")  # one row
    return both.select(config, "mean", F.round(F.col("mean") - F.col("__base"), digits).alias("diff"), F.rank().over(Window.orderBy(F.col("mean").desc())).alias("place"))
