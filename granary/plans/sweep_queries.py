"""Evaluations that run a retrieval plan: grids of settings, toggles, and claims looked up among the vectors.

A query is a vector, what it should find are the vectors of its label, and the
score of a run is the share of its hits that have it.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import evaluation, ranking
from granary.plans.registry import query, table
from granary.plans.search_queries import VECTOR_CTE, vector_hits

MOST = 15
BASE: dict[str, Any] = {"k": 5, "floor": 0.35, "rescue": True, "own": False}
GRID: dict[str, dict[str, Any]] = {"strict": {"floor": 0.6}, "wide": {"k": 12}, "open": {"floor": None, "k": 10}}
TOGGLES: dict[str, dict[str, Any]] = {"floor off": {"floor": None}, "rescue off": {"rescue": False}, "own on": {"own": True}, "first only": {"k": 1}} | {f"floor {x}": {"floor": x} for x in (0.2, 0.5, 0.7)}


def retrieval_plan(spark: SparkSession, d: str):
    """A plan by its settings: query_id, score, n_hits; a query without hits scores 0."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    queries = labels.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hits = vector_hits(spark, d, MOST).withColumn("similarity", 1 - F.col("distance"))

    def plan(k: int, floor: float | None, rescue: bool, own: bool) -> DataFrame:
        found = hits if own else hits.filter("vec_id <> query_id")
        found = ranking.top(found.drop("rank"), k, "query_id", [F.col("distance"), F.col("vec_id")])
        if floor is not None:
            found = ranking.above_or_first(found, "query_id", "similarity", "rank", floor) if rescue else found.filter(F.col("similarity") >= floor)
        judged = found.join(labels, "vec_id").join(queries, "query_id")
        per = judged.groupBy("query_id").agg(F.avg((F.col("label") == F.col("wanted")).cast("int")).alias("score"), F.count(F.lit(1)).alias("n_hits"))
        return queries.select("query_id").join(per, "query_id", "left").select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("score", "n_hits")])

    return plan


def run_sql(name: str, settings: dict[str, Any]) -> str:
    k, floor, rescue, own = (settings[x] for x in ("k", "floor", "rescue", "own"))
    kept = "true" if floor is None else f"(1 - distance >= {floor}" + (" OR (r = 1 AND best < {0}))".format(floor) if rescue else ")")
    ranked = f"SELECT query_id, vec_id, distance, row_number() OVER w AS r, max(1 - distance) OVER (PARTITION BY query_id) AS best FROM vec WHERE {'true' if own else 'vec_id <> query_id'} WINDOW w AS (PARTITION BY query_id ORDER BY distance, vec_id)"
    return f"""SELECT '{name}' AS config, q.vec_id AS query_id, coalesce(avg(CASE WHEN h.vec_id IS NOT NULL THEN CAST(b.label = q.label AS INTEGER) END), 0) AS score, count(h.vec_id) AS n_hits
    FROM e AS q LEFT JOIN (SELECT query_id, vec_id FROM ({ranked}) WHERE r <= {k} AND {kept}) AS h ON h.query_id = q.vec_id LEFT JOIN e AS b ON b.vec_id = h.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id"""


def runs_sql(overrides: dict[str, dict[str, Any]]) -> str:
    return " UNION ALL ".join(run_sql(name, BASE | o) for name, o in ({"base": {}} | overrides).items())


@query(f"WITH {VECTOR_CTE}, runs AS ({runs_sql(GRID)}), m AS (SELECT config, round(avg(score), 6) AS score, round(avg(n_hits), 6) AS n_hits FROM runs GROUP BY config) SELECT *, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS place FROM m")
def e04_config_grid(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.config_grid(evaluation.swept(retrieval_plan(spark, d), BASE, GRID), ["score", "n_hits"])


@query(
    f"""WITH {VECTOR_CTE}, runs AS ({runs_sql(TOGGLES)}), m AS (SELECT config, round(avg(score), 6) AS mean FROM runs GROUP BY config)
    SELECT config, mean, round(mean - (SELECT mean FROM m WHERE config = 'base'), 6) + 0.0 AS diff, CAST(rank() OVER (ORDER BY mean DESC) AS INTEGER) AS place FROM m"""
)
def e05_toggle_sweep(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.toggle_sweep(evaluation.swept(retrieval_plan(spark, d), BASE, TOGGLES), "config", "score", "base").withColumn("diff", F.col("diff") + 0.0)


@query(
    f"""WITH {VECTOR_CTE}, best AS (SELECT query_id, min(distance) AS best FROM vec WHERE vec_id <> query_id AND rank <= 4 GROUP BY query_id),
    c AS (SELECT label AS question_id, CASE WHEN best <= 0.65 THEN 1 ELSE 0 END AS covered FROM e LEFT JOIN best ON query_id = vec_id WHERE vec_id % 50 = 0)
    SELECT question_id, grouping(question_id) = 1 AS overall, round(avg(covered), 6) AS coverage, count(*) AS n_claims FROM c GROUP BY ROLLUP (question_id)"""
)
def e06_aligned_claims(spark: SparkSession, d: str) -> DataFrame:
    """Each query vector is a claim of the question that its label names; the nearest others are what the store holds on it."""
    claims = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("label").alias("question_id"), F.col("vec_id").alias("claim_id"))
    near = vector_hits(spark, d, 4).filter("vec_id <> query_id").select(F.col("query_id").alias("claim_id"), "distance")
    return evaluation.aligned_claims(claims, near, 0.65).withColumn("coverage", F.round("coverage", 6))
