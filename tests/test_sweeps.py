"""Sweeps run each configuration's own plan and share what the plans have in common."""

import pytest

from granary.operators import evaluation
from granary.plans import sweep_queries as sweeps


def test_plans_change_with_their_settings(spark, sf):
    runs = evaluation.swept(sweeps.retrieval_plan(spark, sf), sweeps.BASE, {"first": {"k": 1}, "none": {"floor": 2.0, "rescue": False}, "rescued": {"floor": 2.0}, "own": {"k": 1, "own": True}})
    by = {}
    for r in runs.collect():
        by.setdefault(r.config, {})[r.query_id] = (r.score, r.n_hits)
    assert len({len(v) for v in by.values()}) == 1  # every query in every run
    assert set(by["none"].values()) == {(0.0, 0)}
    assert {n for _, n in by["rescued"].values()} == {1} == {n for _, n in by["first"].values()}
    assert by["rescued"] == by["first"]  # the one row that is left is the nearest
    assert set(by["own"].values()) == {(1.0, 1)}  # a vector is nearest to itself
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 4


def test_unknown_settings_raise(spark, sf):
    with pytest.raises(ValueError, match="unknown settings: deep"):
        evaluation.swept(lambda k: None, {"k": 1}, {"x": {"deep": 1}})


def test_claims_without_a_distance_are_not_covered(spark):
    claims = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 30)], "question_id long, claim_id long")
    near = spark.createDataFrame([(10, 0.9), (10, 0.2), (20, 0.6), (30, 0.1)], "claim_id long, distance double")
    got = {(r.overall, r.question_id): (r.coverage, r.n_claims) for r in evaluation.aligned_claims(claims, near, 0.5).collect()}
    assert got == {(False, 1): (0.5, 2), (False, 2): (0.0, 1), (False, None): (1.0, 1), (True, None): (0.5, 4)}
    empty = evaluation.aligned_claims(claims.limit(0), near, 0.5)
    assert all(r.overall and r.n_claims == 0 and r.coverage is None for r in empty.collect())
