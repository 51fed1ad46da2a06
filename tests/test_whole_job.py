"""Operators and queries take the whole of their input."""

import numpy as np
import pytest

from granary import plans
from granary.operators import search
from granary.streaming import state


def test_blocks_of_queries_meet_all_vectors(spark):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(90, 6))
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    q = e.filter("vec_id % 2 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    found = search.vector(e, q, 4, block=7, cells=5)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    distance = np.round(1 - unit @ unit.T, 9)
    want = {(i, r + 1, int(j)) for i in range(0, 90, 2) for r, j in enumerate(np.lexsort((np.arange(90), distance[i]))[:4])}
    assert {(r.query_id, r.rank, r.vec_id) for r in found.collect()} == want


def test_mmr_takes_every_fiftieth_vector(spark, sf):
    wanted = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    assert {r.query_id for r in plans.QUERIES["i07_mmr"](spark, sf).collect()} == wanted


def test_a_hot_client_goes_through_in_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(None if c == 5 else int(c), i, float(t)) for i, (c, t) in enumerate(zip(rng.choice([1, 1, 1, 2, 3, 5], 300), rng.integers(0, 200, 300), strict=True))]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = state.token_bucket_batch(spark.createDataFrame(rows, "client long, request_id long, at double").repartition(3), 0.5, 3.0)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r.client, r.request_id, r.allowed, r.tokens, r.retry_after) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = set()
    for c in {r[0] for r in rows}:
        own = sorted((t, i) for k, i, t in rows if k == c)
        answers, _, _ = state.take([t for t, _ in own], 3.0, own[0][0], 0.5, 3.0)
        want |= {(c, i, *a) for (_, i), a in zip(own, answers, strict=True)}
    assert got == want and len(got) == 300
