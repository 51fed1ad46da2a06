"""Steps whose pairs must not grow with the product of two tables."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from functools import reduce

import duckdb
import numpy as np
import pytest

from granary import plans
from granary.operators import nearest, ranking, search, tables
from granary.plans import retrieval_queries


def test_customers_of_one_range_are_joined_once(spark, tmp_path, monkeypatch):
    day = dt.datetime(1995, 1, 5)
    customers = [(k * 1000, "Customer#7") for k in range(50)]
    orders = [(10 * k + 7, day + dt.timedelta(days=k % 3)) for k in range(60)]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    joined, join = [], tables.prefix_range_join
    monkeypatch.setattr(tables, "prefix_range_join", lambda *a: joined.append(join(*a)) or joined[-1])
    found = plans.QUERIES["j05_prefix_range_join"](spark, str(tmp_path)).collect()
    newest = max(orders, key=lambda x: (x[1], x[0]))[0]
    assert sorted(map(tuple, found)) == [(c, 60, newest) for c, _ in customers]
    assert joined[0].count() <= 3  # one range, three times; 50 * 60 pairs before


@pytest.fixture
def ranked(monkeypatch):
    """The rows among which first ones are looked for."""
    seen, top = [], ranking.top
    monkeypatch.setattr(ranking, "top", lambda df, *a, **k: seen.append(df) or top(df, *a, **k))
    return seen


def test_only_the_nearest_of_a_cell_leave_it(spark, ranked):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 300, axis=0)])[rng.permutation(600)]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    q = e.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    distance = np.round(1 - unit @ unit.T, 9)
    want = {(i, r + 1, int(j)) for i in range(0, 600, 50) for r, j in enumerate(np.lexsort((np.arange(600), distance[i]))[:3])}
    assert {(r.query_id, r.rank, r.vec_id) for r in search.vector(e, q, 3, cells=4).collect()} == want
    assert ranked[0].count() <= 12 * 3 * 4  # 12 * 600 before


@pytest.mark.parametrize("digits", [9, 12])
def test_only_the_nearest_of_each_label_leaves_a_cell(spark, monkeypatch, digits):
    rng = np.random.default_rng(9)
    seeds = rng.normal(size=(60, 8))
    vectors = np.concatenate([seeds, seeds + rng.normal(size=seeds.shape) * 1e-13, np.repeat(seeds[:1], 180, axis=0)])[rng.permutation(300)]  # near and exact copies
    labels = [int(x) for x in rng.integers(0, 5, 300)]
    e = spark.createDataFrame([(i, x.tolist(), c) for i, (x, c) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int").repartition(3)
    q = e.filter("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    met, seen = search.met, []
    monkeypatch.setattr(search, "met", lambda *a: seen.append(met(*a)) or seen[-1])
    found = {(r.query_id, r.label): r.similarity for r in search.nearest_of_each(e, q, "label", 0.3, digits=digits, block=7, cells=4).collect()}
    dot = lambda a, b: reduce(lambda s, x: s + x, (a * b).tolist(), 0.0)
    norms, want = [math.sqrt(dot(x, x)) for x in vectors], {}
    for i in range(0, 300, 10):
        for j in set(range(300)) - {i}:
            value = 1 - nearest.rounded(np.array([1 - dot(vectors[i], vectors[j]) / (norms[i] * norms[j])]), digits)[0] / 10.0**digits
            if value >= 0.3:
                want[i, labels[j]] = max(value, want.get((i, labels[j]), 0.3))
    assert found == want
    assert seen[0].count() <= 30 * 5 * 4  # 30 * 299 before


@pytest.mark.parametrize("kind", ["float", "double"])
def test_lookup_of_odd_vectors_equals_its_sql(spark, tmp_path, kind):
    inf, rng = float("inf"), np.random.default_rng(10)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(90)]
    rows[50] = (50, [0.0] * 4, 1)
    rows += [(100, [1.0, 0.0, 0.0, 0.0], 9), (101, [0.0] * 4, 4), (102, [inf, 1.0, 0.0, 0.0], 5), (103, None, 6), (None, [1.0, 0.0, 0.0, 0.0], 7), (104, [1.0, 0.0, 0.0, 0.1], None), (0, [0.0, 1.0, 0.0, 0.0], 8), (150, None, 2)]
    rows += [(200 + i, [c, math.sqrt(1 - c * c), 0.0, 0.0], 10 + i) for i, c in enumerate(np.arange(0.3000005, 0.6, 0.002).tolist() + [0.5047875]) if (200 + i) % 50]  # halves of the last digit that is left
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    sql = duckdb.connect()
    sql.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sql.sql(f"SELECT query_id, label, similarity FROM ({plans.SQL['j11_lookup_max']})").fetchall()
    df = plans.QUERIES["j11_lookup_max"](spark, str(tmp_path))
    assert "CoGroup" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))


def test_vectors_without_a_distance_come_last(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 1.0]), (6, [1.0]), (50, None), (7, [-1.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    found = search.vector(e, q, 9, cells=2).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in found] == [0, 5, 7, 2, 4, 1, 3, 6, 50] + [0, 1, 2, 3, 4, 5, 6, 7, 50]
    assert [r.distance for r in found[:3]] == [0.0, 1.0, 2.0] and all(math.isnan(r.distance) for r in found[3:5]) and all(r.distance is None for r in found[5:])


@pytest.mark.parametrize("how", [{}, {"cell": 30, "block": 2}])
def test_only_the_best_documents_of_a_cell_leave_it(spark, ranked, how):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{chr(96 + x)}" for x in rng.zipf(1.6, rng.integers(1, 40)) if x < 27) for _ in range(100)] + ["wa wb wb wc"] * 60 + [None]
    docs = [*enumerate(texts), (7, texts[7])]  # a row twice
    queries = [(1, "wa wb we wb"), (2, "wc"), (3, "nothing"), (4, "wa wd wz"), (5, None)]
    found = search.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), 4, **how)
    sizes = [len((t or "").split()) for _, t in docs]
    n, mean = len(docs), sum(sizes) / len(docs)
    tf = [Counter((t or "").split()) for t in texts]
    tf[7] = Counter({w: 2 * c for w, c in tf[7].items()})
    want = {}
    for q, line in queries:
        score = {}
        for i, held in enumerate(tf):
            for w, times in Counter((line or "").split()).items():
                if held[w]:
                    df = sum(1 for x in tf if x[w])
                    score[i] = score.get(i, 0) + times * math.log((n - df + 0.5) / (df + 0.5) + 1) * held[w] * 2.5 / (held[w] + 1.5 * (0.25 + 0.75 * sizes[i] / mean))
        score = {i: round(x, 9) for i, x in score.items()}
        low, high = min(score.values(), default=0), max(score.values(), default=0)
        for r, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:4], 1):
            want[q, r] = (i, round((score[i] - low) / (high - low), 9))
    assert {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in found.collect()} == want
    assert ranked[0].count() <= 4 * 4 * (6 if how else 1)


def test_halves_are_rounded_as_spark_rounds(spark):
    values = [0.1234567895, -0.1234567895, 0.5e-9, 1.4999999999e-9, 2.5, -0.0, 1.0000000005, 0.3333333335]
    rows = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("round(v, 9) AS r").collect()
    assert [k / 1e9 for k in nearest.rounded(np.array(values), 9)] == [r.r for r in rows]


def test_documents_stay_where_they_are_while_hits_come_to_them(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # the documents are larger, hits and benchmark are not
    try:
        plan = retrieval_queries.hits(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["u06_without_copies", "i08_single_query", "i17_graduated_retry", "i20_final_rerank"])
def test_documents_are_read_for_hits_once(spark, sf, name):
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan  # what is left reads the hits that were written
