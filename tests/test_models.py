"""Scorers by name, embeddings, and the table function for questions."""

import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from granary.operators import decompose, scorers


def test_unknown_names_raise(spark):
    df = spark.createDataFrame([("a", "b")], "query string, content string")
    with pytest.raises(ValueError, match="unknown model nobody"):
        scorers.scored(df, "nobody")
    with pytest.raises(ValueError, match="there are hashing"):
        scorers.embedded(df, "nobody", text="query")


def test_a_model_is_loaded_once_a_worker(spark, tmp_path, monkeypatch):
    path = str(tmp_path)

    def loader():
        open(f"{path}/{os.getpid()}-{len(os.listdir(path))}", "w").close()
        return lambda queries, texts: [float(len(t)) for t in texts]

    monkeypatch.setitem(scorers.SCORERS, "counted", loader)
    df = spark.range(400).select(F.lit("q").alias("query"), F.repeat(F.lit("x"), F.col("id").cast("int") % 9).alias("content"), "id").repartition(16)
    got = scorers.scored(df, "counted", most_chars=20).collect()
    assert all(r.score == r.id % 9 for r in got) and len(got) == 400
    workers = [name.split("-")[0] for name in os.listdir(path)]
    assert len(workers) == len(set(workers)) <= 8


def test_batches_are_bounded_and_a_failing_one_has_a_value(spark, monkeypatch):
    def loader():
        def score(queries, texts):
            assert sum(map(len, queries + texts)) <= 10 or len(texts) == 1
            if "bad" in texts:
                raise RuntimeError
            return [1.0] * len(texts)

        return score

    monkeypatch.setitem(scorers.SCORERS, "touchy", loader)
    df = spark.createDataFrame([("q", "fine fine"), ("q", "bad"), (None, None), ("q", "x" * 50)], "query string, content string").coalesce(1)
    got = {r.content: r.score for r in scorers.scored(df, "touchy", most_chars=10, failure=-1.0).collect()}
    assert got == {"fine fine": 1.0, "bad": -1.0, None: -1.0, "x" * 50: 1.0}  # the null row shares the bad one's batch
    assert scorers.scored(df.limit(0), "touchy").count() == 0


@pytest.mark.parametrize("sizes, most, want", [([3, 3, 3], 6, [(0, 2), (2, 3)]), ([9, 1], 5, [(0, 1), (1, 2)]), ([], 5, []), ([0, 0], 5, [(0, 2)])])
def test_slices_by_size(sizes, most, want):
    assert [(s.start, s.stop) for s in scorers.by_size([["x" * n for n in sizes]], most)] == want


def test_embeddings_are_unit_vectors_and_equal_on_every_worker(spark):
    texts = ["one two three", "three two one", "", None, "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {r.id: np.array(r.embedding) for r in scorers.embedded(df).collect()}
    want = scorers.hashing_embedder()([t or "" for t in texts])
    assert all(np.allclose(got[k], want[k]) for k in got) and (got[0] == got[4]).all()
    assert np.allclose(np.linalg.norm(got[0]), 1) and not got[2].any() and not got[3].any() and 0 < got[0] @ got[1] < 1


def test_rerank_by_name(spark):
    rows = [(1, 1, "a b", "x"), (1, 2, "a b", "b a"), (1, 3, "a b", "a"), (2, 1, "z", "y"), (2, 2, "z", "z")]
    hits = spark.createDataFrame(rows, "query_id long, rank int, query string, content string")
    got = sorted((r.query_id, r["rank"], r.content) for r in scorers.reranked(hits, "words", 2).collect())
    assert got == [(1, 1, "b a"), (1, 2, "a"), (2, 1, "y"), (2, 2, "z")]


D = ["a", "b", "c"]


@pytest.mark.parametrize(
    "domains, reply, want",
    [
        ([], None, [("startup_funding", "q", "single")]),
        (["a"], "junk", [("a", "q", "single")]),
        (D, None, [(d, "q", "fallback") for d in D]),
        (D, '{"sub_queries": [{"domain": "b", "query": "qb"}, {"domain": "z", "query": "no"}, {"domain": "a", "query": ""}]}', [("b", "qb", "reply"), ("a", "q", "completed"), ("c", "q", "completed")]),
        (["a", "b"], 'Here:\n```json\n{"sub_queries": [{"domain": "a", "query": "1"}, {"domain": "a", "query": "2"}, {"domain": "b", "query": "3"}]}\n```', [("a", "1", "reply"), ("a", "2", "reply"), ("b", "3", "reply")]),
        (["a", "b"], "[1]", [("a", "q", "fallback"), ("b", "q", "fallback")]),
        (["a", "b"], '{"sub_queries": [3]}', [("a", "q", "fallback"), ("b", "q", "fallback")]),
        (["a", "b"], '{"other": []}', [("a", "q", "fallback"), ("b", "q", "fallback")]),
    ],
)
def test_sub_queries(domains, reply, want):
    assert decompose.sub_queries("q", domains, reply) == want


def test_the_function_in_sql(spark):
    name = decompose.register(spark)
    df = spark.createDataFrame([(1, "q", ["a", None, "b"], None), (2, None, None, None)], "id long, q string, d array<string>, r string")
    got = spark.sql(f"SELECT id, t.* FROM {{df}} AS x, LATERAL {name}(x.q, x.d, x.r) AS t", df=df)
    assert sorted(map(tuple, got.collect())) == [(1, "a", "q", "fallback"), (1, "b", "q", "fallback"), (2, "startup_funding", "", "single")]
    with pytest.raises(AnalysisException, match="domains must be"):
        spark.sql(f"SELECT * FROM {name}('q', 'a', '')")
