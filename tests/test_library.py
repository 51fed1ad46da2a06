"""Chunking, ranking, sources and streams on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import ranking, search, tables
from granary.plans.registry import table
from granary.sources import files, schemas
from granary.streaming import state


def test_best_of_origin_puts_loose_rows_last(spark):
    df = spark.createDataFrame([(1, 1, None, 0.9), (1, 2, "a", 0.2), (1, 3, "a", 0.5), (1, 4, "b", 0.5), (1, 5, "a", 0.5)], "q long, seq int, origin string, score double")
    found = [(r.seq, r.place) for r in ranking.best_of_origin(df, "q", "origin", "score", "seq").orderBy("place").collect()]
    assert found == [(3, 1), (4, 2), (1, 3)]


def test_fusion_does_not_change_when_weights_scale(spark):
    rows = [(1, 0, 1, 0.7, 10), (1, 0, 2, 0.7, 11), (1, 1, 1, 0.3, 11)]
    one = spark.createDataFrame(rows, "query_id long, list_no int, rank int, weight double, id long")
    two = one.withColumn("weight", F.col("weight") * 5)
    get = lambda df: {r.id: round(r.score, 9) for r in ranking.fuse(df, "id").collect()}
    assert get(one) == get(two) == {10: round(0.7 / 31, 9), 11: round(0.7 / 32 + 0.3 / 31, 9)}


def test_mmr_against_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(12, 5)), rng.normal(size=5)
    df = spark.createDataFrame([(1, i, q.tolist(), x.tolist()) for i, x in enumerate(v)], "query_id long, id long, q array<double>, v array<double>")
    u, w = v / np.linalg.norm(v, axis=1, keepdims=True), q / np.linalg.norm(q)
    chosen = []
    while len(chosen) < 5:
        chosen.append(max((i for i in range(12) if i not in chosen), key=lambda i: 0.6 * u[i] @ w - 0.4 * max((u[i] @ u[j] for j in chosen), default=0)))
    assert [r.id for r in search.mmr(df, 5).orderBy("rank").collect()] == chosen


@pytest.mark.parametrize("ranks", [(1, 2, 4, 5, 6), (6, 5, 4, 2, 1), (6, 4, 1, 2, 5)])
def test_a_mean_on_the_floor_passes_in_any_order_of_rows(spark, ranks):
    rows = [(1, "tax", "tax", 1 - r / 10.0) for r in ranks]  # 3.2 / 5
    hits = spark.createDataFrame(rows, "query_id long, query string, content string, similarity double").coalesce(1)
    assert [(r.similarity, r.passed) for r in search.gate(hits, least_similarity=0.64).collect()] == [(0.64, True)]


def test_incomplete_source_deactivates_nothing(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], "source string, id int, v int")
    new = spark.createDataFrame([("a", 3, 1)], "source string, id int, v int")
    done = spark.createDataFrame([("a",)], "source string")
    found = {r.id: r.action for r in tables.snapshot_actions(old, new, ["source", "id"], ["v"], "source", done).collect()}
    assert found == {1: "deactivate", 2: "keep", 3: "insert"}


def test_latency_of_skewed_group(spark):
    df = spark.range(100).select(F.lit("x").alias("k"), F.when(F.col("id") < 90, 1.0).otherwise(F.col("id").cast("double")).alias("v"))
    r = tables.latency(df, ["k"], "v", F.col("v") > 95).first()
    assert (r.n, r.p50, r.p95, r.p99, r.error_rate) == (100, 1.0, 95.0, 99.0, 0.04)


def test_sources(spark, tmp_path):
    good = {"id": 1, "question": "q", "domain": "d", "expected_keywords": ["k"]}
    (tmp_path / "b.jsonl").write_text(json.dumps(good) + "\n\n{broken\n")
    assert files.json_lines(spark, str(tmp_path / "b.jsonl"), schemas.BENCHMARK).count() == 1
    rows, bad = files.json_lines_with_rejects(spark, str(tmp_path / "b.jsonl"), schemas.BENCHMARK)
    assert rows.count() == 1 and bad.first().line == "{broken"
    (tmp_path / "bizinfo_1.json").write_text(json.dumps({"total_count": 2, "data": [{"id": "1"}, {"id": "2"}]}))
    assert files.enveloped(spark, str(tmp_path / "bizinfo_*.json"), "id string").count() == 2
    (tmp_path / "laws.json").write_text(json.dumps({"laws": [{"law_id": "L", "name": "N", "articles": [{"number": "1", "title": "T", "content": "c", "clauses": [{"number": "1", "content": "d", "items": [{"number": "1", "content": "e"}]}]}, {"number": "2", "content": "삭제"}]}]}))
    assert [r.content.split() for r in files.law_articles(spark, str(tmp_path / "laws.json")).collect()] == [["c", "d", "e"]]
    (tmp_path / "c.csv").write_bytes("코드,상태\n1,존재\n2,폐지\n".encode("euc-kr"))
    assert files.legacy_csv(spark, str(tmp_path / "c.csv"), keep=F.col("상태") == "존재").count() == 1
    (tmp_path / "x.xml").write_text('<r><item><col name="a"> 1 </col><col name="b">2</col></item></r>')
    assert files.xml_items(spark, str(tmp_path / "x.xml")).first().cols == {"a": "1", "b": "2"}
    (tmp_path / "q.md").write_text("# T\n### QA-001\n- 질문: 가\n- 답: 나\n### QA-002\n- 질문: 다\n")
    parts = files.sections(spark, str(tmp_path / "q.md"), "### QA-")
    got = files.labelled_fields(parts, {"question": [r"질문: (.*)"], "answer": [r"정답: (.*)", r"답: (.*)"]}, ["question", "answer"])
    assert [(r.question, r.answer) for r in got.collect()] == [("가", "나")]
    (tmp_path / "log.txt").write_text("\n".join(f"line {i}" for i in range(10)))
    assert [r.line for r in files.log_page(spark, str(tmp_path / "log.txt"), 2, 3).collect()] == ["line 6", "line 5", "line 4"]


def test_sinks(spark, tmp_path, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    files.write_json_lines(docs, str(tmp_path / "j"), by="lang")
    assert spark.read.json(str(tmp_path / "j")).count() == docs.count()
    assert files.rewrite_if_changed(docs, docs, "doc_id", str(tmp_path / "n")) == 0
    assert files.rewrite_if_changed(docs, docs.withColumn("text", F.lit("x")), "doc_id", str(tmp_path / "n")) == docs.count()


@pytest.fixture()
def stream(spark, sf, tmp_path):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), e


def drain(df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_windows_in_a_stream(stream, tmp_path):
    live, batch = stream
    found = drain(state.windowed(live, "ts", ["event_type"], "value", late="90 days"), tmp_path, "complete")
    want = state.windowed(batch, "ts", ["event_type"], "value")
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(found) == key(want)


def test_token_bucket_in_a_stream(spark, sf, tmp_path):
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    found = drain(state.token_bucket(live, 1 / 3600, 3.0), tmp_path)
    key = lambda df: sorted((r.request_id, r.allowed, round(r.tokens, 6)) for r in df.collect())
    assert key(found) == key(state.token_bucket_batch(e, 1 / 3600, 3.0))


def test_append_is_idempotent(spark, sf, tmp_path):
    c = table(spark, sf, "conversations").select("conv_id", "turn")
    c.write.parquet(str(tmp_path / "in"))
    for k in range(2):
        live = spark.readStream.schema(c.schema).parquet(str(tmp_path / "in"))
        state.append_new(live, str(tmp_path / "out"), str(tmp_path / f"cp{k}"), ["conv_id", "turn"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == c.distinct().count()
