"""Sessions in a stream: upgrade, trimming, expiry, and a sink that fails."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from granary.streaming import sessions, state

TURN = "session_id long, user_id long, agent string, question string, answer string, at timestamp"
DAY = 86400
STORED = "session_id long, version int, user_id long, last_ms long, messages array<struct<role:string,content:string>>, turns array<struct<agent:string,question:string,answer:string,at_ms:long>>"


def turns_frame(spark, rows):
    """(session, user, question, seconds of a day) as turns; the answer is the question in capitals. Time 0 of a stream is late by itself."""
    return spark.createDataFrame([(s, u, None, q, q and q.upper(), DAY + float(t)) for s, u, q, t in rows], TURN.replace("timestamp", "double")).withColumn("at", F.timestamp_seconds("at"))


def stream_of(spark, path, *batches):
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def key(df):
    return sorted(map(str, df.collect()))


def random_turns(seed, n):
    rng = random.Random(seed)
    rows, now = [], 0
    for k in range(n):
        now += rng.choice([1, 30, 200, 900])
        rows.append((rng.randint(1, 12), rng.choice([None, 7, 8]), rng.choice(["", " \n", None, f" q{k} ", f"q{k}", f"q{k}"]), now))
    return rows


def test_a_stream_gives_what_the_finished_table_gives(spark, tmp_path):
    rows = random_turns(4, 300)
    how = {"ttl": 1000, "max_turns": 3}
    parts = [turns_frame(spark, rows[a : a + 100]) for a in (0, 100, 200)]
    whole = turns_frame(spark, rows)
    ended = sessions.run_sessions(stream_of(spark, str(tmp_path / "a"), *parts), "ended", messages=4, late="60 seconds", **how)
    sessions.into_store(ended, str(tmp_path / "ended"), str(tmp_path / "cp1")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "ended")).drop("batch")
    assert key(found) == key(sessions.ended_table(whole, late=60, **how)) and found.count() > 50
    held = sessions.run_sessions(stream_of(spark, str(tmp_path / "b"), *parts), "held", messages=4, late="60 seconds", **how)
    sessions.into_store(held, str(tmp_path / "held"), str(tmp_path / "cp2")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "held")).groupBy("session_id").agg(F.max_by(F.struct("n_turns", "messages"), "batch").alias("s")).select("session_id", "s.*")
    assert key(last) == key(sessions.held_table(whole, messages=4, **how))


def test_state_is_empty_once_all_sessions_have_ended(spark, tmp_path):
    first, far = turns_frame(spark, [(s, 1, "q", s) for s in range(5)]), turns_frame(spark, [(99, None, "end", 10**6)])
    ended = sessions.run_sessions(stream_of(spark, str(tmp_path / "in"), first, far), "ended", ttl=100)
    query = sessions.into_store(ended, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.session_id for r in rows.collect()) == list(range(5))
    held = spark.read.format("statestore").option("stateVarName", "about").load(str(tmp_path / "cp"))
    assert [r.key.session_id for r in held.collect()] == [99]


def test_stored_sessions_are_upgraded_and_trimmed(spark, tmp_path):
    said = [("user", f"old{k}") for k in range(5)]
    stored = spark.createDataFrame([(1, 1, 5, 1000 * DAY, said, None), (2, 2, 6, 1000 * DAY, said[:1], [("A", "oq", "oa", 0), ("A", "", "oa", 1)]), (3, 1, 7, 1000 * DAY, said, None)], STORED)
    rows = [(1, None, "x", 10), (2, None, "y", 10), (3, None, "late", 5000)]
    source = stream_of(spark, str(tmp_path / "in"), turns_frame(spark, rows))
    held = sessions.run_sessions(source, "held", ttl=1000, messages=4, stored=stored)
    sessions.into_store(held, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.session_id: (r.n_turns, [m.content for m in r.messages]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, ["old3", "old4", "x", "X"]), 2: (3, ["old0", "y", "Y"]), 3: (1, ["late", "LATE"])}
    far = turns_frame(spark, [(99, None, "end", 10**6)])
    ended = sessions.run_sessions(stream_of(spark, str(tmp_path / "in2"), turns_frame(spark, rows), far), "ended", ttl=1000, stored=stored)
    sessions.into_store(ended, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    left = sorted((r.session_id, r.user_id, r.agent, r.question) for r in spark.read.parquet(str(tmp_path / "out2")).collect())
    assert left == [(1, 5, "A0000001", "x"), (2, 6, "A", "oq"), (2, 6, "A0000001", "y")]


def test_what_the_sink_could_not_take_comes_again(spark, tmp_path):
    first, far = turns_frame(spark, [(s, 1, "q", s) for s in range(5)]), turns_frame(spark, [(99, None, "end", 10**6)])
    source = str(tmp_path / "in")
    stream_of(spark, source, first, far)
    live = lambda: sessions.run_sessions(spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(source), "ended", ttl=100)

    def down(batch, number):
        if batch.count():
            raise RuntimeError("the store is down")

    with pytest.raises(StreamingQueryException):
        live().writeStream.foreachBatch(down).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        sessions.into_store(live(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.session_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(5))


def test_a_session_resumed_in_time_goes_on(spark, tmp_path):
    rows = [(1, 1, "a", 0), (1, 1, "b", 999), (1, 1, "c", 1998), (1, 1, "d", 2998)]
    parts = [turns_frame(spark, [r]) for r in rows]
    ended = sessions.run_sessions(stream_of(spark, str(tmp_path / "in"), *parts), "ended", ttl=1000, late="0 seconds")
    sessions.into_store(ended, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.question for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at_ms").collect()] == ["a", "b", "c"]


def test_upgrade():
    assert sessions.upgraded(1, [{"role": "user", "content": "a"}], None) == ([("user", "a")], [])
    assert sessions.upgraded(2, None, json.loads('[{"agent": null, "question": "q", "answer": "a", "at_ms": 3}]')) == ([], [(None, "q", "a", 3)])


def test_windows_of_activity_and_first_rows_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0), (1, 100.0), (1, 9000.0), (2, 50.0), (3, 10.0**6)], "k long, s double").select("k", F.timestamp_seconds("s").alias("at"))
    live = stream_of(spark, str(tmp_path / "in"), rows)
    for name, df in (("active", state.sessions(live, "at", "k", gap="10 minutes")), ("first", state.first_seen(live, ["k"], "at"))):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start().awaitTermination()
    active = spark.read.parquet(str(tmp_path / "active"))
    assert sorted((r.k, r.n) for r in active.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "first")).collect()) == [1, 2, 3]
