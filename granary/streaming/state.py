"""Structured Streaming operators: rate limits, sessions, windows, exactly-once appends.

Each has a batch twin or a fold that the tests compare it with.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def refill(tokens: float, last: float, now: float, rate: float, capacity: float) -> float:
    return min(capacity, tokens + max(0.0, now - last) * rate)


def take(times: list[float], tokens: float, last: float, rate: float, capacity: float) -> tuple[list[tuple[bool, float, float]], float, float]:
    """Each request in turn: (allowed, tokens left, seconds until one is there), then the new state."""
    out = []
    for now in times:
        tokens, last = refill(tokens, last, now, rate, capacity), max(last, now)
        allowed = tokens >= 1
        tokens -= 1.0 if allowed else 0.0
        out.append((allowed, tokens, 0.0 if allowed else (1 - tokens) / rate))
    return out, tokens, last


def token_bucket(requests: DataFrame, rate: float = 10.0, capacity: float = 100.0, *, late: str = "1 day") -> DataFrame:
    """client, request_id, allowed, tokens, retry_after from (client, request_id, at in seconds).

    The state of a client is two numbers. It is dropped once the stream's time
    says that its bucket has filled up again; timers follow event time, so a
    finished input ends the query. Requests of one batch are taken in order of
    time and id; those more than ``late`` behind the newest are not answered.
    """
    full_after = capacity / rate

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "request_id"])
        tokens, last = state.get if state.exists else (capacity, float(rows["at"].iloc[0]))
        found, tokens, last = take(rows["at"].tolist(), tokens, last, rate, capacity)
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + full_after) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"].to_numpy(), "allowed": [a for a, _, _ in found], "tokens": [t for _, t, _ in found], "retry_after": [w for _, _, w in found]})

    timed = requests.withColumn("__ts", F.timestamp_seconds("at")).withWatermark("__ts", late)
    return timed.groupBy("client").applyInPandasWithState(
        step, "client long, request_id long, allowed boolean, tokens double, retry_after double", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout
    )


def token_bucket_batch(requests: DataFrame, rate: float = 10.0, capacity: float = 100.0) -> DataFrame:
    """The same over a finished table; Spark sorts, and a task holds one batch and the state of one client."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, last = (), capacity, 0.0
        for b in batches:
            out = []
            for key, run in groupby(zip(b.column("client").to_pylist(), b.column("at").to_pylist(), strict=True), lambda r: r[:1]):
                times = [at for _, at in run]
                if key != held:
                    held, tokens, last = key, capacity, times[0]
                found, tokens, last = take(times, tokens, last, rate, capacity)
                out += found
            parts = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.bool_(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("client"), b.column("request_id"), *parts], names=["client", "request_id", "allowed", "tokens", "retry_after"])

    rows = requests.select(F.col("client").cast("long"), F.col("request_id").cast("long"), F.col("at").cast("double"))
    return rows.repartition("client").sortWithinPartitions("client", "at", "request_id").mapInArrow(fold, "client long, request_id long, allowed boolean, tokens double, retry_after double")


def windowed(events: DataFrame, at: str, by: list[str], value: str, *, length: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums per window; rows later than ``late`` behind the newest are dropped in a stream."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return events.withWatermark(at, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, *, gap: str = "75 minutes", late: str = "2 hours") -> DataFrame:
    """A session ends after ``gap`` without activity."""
    return events.withWatermark(at, late).groupBy(by, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, key: list[str], at: str, *, within: str = "1 day") -> DataFrame:
    """Each key once within the time that the stream remembers."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def append_new(stream: DataFrame, path: str, checkpoint: str, key: list[str]) -> Any:
    """A query that appends rows whose key the target does not hold yet, and stops when the input is read."""

    stream.sparkSession.createDataFrame([], stream.schema).write.mode("append").parquet(path)  # from here on there is a table

    def sink(batch: DataFrame, _: int) -> None:
        held = batch.sparkSession.read.schema(batch.schema).parquet(path).select(*key)
        batch.dropDuplicates(key).join(held, key, "left_anti").write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
