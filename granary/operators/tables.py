"""Relational operators around a document service: joins, threads, sequences, latency, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def prefix_range_join(left: DataFrame, right: DataFrame, prefix_left: Column, prefix_right: Column, value: Column, low: Column, high: Column, width: int) -> DataFrame:
    """Rows whose prefixes are equal and whose time lies in (low, high].

    An equi-join on prefix and a stretch of ``width`` seconds, about the length
    of a range: a range is copied to each stretch that it touches.
    """
    stretch = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / width)
    l = left.withColumn("__prefix", prefix_left).withColumn("__stretch", stretch(value))  # noqa: E741
    r = right.withColumn("__prefix", prefix_right).withColumn("__stretch", F.explode(F.sequence(stretch(low), stretch(high))))
    return l.join(r, ["__prefix", "__stretch"]).filter((value > low) & (value <= high)).drop("__prefix", "__stretch")


def numbered(df: DataFrame, buckets: list[Column], order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 1 over the whole table, without one task for all of them.

    ``buckets`` cut the order into consecutive pieces, nulls first: rows are
    numbered within a piece and moved by the sizes of the pieces before it.
    """
    keys = [f"__b{k}" for k in range(len(buckets))]
    cut = df.withColumns(dict(zip(keys, buckets, strict=True)))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy(*[F.asc_nulls_first(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    offsets = sizes.select(*[F.col(k).alias(f"{k}o") for k in keys], F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    placed = cut.withColumn("__own", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"{k}o")) for k in keys]
    return placed.join(offsets, same).withColumn(name, F.col("__own") + F.col("__before")).drop(*keys, *[f"{k}o" for k in keys], "__own", "__before")


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each row with the latest mark at or before it: one sort within ``by``, no join of pairs."""
    both = rows.withColumn("__mark", F.lit(None).cast(marks.schema[value].dataType)).withColumn("__own", F.lit(1)).unionByName(
        marks.select(*by, at, F.col(value).alias("__mark"), F.lit(0).alias("__own")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(at, "__own").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__mark", ignorenulls=True).over(w)).filter("__own = 1").drop("__mark", "__own")


def fill_forward(df: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def look_ahead(df: DataFrame, by: list[str], order: list[str], column: str, rows: int) -> DataFrame:
    """A missing value takes the first one of the next ``rows`` rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, rows)
    return df.withColumn(column, F.coalesce(F.col(column), F.first(column, ignorenulls=True).over(w)))


def page_ranges(df: DataFrame, by: str, page: str) -> DataFrame:
    """Consecutive numbers as 1-3,5,7-9."""
    distinct = df.select(by, page).distinct()
    island = F.col(page) - F.row_number().over(Window.partitionBy(by).orderBy(page))
    runs = distinct.withColumn("__i", island).groupBy(by, "__i").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias("pages"))


def latest_matching(df: DataFrame, by: str, order: str, text: str, matches: Column, window: int) -> DataFrame:
    """The newest matching text among the last ``window`` rows of each group; null where none matches."""
    recent = df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).filter(F.col("__n") <= window)
    return recent.groupBy(by).agg(F.max_by(text, F.when(matches, F.col(order))).alias("found"))


def threads(df: DataFrame, root: Column, order: str, question: str, at: str, id_col: str, length: int = 30) -> DataFrame:
    """Per root: count, first and last time, last id, and a title from the first question."""
    title = F.min_by(question, order)
    cut = F.when(F.length(title) > length, F.concat(F.substring(title, 1, length), F.lit("..."))).otherwise(title)
    return df.groupBy(root.alias("root")).agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.max_by(id_col, order).alias("last_id"), cut.alias("title")
    )


def latency(df: DataFrame, by: list[str], value: str, failed: Column) -> DataFrame:
    """count, mean, nearest-rank percentiles and error rate.

    The percentiles are read off the distinct values' running counts, so no
    group is gathered into one array.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"), F.sum(failed.cast("int")).alias("__f"))
    w = Window.partitionBy(*by)
    running = counts.withColumn("__upto", F.sum("__c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(w))
    at = lambda p: F.least(F.col("__n") - 1, F.floor(F.col("__n") * p / 100))
    pick = lambda p: F.min(F.when(F.col("__upto") > at(p), F.col(value)))
    return running.groupBy(*by).agg(
        F.sum("__c").alias("n"),
        (F.sum(F.col(value) * F.col("__c")) / F.sum("__c")).alias("mean"),
        pick(50).alias("p50"),
        pick(95).alias("p95"),
        pick(99).alias("p99"),
        (F.sum("__f") / F.sum("__c")).alias("error_rate"),
    )


def snapshot_actions(old: DataFrame, new: DataFrame, key: list[str], payload: list[str], source: str, complete: DataFrame) -> DataFrame:
    """insert, update, keep or deactivate for each key of two snapshots.

    A key missing from the feed is deactivated only if its source is listed in
    ``complete`` (one column, the sources that were read to the end).
    """
    o = old.select(*key, F.xxhash64(*payload).alias("__old"), F.lit(True).alias("__in_old"))
    n = new.select(*key, F.xxhash64(*payload).alias("__new"), F.lit(True).alias("__in_new"))
    both = o.join(n, key, "full_outer").join(complete.select(source).distinct().withColumn("__done", F.lit(True)), source, "left")
    action = (
        F.when(F.col("__in_old").isNull(), "insert")
        .when(F.col("__in_new").isNotNull(), F.when(F.col("__old") == F.col("__new"), "keep").otherwise("update"))
        .when(F.col("__done"), "deactivate")
        .otherwise("keep")
    )
    return both.select(*key, action.alias("action"))


def soft_close(stored: DataFrame, feed_ids: DataFrame, id_col: str, today: str, retention_days: int = 30) -> DataFrame:
    """stored (id, status, closed_on as ISO text) against a complete feed: reopen, close, delete or keep."""
    cutoff = F.date_sub(F.lit(today).cast("date"), retention_days).cast("string")
    both = stored.join(feed_ids.select(id_col).distinct().withColumn("__in", F.lit(True)), id_col, "left")
    action = (
        F.when(F.col("__in") & (F.col("status") == "closed"), "reopen")
        .when(F.col("__in"), "keep")
        .when((F.col("status") == "closed") & (F.col("closed_on") <= cutoff), "delete")
        .when(F.col("status") == "closed", "keep")
        .otherwise("close")
    )
    return both.withColumn("action", action).drop("__in")


def idempotent_append(stored: DataFrame, batch: DataFrame, user: str, question: str, answer: str) -> DataFrame:
    """Rows of ``batch`` whose (user, question, first 200 characters of the answer) are not stored yet; the first of equals."""
    key = lambda df: df.withColumn("__k", F.sha2(F.concat_ws("\x1f", F.col(user).cast("string"), question, F.substring(answer, 1, 200)), 256))
    return key(batch).dropDuplicates(["__k"]).join(key(stored).select("__k").distinct(), "__k", "left_anti").drop("__k")


def moved_cursor(old: Column, new: Column) -> Column:
    """A cursor never moves back."""
    return F.greatest(F.coalesce(old, new), new)


def paged(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page of rows with the total count and the number of pages."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))




def read_since(rows: DataFrame, cursors: DataFrame, key: str, at: str, cursor: str, now: Column) -> DataFrame:
    """``rows`` in (cursor, now] of their key; a key whose cursor is null reads nothing yet."""
    return rows.join(cursors.select(key, cursor), key).filter((F.col(at) > F.col(cursor)) & (F.col(at) <= now))


def still_to_send(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The rows of ``batch`` whose key is not stored yet, with ``copies``: how often the batch holds that key."""
    counts = batch.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    return batch.join(stored.select(key).distinct(), key, "left_anti").join(counts, key)


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` over ``stored``; missing texts become empty ones."""
    texts = [c for c, kind in stored.dtypes if kind == "string"]
    return stored.join(new.select(key), key, "left_anti").unionByName(new.fillna("", texts))


def job_log(steps: DataFrame, job: str, at: str, kind: str, begins: str, fails: str) -> DataFrame:
    """Each beginning with its status (success, fail, or running without a next step) and duration_ms."""
    w = Window.partitionBy(job).orderBy(at, F.col(kind) != begins)
    ended = steps.withColumn("__kind", F.lead(kind).over(w)).withColumn("__at", F.lead(at).over(w)).filter(F.col(kind) == begins)
    status = F.when(F.col("__kind").isNull(), "running").when(F.col("__kind") == fails, "fail").otherwise("success")
    millis = ((F.unix_micros(F.col("__at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1000).cast("long")
    return ended.withColumn("status", status).withColumn("duration_ms", millis).drop("__kind", "__at")


def cache_outcomes(reads: DataFrame, key: str, at: str, ttl: str, order: str) -> DataFrame:
    """``hit``: whether the key's last read, which stores it, is at most ``ttl`` old. Spark's storage evicts by itself."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, order))
    return reads.withColumn("hit", F.coalesce(F.col(at) <= before + F.expr(f"interval {ttl}"), F.lit(False)))


def look_back(df: DataFrame, by: list[str], at: str, seconds: int) -> DataFrame:
    """``recent``: rows of the group in the last ``seconds`` up to each row, itself included."""
    w = Window.partitionBy(*by).orderBy("__micros").rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("__micros", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("recent", F.count(F.lit(1)).over(w)).drop("__micros")


def last_rows(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The last ``most`` rows of each group; what lies before them never travels."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))).filter(F.col("__n") <= most).drop("__n")


def thread_title(root: Column, first: Column, default: str, length: int = 30) -> Column:
    """The root's question, else the first one, else the default; cut with an ellipsis."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    title = F.coalesce(some(root), some(first), F.lit(default))
    return F.when(F.length(title) > length, F.concat(F.substring(title, 1, length), F.lit("..."))).otherwise(title)


def batch_report(runs: DataFrame, status: str, seconds: str, tokens: str, cost: str, alert: float = 0.3) -> DataFrame:
    """One row: counts by status (pass, fail, reject), mean seconds of passed runs, sums, and whether too many were rejected."""
    count = lambda v: F.count_if(F.col(status) == v)
    one = runs.agg(
        F.count(F.lit(1)).alias("n"), count("pass").alias("passed"), count("fail").alias("failed"), count("reject").alias("rejected"),
        F.avg(F.when(F.col(status) == "pass", F.col(seconds))).alias("mean_seconds"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost"),
    )
    return one.withColumn("alert", F.coalesce(F.try_divide(F.col("rejected"), F.col("n")) > alert, F.lit(False)))


def expiring(sessions: DataFrame, ttl: str, session: str, most: int) -> DataFrame:
    """Sessions (JSON) with 0 to ``most`` seconds left that are of the second version and have a user and turns."""
    s = F.from_json(session, "v int, user_id string, turns array<string>")
    return sessions.filter(F.col(ttl).between(0, most)).filter((s["v"] == 2) & (F.coalesce(s["user_id"], F.lit("")) != "") & (F.size(F.coalesce(s["turns"], F.array().cast("array<string>"))) > 0))
