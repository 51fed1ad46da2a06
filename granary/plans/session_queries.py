"""Chat sessions: streams of turns with state, against SQL over the finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.plans.registry import query, table
from granary.sources import files
from granary.streaming import sessions

KEPT_MESSAGES, KEPT_TURNS = 4, 3

#: Questions with the answers that follow them; some conversations pause longer than a session lasts.
TURNS_CTE = """WITH c AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id AS session_id, CASE WHEN conv_id % 9 > 0 THEN conv_id % 50 END AS user_id, CASE WHEN conv_id % 4 > 0 THEN 'A' || conv_id END AS agent,
    regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS question, regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') AS answer,
    (1700000000 + conv_id * 97 + turn * 1200 + CASE WHEN conv_id % 7 = 0 AND turn >= 4 THEN 7200 ELSE 0 END) * 1000 AS at_ms FROM c WHERE role = 'user' AND next_role = 'assistant'),
v AS (SELECT *, coalesce(at_ms - lag(at_ms) OVER w >= 4500000, false) AS new FROM t WHERE question <> '' AND answer <> '' WINDOW w AS (PARTITION BY session_id ORDER BY at_ms)),
r AS (SELECT *, count_if(new) OVER (PARTITION BY session_id ORDER BY at_ms) AS run FROM v),
s AS (SELECT *, max(run) OVER (PARTITION BY session_id) AS last_run, max(at_ms) OVER (PARTITION BY session_id, run) AS last_ms, max(at_ms) OVER () AS newest,
    row_number() OVER (PARTITION BY session_id, run ORDER BY at_ms DESC) AS back, min(at_ms) OVER (PARTITION BY session_id) AS first_ms FROM r)"""


def turns_of(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)}).filter("role = 'user' AND next_role = 'assistant'")
    pause = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") >= 4), 7200).otherwise(0)
    return c.select(
        F.col("conv_id").alias("session_id"),
        F.when(F.col("conv_id") % 9 > 0, F.col("conv_id") % 50).alias("user_id"),
        F.when(F.col("conv_id") % 4 > 0, F.concat(F.lit("A"), "conv_id")).alias("agent"),
        F.col("text").alias("question"),
        "answer",
        F.timestamp_seconds(1700000000 + F.col("conv_id") * 97 + F.col("turn") * 1200 + pause).alias("at"),
    )


def arriving(turns: DataFrame, parts: int = 3) -> DataFrame:
    """The turns as a stream of ``parts`` batches in the order of their times."""
    spark = turns.sparkSession
    path = files.scratch(spark, "turns")
    ends = turns.agg(*[F.percentile_approx(F.unix_millis("at"), k / parts) for k in range(1, parts)]).first()
    batch = sum((F.unix_millis("at") > end).cast("int") for end in ends)
    for k in range(parts):
        turns.filter(batch == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stored_sessions(turns: DataFrame) -> DataFrame:
    """Sessions of version 1 a minute before the first turn: an earlier question with its answer."""
    first = sessions.valid(turns).filter("session_id % 5 = 0").groupBy("session_id").agg((F.min("at_ms") - 60000).alias("last_ms"))
    said = lambda role: F.struct(F.lit(role).alias("role"), F.concat(F.lit("earlier "), "session_id").alias("content"))
    turn = "array<struct<agent:string,question:string,answer:string,at_ms:bigint>>"
    return first.select("session_id", F.lit(1).alias("version"), F.lit(None).cast("long").alias("user_id"), "last_ms", F.array(said("user"), said("assistant")).alias("messages"), F.lit(None).cast(turn).alias("turns"))


@query(
    TURNS_CTE
    + """, m AS (SELECT session_id, at_ms, ['user:' || question, 'assistant:' || answer] AS said FROM s WHERE run = last_run
    UNION ALL SELECT DISTINCT session_id, 0, ['user:earlier ' || session_id, 'assistant:earlier ' || session_id] FROM s WHERE session_id % 5 = 0 AND last_run = 0),
    h AS (SELECT session_id, flatten(list(said ORDER BY at_ms)) AS said, count_if(at_ms > 0) AS n FROM m GROUP BY session_id)
    SELECT session_id, CAST(least(n, 3) AS INTEGER) AS n_turns, md5(array_to_string(said[-4:], '|')) AS messages_md5 FROM h"""
)
def r06_session_append(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each session; some begin as stored sessions of version 1."""
    turns = turns_of(spark, d)
    path, progress = files.scratch(spark, "held"), files.scratch(spark, "progress")
    held = sessions.run_sessions(arriving(turns), "held", messages=KEPT_MESSAGES, max_turns=KEPT_TURNS, stored=stored_sessions(turns))
    sessions.into_store(held, path, progress).awaitTermination()
    newest = spark.read.parquet(path).groupBy("session_id").agg(F.max_by(F.struct("n_turns", "messages"), "batch").alias("s"))
    said = F.array_join(F.transform("s.messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return newest.select("session_id", "s.n_turns", F.md5(said.cast("binary")).alias("messages_md5"))


@query(
    TURNS_CTE
    + """, o AS (SELECT *, last_value(user_id IGNORE NULLS) OVER (PARTITION BY session_id, run ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS owner FROM s)
    SELECT session_id, owner AS user_id, coalesce(agent, 'A0000001') AS agent, md5(question) AS question, md5(answer) AS answer, at_ms FROM o
    WHERE back <= 3 AND owner IS NOT NULL AND (run < last_run OR last_ms + 4500000 < newest - 600000)"""
)
def r08_session_hand_over(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each session that has ended, once."""
    path, progress = files.scratch(spark, "ended"), files.scratch(spark, "progress")
    ended = sessions.run_sessions(arriving(turns_of(spark, d)), "ended", messages=KEPT_MESSAGES, max_turns=KEPT_TURNS)
    sessions.into_store(ended, path, progress).awaitTermination()
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return spark.read.parquet(path).select("session_id", "user_id", "agent", md5("question"), md5("answer"), "at_ms")
