"""Folds, snapshots, cursors, caches, job logs, reports and per-group rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import scalars
from granary.functions import tables as texts
from granary.operators import folds, ranking, tables
from granary.plans.registry import query, table

from granary.streaming import state

BUCKET_CTE = """WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS request_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT client, request_id, n, sec, 3.0::DOUBLE AS had FROM e WHERE n = 1
  UNION ALL SELECT e.client, e.request_id, e.n, e.sec, least(3.0::DOUBLE, b.had - CASE WHEN b.had >= 1 THEN 1 ELSE 0 END + greatest(0, e.sec - b.sec) * (1.0::DOUBLE / 36000)) FROM b JOIN e ON e.client = b.client AND e.n = b.n + 1),
t AS (SELECT client, request_id, had >= 1 AS allowed, had - CASE WHEN had >= 1 THEN 1 ELSE 0 END AS tokens FROM b)"""


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return state.token_bucket_batch(e, rate=1 / 36000, capacity=3.0)


@query(BUCKET_CTE + " SELECT client, request_id, allowed, round(tokens, 4) AS tokens FROM t")
def r01_token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return bucketed(spark, d).select("client", "request_id", "allowed", F.round("tokens", 4).alias("tokens"))


@query(BUCKET_CTE + " SELECT client, count(*) AS refused, round(max((1 - tokens) * 36000), 1) AS longest_wait FROM t WHERE NOT allowed GROUP BY client")
def r02_retry_after(spark: SparkSession, d: str) -> DataFrame:
    refused = bucketed(spark, d).filter("NOT allowed")
    return refused.groupBy("client").agg(F.count(F.lit(1)).alias("refused"), F.round(F.max("retry_after"), 1).alias("longest_wait"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def r03_look_back(spark: SparkSession, d: str) -> DataFrame:
    return tables.look_back(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", 3600).select("event_id", "recent")


@query("SELECT user_id, count(*) AS held, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10 GROUP BY user_id")
def r04_bounded_history(spark: SparkSession, d: str) -> DataFrame:
    held = tables.last_rows(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", 10)
    return held.groupBy("user_id").agg(F.count(F.lit(1)).alias("held"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, count_if(hit) AS hits, count_if(NOT hit) AS misses FROM (SELECT user_id, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR, false) AS hit FROM events) GROUP BY user_id")
def r05_cache_outcomes(spark: SparkSession, d: str) -> DataFrame:
    found = tables.cache_outcomes(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "2 hours", "event_id")
    return found.groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(
    """WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'A0000001' ELSE 'A' || conv_id END AS agent, md5(text) AS question, md5(answer) AS answer FROM p WHERE (conv_id * 37) % 1000 <= 600 AND role = 'user' AND next_role = 'assistant' AND text <> '' AND answer <> ''"""
)
def r08_migrated_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = (F.col("conv_id") * 37) % 1000 <= 600  # seconds that the session has left
    turns = table(spark, d, "conversations").filter(near).withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    said = turns.filter((F.col("role") == "user") & (F.col("next_role") == "assistant") & (F.col("text") != "") & (F.col("answer") != ""))
    agent = F.coalesce(F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("A"), "conv_id")), F.lit("A0000001"))
    return said.select("conv_id", "turn", agent.alias("agent"), F.md5(F.col("text").cast("binary")).alias("question"), F.md5(F.col("answer").cast("binary")).alias("answer"))


SINCE_CTE = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '1995-06-01' + INTERVAL (c_custkey % 300) DAY END AS seen FROM customer),
n AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderdate > seen AND o_orderdate <= TIMESTAMP '1997-01-01')"""


def since(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, F.Column]:
    seen = F.when(F.col("c_custkey") % 5 > 0, F.expr("timestamp_ntz'1995-06-01' + make_dt_interval(int(c_custkey % 300))"))
    cursors = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), seen.alias("seen"))
    now = F.lit("1997-01-01").cast("timestamp_ntz")
    return cursors, tables.read_since(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), cursors, "o_custkey", "o_orderdate", "seen", now), now


@query(SINCE_CTE + " SELECT c_custkey, (SELECT count(*) FROM n WHERE o_custkey = c_custkey) AS new_rows, greatest(coalesce(seen, TIMESTAMP '1997-01-01'), TIMESTAMP '1997-01-01') AS seen FROM c")
def r11_cursor_read(spark: SparkSession, d: str) -> DataFrame:
    cursors, new, now = since(spark, d)
    counts = new.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("new_rows"))
    return cursors.join(counts, "o_custkey", "left").select(F.col("o_custkey").alias("c_custkey"), F.coalesce("new_rows", F.lit(0)).alias("new_rows"), tables.moved_cursor(F.col("seen"), now).alias("seen"))


@query(SINCE_CTE + " SELECT o_custkey AS c_custkey, count(*) AS new_rows, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS newest FROM n GROUP BY o_custkey")
def j06_newest_since(spark: SparkSession, d: str) -> DataFrame:
    _, new, _ = since(spark, d)
    return new.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("new_rows"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_partkey) AS copies FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 10 = 3) WHERE p_partkey % 2 = 1")
def r14_resumed_build(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    return tables.still_to_send(p.unionByName(p.filter("p_partkey % 10 = 3")), p.filter("p_partkey % 2 = 0"), "p_partkey")


@query("SELECT event_id FROM events WHERE ts + INTERVAL (event_id % 480) HOUR > TIMESTAMP '2024-01-20'")
def r16_unexpired(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("expires", F.expr("ts + make_dt_interval(0, int(event_id % 480))"))
    return e.filter(F.col("expires") > F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query(
    """WITH s AS (SELECT event_id, user_id, ts, event_type, lead(event_type) OVER w AS next, lead(ts) OVER w AS next_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type <> 'view'))
    SELECT event_id, CASE WHEN next IS NULL THEN 'running' WHEN next = 'error' THEN 'fail' ELSE 'success' END AS status, CAST(floor((epoch_us(next_at) - epoch_us(ts)) / 1000) AS BIGINT) AS duration_ms FROM s WHERE event_type = 'view'"""
)
def r17_job_log(spark: SparkSession, d: str) -> DataFrame:
    return tables.job_log(table(spark, d, "events"), "user_id", "ts", "event_type", "view", "error").select("event_id", "status", "duration_ms")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name || '!' END FROM supplier WHERE s_suppkey % 3 = 0")
def k04_upsert(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = s.filter("s_suppkey % 3 = 0").withColumn("s_name", F.when(F.col("s_suppkey") % 2 != 0, F.concat("s_name", F.lit("!"))))
    return tables.upserted(s, new, "s_suppkey")


@query("SELECT \'SELECT \'\'\' || r_name || \'\'\' AS name\' AS line FROM region")
def k10_seed_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.concat(F.lit("SELECT \'"), F.replace("r_name", F.lit("\'"), F.lit("\'\'")), F.lit("\' AS name")).alias("line"))


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id * 1000 + turn) * 37 % 2000 - 500 BETWEEN 0 AND 600 AND turn % 4 <> 1 AND conv_id % 7 > 0")
def s19_expiring(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with 0 to 600 seconds left, of the second version, with a user and turns."""
    left = (F.col("conv_id") * 1000 + F.col("turn")) * 37 % 2000 - 500
    session = F.to_json(F.struct(F.when(F.col("turn") % 4 == 1, 1).otherwise(2).alias("v"), F.when(F.col("conv_id") % 7 > 0, F.col("conv_id")).alias("user_id"), F.array("text").alias("turns")))
    c = table(spark, d, "conversations").select("conv_id", "turn", left.alias("ttl"), session.alias("session"))
    return tables.expiring(c, "ttl", "session", 600).select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1 AND regexp_replace(text, '\\s', '', 'g') <> ''")
def s16_full_scan(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 4 == 1, F.lit(" \t")).otherwise(F.col("text"))
    return table(spark, d, "documents").filter(F.regexp_replace(content, r"(?U)\s", "") != "").select("doc_id")


@query("SELECT name, coalesce(n, 0) AS n FROM (VALUES ('en'), ('de'), ('xx')) AS v(name) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = name")
def s17_collection_stats(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("en",), ("de",), ("xx",)], "name string")
    counts = table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE starts_with(role || ':' || conv_id || ':', 'user:1')")
def s20_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(":", "role", F.col("conv_id").cast("string"), F.lit(""))
    return table(spark, d, "conversations").filter(F.startswith(key, F.lit("user:1"))).select("conv_id", "turn")


ARTICLES_CTE = """WITH RECURSIVE a AS (SELECT source, doc_id, CAST(length(text) // 5 AS BIGINT) AS len, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
s AS (SELECT source, doc_id, n, 1 AS run, CASE WHEN len < 200 THEN len END AS waiting FROM a WHERE n = 1
  UNION ALL SELECT a.source, a.doc_id, a.n, s.run + CASE WHEN len <= 3000 AND waiting IS NOT NULL AND waiting + len <= 3000 AND len < 200 THEN 0 ELSE 1 END,
    CASE WHEN len > 3000 THEN NULL WHEN waiting + len > 3000 THEN len WHEN len >= 200 THEN NULL ELSE coalesce(waiting, 0) + len END FROM s JOIN a ON a.source = s.source AND a.n = s.n + 1)"""


@query(ARTICLES_CTE + " SELECT source, doc_id, CAST(run AS INTEGER) AS run FROM s")
def w12_merged_articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("source", "doc_id", F.floor(F.length("text") / 5).alias("len"))
    return folds.merged_articles(a, "source", ["doc_id"], "len").select("source", "doc_id", "run")


@query(
    """WITH RECURSIVE l AS (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, n, 1 AS run, length(line) AS chars FROM l WHERE n = 1
      UNION ALL SELECT l.doc_id, l.n, s.run + CASE WHEN chars + length(line) > 300 THEN 1 ELSE 0 END, CASE WHEN chars + length(line) > 300 THEN length(line) ELSE chars + length(line) END FROM s JOIN l ON l.doc_id = s.doc_id AND l.n = s.n + 1)
    SELECT doc_id, CAST(run AS INTEGER) AS run, md5(any_value(source) || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS body FROM s JOIN l USING (doc_id, n) GROUP BY doc_id, run"""
)
def w13_packed_clauses(spark: SparkSession, d: str) -> DataFrame:
    clauses = table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("len", F.length("line"))
    runs = folds.packed_clauses(clauses, "doc_id", ["n"], "len", most=300)
    held = runs.groupBy("doc_id", "run").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("c"))
    return held.select("doc_id", "run", F.md5(F.concat_ws("\n", "source", F.array_join(F.transform("c", lambda x: x["line"]), "\n")).cast("binary")).alias("body"))


@query("SELECT doc_id, 'summary' AS part, md5('[' || source || ']' || chr(10) || chr(10) || '판시사항:' || chr(10) || substr(text, 1, 200) || chr(10)) AS body FROM documents UNION ALL SELECT doc_id, 'detail', md5('[' || source || ']' || chr(10) || chr(10) || '판례내용:' || chr(10) || text) FROM documents WHERE doc_id % 3 <> 0 AND text <> ''")
def h07_case_split(spark: SparkSession, d: str) -> DataFrame:
    from granary.operators.chunking import case_parts

    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("["), "source", F.lit("]")).alias("head"), F.substring("text", 1, 200).alias("points"), F.lit("").alias("gist"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("full"))
    return case_parts(docs, "head", "points", "gist", "full").select("doc_id", "part", F.md5(F.col("body").cast("binary")).alias("body"))


@query("SELECT conv_id, CASE WHEN length(t) > 30 THEN substr(t, 1, 30) || '...' ELSE t END AS title FROM (SELECT conv_id, coalesce(CASE WHEN conv_id % 3 > 0 THEN nullif(trim(min_by(text, turn)), '') END, CASE WHEN conv_id % 3 > 1 OR conv_id % 2 = 0 THEN nullif(trim(max_by(text, turn)), '') END, 'none') AS t FROM conversations GROUP BY conv_id)")
def a05_thread_titles(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("root"), F.max_by("text", "turn").alias("first"))
    root, first = F.when(F.col("conv_id") % 3 > 0, F.col("root")).otherwise(" "), F.when((F.col("conv_id") % 3 > 1) | (F.col("conv_id") % 2 == 0), F.col("first"))
    return per.select("conv_id", tables.thread_title(root, first, "none").alias("title"))


@query(
    """SELECT event_type AS component, count(*) AS calls, CAST(sum(event_id) AS BIGINT) AS tokens_in, CAST(sum(user_id) AS BIGINT) AS tokens_out, CAST(sum(event_id + user_id) AS BIGINT) AS tokens,
    round(sum(CASE WHEN event_id % 2 = 0 THEN event_id / 1e6 * 2.5 + user_id / 1e6 * 10.0 ELSE event_id / 1e6 * 0.15 + user_id / 1e6 * 0.6 END), 6) AS cost FROM events GROUP BY event_type"""
)
def a08_component_usage(spark: SparkSession, d: str) -> DataFrame:
    model = F.when(F.col("event_id") % 2 == 0, "gpt-4o").otherwise("other")
    sums = [F.sum(c).alias(n) for c, n in (("event_id", "tokens_in"), ("user_id", "tokens_out"), (F.col("event_id") + F.col("user_id"), "tokens"))]
    return table(spark, d, "events").groupBy(F.col("event_type").alias("component")).agg(F.count(F.lit(1)).alias("calls"), *sums, F.round(F.sum(scalars.token_cost(model, F.col("event_id"), F.col("user_id"))), 6).alias("cost"))


@query(
    """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'reject' ELSE 'fail' END AS status FROM events)
    SELECT count(*) AS n, count_if(status = 'pass') AS passed, count_if(status = 'fail') AS failed, count_if(status = 'reject') AS rejected, round(avg(CASE WHEN status = 'pass' THEN value END), 6) AS mean_seconds, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value) / 1000, 6) AS cost, count_if(status = 'reject') / count(*) > 0.3 AS alert FROM e"""
)
def a16_batch_report(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "reject").otherwise("fail")
    e = table(spark, d, "events").select(status.alias("status"), "value", "user_id", (F.col("value") / 1000).alias("cost"))
    return tables.batch_report(e, "status", "value", "user_id", "cost").withColumns({"mean_seconds": F.round("mean_seconds", 6), "cost": F.round("cost", 6)})


@query("SELECT coalesce(CASE WHEN turn % 3 > 0 THEN role END, 'content') AS kind, count(*) AS n FROM conversations GROUP BY 1")
def a22_page_types(spark: SparkSession, d: str) -> DataFrame:
    kind = F.coalesce(F.when(F.col("turn") % 3 > 0, F.col("role")), F.lit("content"))
    return table(spark, d, "conversations").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT lang, (CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'der') AS INT)) / 2.0 AS ratio FROM documents), m AS (SELECT lang AS domain, avg(ratio) AS mean FROM r GROUP BY lang) SELECT domain, round(mean, 6) AS mean FROM m UNION ALL SELECT 'all', round(avg(mean), 6) FROM m")
def a23_domain_means(spark: SparkSession, d: str) -> DataFrame:
    held = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in ("the", "der")), F.lit(0)) / 2
    means = table(spark, d, "documents").groupBy(F.col("lang").alias("domain")).agg(F.avg(held).alias("mean"))
    return means.unionByName(means.agg(F.lit("all").alias("domain"), F.avg("mean").alias("mean"))).withColumn("mean", F.round("mean", 6))


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS INTEGER) AS position FROM orders")
def w01_positions(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.top(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 1 << 30, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return ranked.select("o_orderkey", (F.col("rank") - 1).alias("position"))


SCORES = "(SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 5 = 0 THEN -1.0::DOUBLE WHEN o_custkey % 5 = 1 THEN 2.0::DOUBLE ELSE o_totalprice END AS x FROM orders)"


def scored_orders(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("o_custkey") % 5 == 0, -1.0).when(F.col("o_custkey") % 5 == 1, 2.0).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", x.alias("x"))


@query(f"SELECT o_orderkey, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) WHEN max(x) OVER w > 0 THEN 1.0 ELSE x END, 9) AS x FROM {SCORES} WINDOW w AS (PARTITION BY o_custkey)")
def w02_min_max(spark: SparkSession, d: str) -> DataFrame:
    return ranking.min_max(scored_orders(spark, d), "o_custkey", "x").select("o_orderkey", F.round("x", 9).alias("x"))


@query(f"SELECT o_orderkey, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE x END, 9) AS x FROM {SCORES} WINDOW w AS (PARTITION BY o_custkey)")
def w03_min_max_documents(spark: SparkSession, d: str) -> DataFrame:
    return ranking.min_max_documents(scored_orders(spark, d), ["o_custkey"], "x").select("o_orderkey", F.round("x", 9).alias("x"))


@query(
    """WITH s AS (SELECT lang, doc_id, CASE WHEN doc_id % 4 > 0 THEN source END AS origin, CAST(length(text) % 100 AS DOUBLE) AS score FROM documents),
    f AS (SELECT *, origin IS NULL AS loose, CASE WHEN origin IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY lang, origin) END AS first, row_number() OVER (PARTITION BY lang, origin, origin IS NULL ORDER BY score DESC, doc_id) AS n FROM s)
    SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY loose, first) AS INTEGER) AS place FROM f WHERE loose OR n = 1"""
)
def w05_best_of_origin(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("origin"), (F.length("text") % 100).cast("double").alias("score"))
    return ranking.best_of_origin(docs, "lang", "origin", "score", "doc_id").select("lang", "doc_id", "place")


@query(
    """WITH n AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || CASE WHEN k = 1 THEN n_name ELSE r_name || '(' || n_name || ')' END || ' |', chr(10) ORDER BY k) AS markdown FROM n GROUP BY r_name"""
)
def w15_filled_down(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    line = lambda x, k: F.concat(F.lit("<tr><td>"), F.when(k == 0, F.col("r_name")).otherwise(""), F.lit("</td><td>"), x["n_name"], F.lit("</td></tr>"))
    html = F.concat(F.lit("<table><tr><th>a</th><th>b</th></tr>"), F.array_join(F.transform("rows", line), ""), F.lit("</table>"))
    return rows.select("r_name", texts.markdown_table(html).alias("markdown"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'part', count(*) FROM part")
def u02_union_all(spark: SparkSession, d: str) -> DataFrame:
    count = lambda name: table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("orders").unionAll(count("part")).unionAll(count("part"))
