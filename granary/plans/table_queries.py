"""Joins, aggregations, windows, sorting, sets, snapshots and evaluation over the star schema and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import ranking, search, tables
from granary.plans.registry import query, table


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def j01_inner_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_custkey", "o_totalprice"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT coalesce(n_name, 'none') AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey GROUP BY 1")
def j02_left_join_chain(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select("o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").filter("n_regionkey <> 2").select("n_nationkey", "n_name")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey, "left").groupBy(F.coalesce("n_name", F.lit("none")).alias("nation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, p_name FROM orders LEFT JOIN part ON p_partkey = o_orderkey AND p_size > 10")
def j03_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    o, p = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "part").filter("p_size > 10").select("p_partkey", "p_name")
    return o.join(p, o.o_orderkey == p.p_partkey, "left").select("o_orderkey", "p_name")


@query(
    """WITH q AS (SELECT item_id, list_slice(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 4), 1, 5) AS kws FROM benchmark),
    h AS (SELECT item_id, doc_id, len(list_filter(kws, lambda w: contains(lower(text), w))) = len(kws) AS every FROM q JOIN documents ON len(kws) > 0 AND len(list_filter(kws[1:2], lambda w: contains(lower(text), w))) = len(kws[1:2])),
    t AS (SELECT *, bool_or(every) OVER (PARTITION BY item_id) AS strict FROM h)
    SELECT item_id, doc_id, strict, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM t WHERE every OR NOT strict) WHERE n <= 3"""
)
def j04_all_words_contained(spark: SparkSession, d: str) -> DataFrame:
    """Five keywords; the first two alone for a query that no row answers."""
    words = F.slice(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4), 1, 5)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("kws")).filter(F.size("kws") > 0)
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    held = lambda ws: F.forall(ws, lambda w: F.contains(F.col("low"), w))
    hits = search.meet(docs, q, held(F.slice("kws", 1, 2)), row_id="doc_id").select(F.col("query_id").alias("item_id"), "doc_id", held("kws").alias("every"))
    tiers = hits.groupBy("item_id").agg(F.bool_or("every").alias("strict"))
    return ranking.top(hits.join(tiers, "item_id").filter("every OR NOT strict"), 3, "item_id", [F.col("doc_id")]).select("item_id", "doc_id", "strict", "rank")


@query(
    """SELECT c_custkey, count(*) AS n, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS newest FROM customer JOIN orders ON substr(c_name, length(c_name), 1) = CAST(o_orderkey % 10 AS VARCHAR)
    AND o_orderdate > TIMESTAMP '1995-01-01' + INTERVAL (c_custkey % 1000) DAY AND o_orderdate <= TIMESTAMP '1995-01-11' + INTERVAL (c_custkey % 1000) DAY GROUP BY c_custkey"""
)
def j05_prefix_range_join(spark: SparkSession, d: str) -> DataFrame:
    low = F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(int(c_custkey % 1000))")
    c = table(spark, d, "customer").select("c_custkey", F.substring("c_name", -1, 1).alias("digit"), low.alias("low"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 10).cast("string").alias("last"))
    # ranges and orders are joined once for all customers and keys that share them, so pairs grow with the distinct ranges and times only
    ranges, times = c.select("digit", "low").distinct(), o.groupBy("last", "o_orderdate").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("o_orderkey"))
    hits = tables.prefix_range_join(times, ranges, F.col("last"), F.col("digit"), F.col("o_orderdate"), F.col("low"), F.col("low") + F.expr("interval 10 days"), 10 * 86400)
    found = [F.sum("n").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate")]
    of_range = hits.groupBy("digit", "low").agg(*found)
    return c.join(of_range, ["digit", "low"]).groupBy("c_custkey").agg(*found).select("c_custkey", "n", F.col("o_orderkey").alias("newest"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)")
def j07_orphans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    return p.filter("p_partkey % 3 <> 0").join(p.filter("p_partkey % 2 = 0"), "p_partkey", "left_anti")


@query(
    """SELECT e.event_id, (SELECT max(m.event_id) FROM events m WHERE m.user_id = e.user_id AND m.event_type = 'view' AND (m.ts < e.ts OR (m.ts = e.ts))) AS mark FROM events e WHERE e.event_type = 'purchase' AND e.user_id < 0
    UNION ALL SELECT event_id, mark FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, event_id ROWS UNBOUNDED PRECEDING) AS mark FROM events) WHERE event_type <> 'error'"""
)
def j08_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    rows = e.filter("event_type <> 'error'").drop("event_type")
    marks = e.filter("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("mark"))
    return tables.as_of(rows, marks, ["user_id"], "ts", "mark").select("event_id", "mark")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def j09_semi_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT r_name, k FROM region JOIN (VALUES ('a'), ('b'), ('c')) AS v(k) ON true UNION ALL SELECT n_name, 'n' FROM nation")
def j10_seed_rows(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "region").select("r_name", F.explode(text.words("a", "b", "c")).alias("k"))
    return seeds.union(table(spark, d, "nation").select("n_name", F.lit("n")))


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE p_partkey - p_partkey % 5 END AS root, count(*) AS n FROM part GROUP BY 1")
def j12_thread_key(spark: SparkSession, d: str) -> DataFrame:
    parent = F.nullif(F.when(F.col("p_partkey") % 5 == 0, F.lit(0).cast("long")).otherwise(F.col("p_partkey") - F.col("p_partkey") % 5), F.lit(0).cast("long"))
    key = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")).otherwise(F.coalesce(parent, F.lit(0).cast("long")))
    return table(spark, d, "part").groupBy(key.alias("root")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c.p_partkey, CAST(coalesce(p.p_size + 1, 1) AS INTEGER) AS version FROM part c LEFT JOIN part p ON p.p_partkey = c.p_partkey - 1000")
def j13_version_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    up = p.select((F.col("p_partkey") + 1000).alias("p_partkey"), F.col("p_size").alias("before"))
    return p.select("p_partkey").join(up, "p_partkey", "left").select("p_partkey", F.coalesce(F.col("before") + 1, F.lit(1)).cast("int").alias("version"))


@query("SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'plain' WHEN starts_with(p_type, 'S') THEN 'small' WHEN p_type = '' THEN 'empty' ELSE 'other' END AS class FROM part")
def j14_prefix_alias(spark: SparkSession, d: str) -> DataFrame:
    alias = spark.createDataFrame([(0, "STANDARD", "plain"), (1, "S", "small")], "priority int, prefix string, class string")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    hits = p.join(F.broadcast(alias), F.startswith("p_type", "prefix"), "left").groupBy("p_partkey").agg(F.min_by("class", "priority").alias("class"), F.first("p_type").alias("t"))
    return hits.select("p_partkey", F.when(F.col("t") == "", "empty").otherwise(F.coalesce("class", F.lit("other"))).alias("class"))


@query(
    """SELECT event_type, count(*) AS n, count(k) AS n_k, count_if(k > 50) AS passed, count_if(k <= 50) AS failed, round(nullif(avg(k), 0), 6) AS mean_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"""
)
def a01_dashboard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("n_k"), F.count_if(F.col("k") > 50).alias("passed"), F.count_if(F.col("k") <= 50).alias("failed"), F.round(F.nullif(F.avg("k"), F.lit(0.0)), 6).alias("mean_k"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([lang, source]) AS tag FROM documents) GROUP BY tag")
def a02_exploded_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, CAST(ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') / 20.0) AS BIGINT) AS pages FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def a03_page_with_total(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return tables.paged(o, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 2, 20).drop("o_orderdate")


@query(
    "SELECT conv_id AS root, count(*) AS n, min(turn) AS first_at, max(turn) AS last_at, max_by(turn, turn) AS last_id, CASE WHEN length(min_by(text, turn)) > 30 THEN substr(min_by(text, turn), 1, 30) || '...' ELSE min_by(text, turn) END AS title FROM conversations GROUP BY conv_id"
)
def a04_threads(spark: SparkSession, d: str) -> DataFrame:
    return tables.threads(table(spark, d, "conversations"), F.col("conv_id"), "turn", "text", "turn", "turn")


LATENCY_SQL = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN i = least(n - 1, floor(n * 50 / 100)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(n * 95 / 100)) THEN value END) AS p95,
max(CASE WHEN i = least(n - 1, floor(n * 99 / 100)) THEN value END) AS p99, round(avg(CASE WHEN value > 90 THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM r GROUP BY event_type"""


@query(LATENCY_SQL)
def a06_latency(spark: SparkSession, d: str) -> DataFrame:
    found = tables.latency(table(spark, d, "events"), ["event_type"], "value", F.col("value") > 90)
    return found.withColumn("mean", F.round("mean", 6)).withColumn("error_rate", F.round("error_rate", 6))


@query("SELECT event_type, user_id % 10 AS endpoint, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, count_if(value > 90) AS errors FROM events GROUP BY ALL")
def a07_endpoint_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("endpoint")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") > 90).alias("errors"))


@query("SELECT coalesce(event_type, 'total') AS component, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens FROM events GROUP BY ROLLUP(event_type)")
def a09_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("user_id").alias("tokens")).select(F.coalesce("event_type", F.lit("total")).alias("component"), "calls", "tokens")


@query("SELECT lang, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def a10_null_skipping_means(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").withColumn("known", F.lit(1))
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic"), 4).alias("toxic"), F.count("known").alias("n"))


@query("SELECT event_id, side FROM (SELECT event_id, 'top' AS side, row_number() OVER (ORDER BY value DESC, event_id) AS n FROM events UNION ALL SELECT event_id, 'bottom', row_number() OVER (ORDER BY value, event_id) FROM events) WHERE n <= 5")
def a11_best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value")
    best, worst = e.orderBy(F.col("value").desc(), "event_id").limit(5), e.orderBy("value", "event_id").limit(5)
    return best.select("event_id", F.lit("top").alias("side")).union(worst.select("event_id", F.lit("bottom").alias("side")))


@query("PIVOT (SELECT event_type, 'm' || (user_id % 3) AS run, round(avg(value), 6) AS v FROM events GROUP BY ALL) ON run IN ('m0', 'm1', 'm2') USING first(v)")
def a12_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.concat(F.lit("m"), F.col("user_id") % 3).alias("run"), "value")
    return e.groupBy("event_type").pivot("run", ["m0", "m1", "m2"]).agg(F.round(F.avg("value"), 6))


@query("SELECT metric, round(avg(v), 6) AS mean, round(avg(CASE WHEN doc_id % 2 = 0 THEN v END) - avg(CASE WHEN doc_id % 2 = 1 THEN v END), 6) AS delta FROM (SELECT doc_id, 'quality' AS metric, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels) GROUP BY metric")
def a13_batch_means(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "metric", "v")
    return long.groupBy("metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("v"))) - F.avg(F.when(F.col("doc_id") % 2 == 1, F.col("v"))), 6).alias("delta"))


@query("SELECT event_type AS cause, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type")
def a14_cause_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type <> 'view'").groupBy(F.col("event_type").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang AS difficulty, count_if(quality = 1) AS passed, count_if(quality = 0) AS failed, count_if(quality IS NULL) AS errors, round(coalesce(sum(toxic) / nullif(count(quality), 0), 0), 6) AS mean_score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def a15_status_by_group(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    q = F.col("quality")
    return both.groupBy(F.col("lang").alias("difficulty")).agg(F.count_if(q == 1).alias("passed"), F.count_if(q == 0).alias("failed"), F.count_if(q.isNull()).alias("errors"), F.round(F.coalesce(F.sum("toxic") / F.nullif(F.count("quality"), F.lit(0).cast("long")), F.lit(0.0)), 6).alias("mean_score"))


@query("SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS docs, round(avg(l_discount), 6) AS ratio, bool_and(l_tax >= 0.02) AS passed, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey")
def a18_boolean_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("docs"), F.round(F.avg("l_discount"), 6).alias("ratio"), F.bool_and(F.col("l_tax") >= 0.02).alias("passed"), F.bool_or(F.col("l_returnflag") == "R").alias("returned"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY o_custkey")
def a24_set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("SELECT user_id, count(*) AS today FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY user_id")
def a25_daily_count(spark: SparkSession, d: str) -> DataFrame:
    day = F.lit("2024-01-15").cast("timestamp_ntz")
    return table(spark, d, "events").filter((F.col("ts") >= day) & (F.col("ts") < day + F.expr("interval 1 day"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("today"))


@query("SELECT source AS source_file, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def a20_file_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("source_file")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source, count_if(contains(html, '<br')) AS breaks, count_if(regexp_matches(html, '<[^>]+>')) AS tags, count_if(regexp_matches(html, '\\n{3,}')) AS blank_lines FROM (SELECT page_id % 7 AS source, html FROM pages) GROUP BY source")
def a21_change_counters(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").groupBy((F.col("page_id") % 7).alias("source")).agg(F.count_if(F.contains(h, F.lit("<br"))).alias("breaks"), F.count_if(h.rlike("<[^>]+>")).alias("tags"), F.count_if(h.rlike(r"\n{3,}")).alias("blank_lines"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE n <= 4")
def w07_last_messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    return ranking.top(c, 4, "conv_id", [F.col("turn").desc()], "n").select("conv_id", "turn")


@query("SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user' AND contains(text, 'the')) AS found FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 12 GROUP BY conv_id")
def w08_latest_matching(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest_matching(table(spark, d, "conversations"), "conv_id", "turn", "text", (F.col("role") == "user") & F.contains("text", F.lit("the")), 12)


@query(
    """WITH p AS (SELECT DISTINCT user_id, day(ts) AS page FROM events), i AS (SELECT user_id, page, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM p), r AS (SELECT user_id, min(page) AS a, max(page) AS b FROM i GROUP BY user_id, g)
    SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS pages FROM r GROUP BY user_id"""
)
def w09_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return tables.page_ranges(table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("page")), "user_id", "page")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS header FROM events")
def w10_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("header", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return tables.fill_forward(e, ["user_id"], ["ts", "event_id"], "header").select("event_id", "header")


@query("SELECT event_id, coalesce(h, first_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS chapter FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS h FROM events)")
def w11_look_ahead(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("chapter", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return tables.look_ahead(e, ["user_id"], ["ts", "event_id"], "chapter", 3).select("event_id", "chapter")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS seq FROM documents")
def w16_section_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("seq"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def t06_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(100).limit(50)


@query("SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id ORDER BY last_at DESC NULLS LAST, user_id DESC LIMIT 30")
def t07_recent_threads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_at")).orderBy(F.desc_nulls_last("last_at"), F.desc("user_id")).limit(30)


@query("SELECT o_custkey, max_by(o_orderkey, struct_pack(a := o_totalprice, b := -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def t08_best_candidate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey) AS place FROM orders")
def t09_deadline_order(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("deadline"))
    # a day each; the rows without a deadline, which share one, by runs of ids
    buckets = [F.to_date("deadline"), F.when(F.col("deadline").isNull(), F.floor(F.col("o_orderkey") / 100_000))]
    return tables.numbered(o, buckets, [F.asc_nulls_first("deadline"), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 EXCEPT SELECT p_partkey FROM part WHERE p_partkey % 3 = 0")
def u01_set_difference(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    return p.filter("p_partkey % 2 = 0").join(p.filter("p_partkey % 3 = 0"), "p_partkey", "left_anti")


@query("SELECT -conv_id AS id, 0 AS origin FROM conversations WHERE turn = 0 UNION ALL SELECT doc_id, 1 FROM documents")
def u03_hot_and_cold(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "conversations").filter("turn = 0").select((-F.col("conv_id")).alias("id"), F.lit(0).alias("origin"))
    return live.unionByName(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("origin")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 0 END AS k FROM events")
def u05_last_wins_merge(spark: SparkSession, d: str) -> DataFrame:
    old = F.from_json("props", "map<string,bigint>")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("long") + 1000)).otherwise(F.create_map().cast("map<string,bigint>"))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("new"), k)), "new")
    return table(spark, d, "events").withColumn("new", new).select("event_id", F.try_element_at(merged, F.lit("k")).alias("k"))


@query("SELECT DISTINCT conv_id, role, false AS made FROM conversations UNION ALL SELECT conv_id, role, true FROM (SELECT DISTINCT conv_id FROM conversations) JOIN (SELECT DISTINCT role FROM conversations) ON true WHERE (conv_id, role) NOT IN (SELECT conv_id, role FROM conversations)")
def u07_missing_completed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "role").distinct()
    roles = c.select("role").distinct()
    wanted = search.meet(c.select("conv_id").distinct(), roles, F.lit(True), row_id="conv_id", query_id="role")  # broadcasts up to 4,096 roles, deals more to blocks
    return c.withColumn("made", F.lit(False)).unionByName(wanted.join(c, ["conv_id", "role"], "left_anti").withColumn("made", F.lit(True)))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 50000 AND 150000 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey % 3 = 1")
def f08_dynamic_filter(spark: SparkSession, d: str) -> DataFrame:
    given = {"o_orderstatus": "O"}
    terms = [F.col(c) == v for c, v in given.items()] + [F.col("o_totalprice").between(50000, 150000), F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), F.col("o_custkey") % 3 == 1]
    return table(spark, d, "orders").filter(reduce(lambda a, b: a & b, terms)).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate >= TIMESTAMP '1996-01-01' END AS recruiting FROM orders WHERE o_orderkey % 5 = 0 OR o_orderdate >= TIMESTAMP '1996-01-01'")
def f04_three_valued(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", p.alias("recruiting")).filter(~F.col("recruiting").eqNullSafe(False))


@query("SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_mktsegment = '') AND (c_acctbal > 5000 OR c_nationkey = 3)")
def f05_disjunctive_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter((F.col("c_mktsegment").isin("BUILDING", "MACHINERY") | (F.col("c_mktsegment") == "")) & ((F.col("c_acctbal") > 5000) | (F.col("c_nationkey") == 3))).select("c_custkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 10")
def f15_quota(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(table(spark, d, "documents").select("doc_id", "lang"), 10, "lang", [F.col("doc_id")]).select("doc_id")


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN true WHEN source IN ('src3', 'src4') THEN length(text) > 3500 ELSE false END AS chunked FROM documents")
def f01_chunk_policy(spark: SparkSession, d: str) -> DataFrame:
    from granary.operators.chunking import should_chunk

    policy = F.when(F.col("source").isin("src1", "src2"), "always").when(F.col("source").isin("src3", "src4"), "optional").otherwise("never")
    return table(spark, d, "documents").select("doc_id", should_chunk(F.length("text"), policy).alias("chunked"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 AND p_partkey % 3 = 0 THEN CASE WHEN p_size = p_size + p_partkey % 2 THEN 'keep' ELSE 'update' END WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'keep' ELSE 'deactivate' END ELSE 'insert' END AS action FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 = 0")
def k05_three_way_sync(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("origin"))
    new = p.filter("p_partkey % 3 = 0").withColumn("p_size", (F.col("p_size") + F.col("p_partkey") % 2).cast("int"))
    done = p.filter("origin <> 0").select("origin").distinct()
    return tables.snapshot_actions(p.filter("p_partkey % 4 = 0"), new, ["origin", "p_partkey"], ["p_size"], "origin", done).select("p_partkey", "action")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size < 20 THEN 'reopen' WHEN p_partkey % 2 = 0 THEN 'keep' WHEN p_size < 20 AND CAST(DATE '2024-01-01' + CAST(p_size * 3 AS INTEGER) AS VARCHAR) <= '2024-01-31' THEN 'delete' WHEN p_size < 20 THEN 'keep' ELSE 'close' END AS action FROM part"""
)
def r13_soft_close(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    stored = p.select("p_partkey", F.when(F.col("p_size") < 20, "closed").otherwise("open").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size") * 3).cast("string").alias("closed_on"))
    return tables.soft_close(stored, p.filter("p_partkey % 2 = 0").select("p_partkey"), "p_partkey", "2024-03-01").select("p_partkey", "action")


@query("SELECT conv_id, role, head FROM (SELECT DISTINCT conv_id, role, substr(text, 1, 200) AS head FROM conversations WHERE turn % 2 = 1 EXCEPT SELECT DISTINCT conv_id, role, substr(text, 1, 200) FROM conversations WHERE turn % 2 = 0)")
def r10_idempotent_append(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return tables.idempotent_append(c.filter("turn % 2 = 0"), c.filter("turn % 2 = 1"), "conv_id", "role", "text").select("conv_id", "role", F.substring("text", 1, 200).alias("head"))


@query("SELECT o_custkey, greatest(coalesce(max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END), max(o_orderdate)), max(o_orderdate)) AS cursor_at FROM orders GROUP BY o_custkey")
def r12_cursor(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate"))).alias("old"), F.max("o_orderdate").alias("new"))
    return per.select("o_custkey", tables.moved_cursor(F.col("old"), F.col("new")).alias("cursor_at"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def r03_hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 75 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS events FROM k GROUP BY user_id, n"""
)
def r07_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = e.groupBy("user_id", F.session_window("ts", "75 minutes")).agg(F.count(F.lit(1)).alias("events"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "events")


@query("SELECT lang AS collection, count(*) AS n, count(*) BETWEEN 110 AND 700 AS in_range FROM documents GROUP BY lang")
def e01_collection_ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("lang").alias("collection")).agg(F.count(F.lit(1)).alias("n")).withColumn("in_range", F.col("n").between(110, 700))


@query("SELECT lang, bool_or(contains(lower(substr(text, 1, 200)), 'license')) AS noisy, bool_or(contains(substr(text, 1, 30), 'The')) AS essential FROM documents GROUP BY lang")
def e03_noise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.bool_or(F.contains(F.lower(F.substring("text", 1, 200)), F.lit("license"))).alias("noisy"), F.bool_or(F.contains(F.substring("text", 1, 30), F.lit("The"))).alias("essential"))


@query("SELECT conv_id, turn, round((a + b) / 2.0, 6) AS coverage, CASE WHEN contains(lower(text), 'password') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS conflict_free, round(((a + b) / 2.0 + CASE WHEN contains(lower(text), 'password') THEN 0.0 ELSE 1.0 END) / 2, 6) AS score FROM (SELECT *, CAST(contains(lower(text), 'the') AS INT) AS a, CAST(contains(lower(text), 'and') AS INT) AS b FROM conversations)")
def e07_contextual_metrics(spark: SparkSession, d: str) -> DataFrame:
    from granary.operators.evaluation import contextual

    m = contextual(F.col("text"), F.lit(None).cast("array<string>"), text.words("the", "and"), text.words("password"))
    return table(spark, d, "conversations").select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.round("m.context_adherence", 6).alias("coverage"), "m.conflict_free", F.round("m.score", 6).alias("score"))


@query("SELECT round(avg(quality), 6) AS mean_quality, avg(quality) >= 0.7 AS quality_passed, count_if(toxic = 1) <= 1000 AS count_passed, avg(toxic) <= 0.5 AS ratio_passed, avg(quality) >= 0.7 AND count_if(toxic = 1) <= 1000 AND avg(toxic) <= 0.5 AS passed FROM labels")
def e08_gate(spark: SparkSession, d: str) -> DataFrame:
    from granary.operators.evaluation import ci_gate

    runs = table(spark, d, "labels").select(F.col("quality").cast("double").alias("faithfulness"), (F.col("toxic") == 1).alias("timeout"))
    g = ci_gate(runs, {"faithfulness": 0.7, "answer_relevancy": 0.6}, most_timeouts=1000, most_ratio=0.5)
    return g.select(F.round("faithfulness", 6).alias("mean_quality"), F.col("faithfulness_passed").alias("quality_passed"), "count_passed", "ratio_passed", "passed")


@query("SELECT doc_id, least(100, greatest(0, quality * 60 + toxic * 50)) AS total, least(100, greatest(0, quality * 60 + toxic * 50)) >= CASE lang WHEN 'en' THEN 75 ELSE 60 END AS passed FROM labels JOIN documents USING (doc_id)")
def e10_rubric(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    total = F.least(F.lit(100), F.greatest(F.lit(0), F.col("quality") * 60 + F.col("toxic") * 50))
    return both.select("doc_id", total.alias("total"), (total >= F.when(F.col("lang") == "en", 75).otherwise(60)).alias("passed"))
