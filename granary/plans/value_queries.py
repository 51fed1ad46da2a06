"""Values, filters and cleaned texts, one query for each expression that the other modules do not show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scalars, tables, text
from granary.plans.registry import query, table


def case(key: str, *values: str | F.Column | None) -> F.Column:
    """The n-th value where the key's remainder is n."""
    out = F
    for k, v in enumerate(values):
        out = out.when(F.col(key) % len(values) == k, F.lit(v) if v is None or isinstance(v, str) else v)
    return out


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS first_day, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') WHEN o_orderkey % 4 = 1 THEN '2026-02-10' END AS last_day FROM orders"""
)
def d02_ranges(spark: SparkSession, d: str) -> DataFrame:
    day = lambda c, f: F.date_format(c, f)
    later = F.col("o_orderdate") + F.expr("interval 30 days")
    raw = case("o_orderkey", F.concat(day("o_orderdate", "yyyy.MM.dd"), F.lit(" ~ "), day(later, "yyyyMMdd")), F.concat(day("o_orderdate", "yyyyMMdd"), F.lit("-2026.02.10")), day("o_orderdate", "yyyyMMdd"), F.concat(day("o_orderdate", "yyyy-MM-dd"), F.lit(" ~ 2026-02-10")))
    return table(spark, d, "orders").select("o_orderkey", scalars.iso_range(raw).alias("r")).select("o_orderkey", F.col("r.start").alias("first_day"), F.col("r.end").alias("last_day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def d04_eight_digits(spark: SparkSession, d: str) -> DataFrame:
    raw = case("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd"), F.date_format("o_orderdate", "yyMMdd"), F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, d, "orders").select("o_orderkey", scalars.eight_digits(raw).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def d05_dotted_dates(spark: SparkSession, d: str) -> DataFrame:
    raw = case("o_orderkey", F.date_format("o_orderdate", "yyyy.M.d."), F.date_format("o_orderdate", "yyyy.M"))
    return table(spark, d, "orders").select("o_orderkey", scalars.dotted_date(raw).alias("day"))


@query("SELECT event_id, round(greatest(0, least(1, 1 - value / 50)), 9) AS similarity FROM events")
def d09_similarities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(scalars.similarity(F.col("value") / 50), 9).alias("similarity"))


@query("SELECT conv_id, s[least(n - 1, n * 50 // 100) + 1] AS p50, s[least(n - 1, n * 95 // 100) + 1] AS p95, s[n] AS p100 FROM (SELECT conv_id, list_sort(list(length(text))) AS s, count(*) AS n FROM conversations GROUP BY conv_id)")
def d10_nearest_ranks(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("long")).alias("v"))
    return held.select("conv_id", *[scalars.nearest_rank(F.col("v"), p).alias(f"p{p}") for p in (50, 95, 100)])


@query("SELECT doc_id, md5(substr(text, 1, 500)) AS key FROM documents")
def d12_content_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.content_key(F.col("text")).alias("key"))


@query("SELECT conv_id, turn, sha256(CASE WHEN turn % 2 = 0 THEN role || ':' ELSE '' END || regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS key FROM conversations")
def d13_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    domain = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("")
    return table(spark, d, "conversations").select("conv_id", "turn", scalars.cache_key(F.col("text"), domain).alias("key"))


@query("SELECT p_partkey, substr(md5(lower(p_name || '|' || p_brand)), 1, 12) AS hash FROM part")
def d14_announcement_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", scalars.short_key(F.col("p_name"), F.col("p_brand")).alias("hash"))


@query(
    """WITH m AS (SELECT conv_id, list({'role': role, 'content': substr(text, 1, 200)} ORDER BY turn) AS h FROM conversations GROUP BY conv_id)
    SELECT conv_id, 'q' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE chr(10) || '#h:' || substr(md5(CAST(to_json(h[greatest(len(h) - 7, 1):]) AS VARCHAR)), 1, 10) END AS key FROM m"""
)
def d15_conversation_keys(spark: SparkSession, d: str) -> DataFrame:
    said = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    per = table(spark, d, "conversations").groupBy("conv_id").agg(said.alias("h"))
    return per.select("conv_id", scalars.conversation_key(F.lit("q"), F.when(F.col("conv_id") % 3 != 0, F.col("h"))).alias("key"))


@query("SELECT p_partkey, CAST(p_size % 2 + 2 * (p_size // 2 % 2) + CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE 4 * (p_size // 4 % 2) END AS INTEGER) AS mask FROM part")
def d17_masks(spark: SparkSession, d: str) -> DataFrame:
    bit = lambda k: F.floor(F.col("p_size") / k) % 2 == 1
    return table(spark, d, "part").select("p_partkey", scalars.encode_bits([bit(1), bit(2), F.when(F.col("p_partkey") % 3 != 0, bit(4))]).alias("mask"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ', ' || p_size WHEN 2 THEN 'name: ' || p_name || chr(10) || 'sizes: ' || p_size || ', 2'
    WHEN 3 THEN p_brand || ': ' || p_name || chr(10) || 'b: 1, c: x' ELSE '' END AS text FROM part"""
)
def d20_values_as_text(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.to_json(F.array(F.col("p_name")))
    name = F.regexp_replace(quoted, r"^\[|\]$", "")
    raw = case(
        "p_partkey",
        name,
        F.concat(F.lit("["), name, F.lit(", "), "p_size", F.lit("]")),
        F.concat(F.lit('{"name": '), name, F.lit(', "sizes": ['), "p_size", F.lit(", 2]}")),
        F.concat(F.lit('[{"type": "'), "p_brand", F.lit('", "description": '), name, F.lit('}, {"b": 1, "c": "x"}]')),
        "[]",
    )
    return table(spark, d, "part").select("p_partkey", tables.json_as_text(raw).alias("text"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'type: ' || p_type || ', required: ' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || CASE WHEN p_partkey % 4 = 1 THEN ', condition: ' || p_brand ELSE '' END || ', authority: '
    || chr(10) || ' type: , required: false, authority: a' END AS text FROM part"""
)
def d22_licences(spark: SparkSession, d: str) -> DataFrame:
    kind = "struct<type:string,required:boolean,condition:string,authority:string>"
    one = F.struct(F.col("p_type").alias("type"), (F.col("p_size") > 25).alias("required"), F.when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).alias("condition"), F.lit(None).alias("authority")).cast(kind)
    two = F.struct(F.lit(None).alias("type"), F.lit(None).alias("required"), F.lit(None).alias("condition"), F.lit("a").alias("authority")).cast(kind)
    return table(spark, d, "part").select("p_partkey", scalars.licences_text(F.when(F.col("p_partkey") % 4 != 0, F.array(one, two))).alias("text"))


@query(
    """WITH n AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT r_name, '| region | nation(name) | nation(key) |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || r_name || ' | ' || CASE WHEN k = 1 THEN n_name ELSE r_name || '(' || n_name || ')' END || ' | ' || n_nationkey || ' |', chr(10) ORDER BY k) AS markdown FROM n GROUP BY r_name"""
)
def d23_html_tables(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    first = F.concat(F.lit('<td rowspan="'), F.size("rows"), F.lit('">'), "r_name", F.lit("</td>"))
    line = lambda x, k: F.concat(F.lit("<tr>"), F.when(k == 0, first).otherwise(""), F.lit("<td>"), x["n_name"], F.lit("</td><td> "), x["n_nationkey"], F.lit(" </td></tr>"))
    head = '<p>x</p><table><thead><tr><th rowspan="2">region</th><th colspan="2">nation</th></tr><tr><th>name</th><th>key</th></tr></thead><tbody>'
    html = F.concat(F.lit(head), F.array_join(F.transform("rows", line), ""), F.lit("</tbody></table>"))
    return rows.select("r_name", tables.markdown_table(html).alias("markdown"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'x' || chr(10) || '| ab(' || n_name || ') | ab | c |' || chr(10) || '| --- | --- | --- |' ELSE 'x' || chr(10) || '| a | b | c |' || chr(10) || '| ' || n_name || ' | | c |' || chr(10) || '| --- | --- | --- |' END AS text FROM nation")
def d24_headings(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace("n_name", F.lit(" "), F.lit(""))
    rows = F.concat(F.lit("x\n"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("| a b | a b | c |\n| "), name, F.lit(" | | c |"))).otherwise(F.concat(F.lit("| a | b | c |\n| "), "n_name", F.lit(" | | c |"))), F.lit("\n| --- | --- | --- |"))
    found = table(spark, d, "nation").select("n_nationkey", "n_name", tables.single_heading(rows).alias("text"))
    return found.select("n_nationkey", F.replace("text", F.concat(F.lit("("), name, F.lit(")")), F.concat(F.lit("("), "n_name", F.lit(")"))).alias("text"))


GUIDE_RAW = "coalesce('![a](b)' || chr(10) || '```markdown' || chr(10) || text || chr(10) || '---' || chr(10) || '[TYPE: form]' || chr(10), '')"
GUIDE_BARE = reduce(lambda sql, pattern: f"regexp_replace({sql}, '{pattern}', '', 'g')", text.GUIDE_MARKS, GUIDE_RAW)
GUIDE_LINES = f"list_aggregate(list_transform(string_split(regexp_replace({GUIDE_BARE}, '[ \\t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')), 'string_agg', chr(10))"


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace({GUIDE_LINES}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents")
def c05_guides(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("![a](b)\n```markdown\n"), "text", F.lit("\n---\n[TYPE: form]\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.guide_text(raw).cast("binary")).alias("cleaned"))


SHORT_NAME = "CASE WHEN length({c}) > 60 THEN substr({c}, 1, 60) || '…' ELSE {c} END"


@query(
    f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN '[' || {SHORT_NAME.format(c='p_name')} || ']' WHEN p_partkey % 3 = 1 THEN '[' || {SHORT_NAME.format(c='p_name')} || ' > 제' || p_size || '조]'"
    f" ELSE '[' || {SHORT_NAME.format(c='repeat(p_name, 9)')} || ' > 제' || p_size || '조(' || p_type || ')]' END AS prefix FROM part"
)
def c18_law_prefixes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    none = F.col("p_partkey") % 5 == 0
    law = F.when(none, None).when(F.col("p_partkey") % 3 == 2, F.repeat("p_name", F.lit(9))).otherwise(F.col("p_name"))
    number = F.when(~none & (F.col("p_partkey") % 3 != 0), F.col("p_size").cast("string"))
    return p.select("p_partkey", text.law_prefix(law, number, F.when(F.col("p_partkey") % 3 == 2, F.col("p_type"))).alias("prefix"))


@query("SELECT conv_id, turn, contains(text, ' the ') AS legal FROM conversations")
def c20_legal(spark: SparkSession, d: str) -> DataFrame:
    said = F.replace("text", F.lit(" the "), F.concat(F.lit(" 제"), (F.col("turn") + 1).cast("string"), F.lit("조 ")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.legal(said).alias("legal"))


@query("SELECT p_partkey, '| a | b |' || chr(10) || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '※ 참고: ' || p_brand || chr(10) || p_type ELSE '' END AS text FROM part")
def c21_references(spark: SparkSession, d: str) -> DataFrame:
    note = F.concat(F.lit("|참고  "), "p_brand", F.lit(" | "), "p_type", F.lit(" |\n"))
    raw = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(note, note)).otherwise(""), F.lit("| a | b |\n"), "p_name")
    return table(spark, d, "part").select("p_partkey", text.references_to_end(raw).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '임금정책과-' || o_custkey ELSE '' END AS number, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y.%-m.%-d') ELSE '' END AS date FROM orders")
def c25_admin_info(spark: SparkSession, d: str) -> DataFrame:
    inner = F.concat(F.lit("임금정책과-"), "o_custkey", F.lit(", "), F.date_format("o_orderdate", "yyyy.M.d"))
    raw = case("o_orderkey", F.concat(F.lit("회시 ("), inner, F.lit(".) 끝")), F.concat(F.lit("("), inner, F.lit(")")), F.concat(F.lit("["), inner, F.lit("]")))
    return table(spark, d, "orders").select("o_orderkey", text.admin_info(raw).alias("a")).select("o_orderkey", "a.number", "a.date")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey % 7 = 3")
def f09_live_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumns({"use_yn": F.col("o_orderstatus") != "P", "owner": F.col("o_custkey") % 7})
    return o.filter(F.col("use_yn") & (F.col("owner") == 3)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 3 <> 1")
def f10_titled(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", case("p_partkey", F.col("p_name"), "", None).alias("title"))
    return p.filter(~(F.coalesce("title", F.lit("x")) == "")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 1)")
def f11_required_keys(spark: SparkSession, d: str) -> DataFrame:
    raw = case("p_partkey", '{"code": 1, "name": "x"}', '{"name": null, "code": null, "more": 1}', '{"code": 1}', "[1, 2]")
    return table(spark, d, "part").filter(scalars.has_keys(raw, ["code", "name"])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'steel') OR contains(lower(p_type), 'small')")
def f12_name_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(F.exists(text.words("steel", "small"), lambda w: F.contains(F.lower("p_type"), w))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT (p_partkey % 2 = 0 AND length(p_name) + 3 < 30)")
def f13_deleted(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(" 삭제")).otherwise(" 조문"))
    return table(spark, d, "part").filter(~(F.contains(body, F.lit("삭제")) & (F.length(body) < 30))).select("p_partkey")


@query("SELECT p_partkey, p_partkey % 7 < 5 AS edge FROM part")
def f14_page_edges(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    raw = case("p_partkey", F.concat(F.lit(" 제 "), n, F.lit(" 장의2 직장 내 괴롭힘 / "), n), F.concat(n, F.lit(" / 근로기준법 질의회시집")), "근로기준법  질의회시집 ", F.concat(F.lit("총칙 / "), n), F.concat(F.lit(" "), n), F.concat(n, F.lit(" 쪽")), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", text.page_edge(raw).alias("edge"))


@query("SELECT doc_id, md5(held) AS held FROM (SELECT doc_id, list_aggregate(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'icense') AND NOT contains(x, 'password')), 'string_agg', chr(10)) AS held FROM documents) WHERE length(held) >= 50")
def f16_without_refusals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.kept_parts(F.split("text", "\n", -1), ["icense", "password"]).alias("held"))
    return docs.filter("held IS NOT NULL").select("doc_id", F.md5(F.col("held").cast("binary")).alias("held"))


@query(
    """WITH c AS (SELECT *, CASE WHEN turn % 5 = 4 THEN ' ' ELSE ' ' || text END AS said FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM c WHERE role IN ('user', 'assistant') AND regexp_replace(said, '^\\s+|\\s+$', '', 'g') <> '')
    SELECT conv_id, md5(string_agg(role || ':' || regexp_replace(said, '^\\s+|\\s+$', '', 'g'), '|' ORDER BY turn)) AS history, count(*) AS n FROM k WHERE n <= 3 GROUP BY conv_id"""
)
def f17_histories(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("turn") % 5 == 4, " ").otherwise(F.concat(F.lit(" "), "text"))
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("content")))).alias("h"))
    kept = per.select("conv_id", text.plain_history(F.col("h"), 3).alias("h")).filter(F.size("h") > 0)
    joined = F.array_join(F.transform("h", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return kept.select("conv_id", F.md5(joined.cast("binary")).alias("history"), F.size("h").cast("long").alias("n"))
