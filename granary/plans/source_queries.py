"""Sources and sinks: each query writes test rows as files to the shared folder and reads them back through a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import pages
from granary.plans.registry import query, table
from granary.sources import files, schemas, sections


def written_text(df: DataFrame, label: str) -> str:
    """The one column as lines of one file."""
    path = files.scratch(df.sparkSession, label)
    df.coalesce(1).write.text(path)
    return path


def one_document(df: DataFrame, label: str) -> str:
    """All rows, ordered by their first column, as one JSON document or text of one file."""
    path = files.scratch(df.sparkSession, label)
    df.coalesce(1).write.json(path)
    return path


@query("SELECT CAST(item_id AS INTEGER) AS id, text AS question, 'd' || item_id % 3 AS domain, 'k' || item_id AS keyword FROM benchmark WHERE item_id % 7 <> 3")
def s01_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Malformed and blank lines among good ones."""
    b = table(spark, d, "benchmark")
    good = F.to_json(F.struct(F.col("item_id").alias("id"), F.col("text").alias("question"), F.concat(F.lit("d"), F.col("item_id") % 3).alias("domain"), F.array(F.concat(F.lit("k"), "item_id")).alias("expected_keywords")))
    lines = b.select(F.when(F.col("item_id") % 7 != 3, good).when(F.col("item_id") % 2 == 0, "").otherwise("{broken").alias("value"))
    rows = files.json_lines(spark, written_text(lines, "lines"), schemas.BENCHMARK)
    return rows.filter("id IS NOT NULL").select("id", "question", "domain", F.get("expected_keywords", F.lit(0)).alias("keyword"))


@query("SELECT 'good' AS kind, CAST(item_id AS VARCHAR) AS value FROM benchmark WHERE item_id % 7 <> 3 UNION ALL SELECT 'bad', '{broken' || item_id FROM benchmark WHERE item_id % 7 = 3")
def s25_rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    lines = b.select(F.when(F.col("item_id") % 7 != 3, F.to_json(F.struct(F.col("item_id").alias("id")))).otherwise(F.concat(F.lit("{broken"), "item_id")).alias("value"))
    rows, bad = files.json_lines_with_rejects(spark, written_text(lines, "lines"), schemas.BENCHMARK)
    return rows.select(F.lit("good").alias("kind"), F.col("id").cast("string").alias("value")).unionByName(bad.select(F.lit("bad").alias("kind"), F.col("line").alias("value")))


@query("SELECT lang, doc_id, md5(text) AS text_md5 FROM documents")
def s03_collections(spark: SparkSession, d: str) -> DataFrame:
    """The folders of a domain-partitioned sink as so many collections."""
    path = files.scratch(spark, "domains")
    files.write_json_lines(table(spark, d, "documents").select("doc_id", "lang", "text"), path, by="lang")
    rows = files.folders(spark, path, "lang", "doc_id long, text string")
    return rows.select(F.col("collection").alias("lang"), "doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def s04_enveloped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").agg(F.count(F.lit(1)).alias("total_count"), F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("data"))
    return files.enveloped(spark, one_document(rows, "envelope"), "id int, name string")


@query(
    """SELECT r_name AS law_name, CAST(n_nationkey AS VARCHAR) AS article_number, n_name || chr(10) || 'c' || n_nationkey || chr(10) || 'i1' || chr(10) || 'i2' AS content FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 > 0
    UNION ALL SELECT r_name, CAST(n_nationkey AS VARCHAR), n_name || chr(10) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0 AND n_nationkey % 8 > 0"""
)
def s05_law_articles(spark: SparkSession, d: str) -> DataFrame:
    """Clauses and items below most articles; some articles are gone."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = F.array(F.struct(F.lit("1").alias("number"), F.lit("i1").alias("content")), F.struct(F.lit("2").alias("number"), F.lit("i2").alias("content")))
    clause = F.struct(F.lit("1").alias("number"), F.concat(F.lit("c"), "n_nationkey").alias("content"), items.alias("items"))
    content = F.when(F.col("n_nationkey") % 8 == 0, "삭제 <2020. 1. 1.>").otherwise(F.col("n_name"))
    article = F.struct(F.col("n_nationkey").cast("string").alias("number"), F.lit("t").alias("title"), content.alias("content"), F.when(F.col("n_nationkey") % 4 > 0, F.array(clause)).alias("clauses"))
    laws = n.groupBy("r_name").agg(F.collect_list(article).alias("articles")).select(F.struct(F.col("r_name").alias("law_id"), F.col("r_name").alias("name"), "articles").alias("l"))
    return files.law_articles(spark, one_document(laws.agg(F.collect_list("l").alias("laws")), "laws")).select("law_name", "article_number", "content")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, '나라, ' || n_name AS name FROM nation WHERE n_nationkey % 3 > 0")
def s06_legacy_csv(spark: SparkSession, d: str) -> DataFrame:
    """EUC-KR bytes with quoted commas; rows of a status stay."""
    lines = table(spark, d, "nation").select("n_nationkey", F.concat(F.col("n_nationkey").cast("string"), F.lit(",\"나라, "), "n_name", F.lit('",'), F.when(F.col("n_nationkey") % 3 > 0, "존재").otherwise("폐지")).alias("line"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n").alias("b")).select(F.concat(F.lit("코드,이름,상태\n"), "b").alias("b"))
    path = files.scratch(spark, "legacy")
    files.write_bytes(spark, path, body.first()[0].encode("euc-kr"))
    return files.legacy_csv(spark, path, keep=F.col("상태") == "존재").select(F.col("코드").alias("code"), F.col("이름").alias("name"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN '' END AS note FROM nation")
def s08_xml_items(spark: SparkSession, d: str) -> DataFrame:
    col = lambda name, value: F.concat(F.lit(f'<col name="{name}"> '), value, F.lit(" </col>"))
    lines = table(spark, d, "nation").select(F.concat(F.lit("<item>"), col("id", F.col("n_nationkey").cast("string")), col("name", F.col("n_name")), F.when(F.col("n_nationkey") % 2 == 0, '<col name="note"/>').otherwise(""), F.lit("</item>")).alias("value"))
    rows = files.xml_items(spark, written_text(lines.agg(F.concat(F.lit("<items>"), F.array_join(F.collect_list("value"), ""), F.lit("</items>"))), "xml"))
    return rows.select(*[F.try_element_at("cols", F.lit(n)).alias(n) for n in ("id", "name", "note")])


@query("SELECT 'txt' AS suffix, CAST(sum(octet_length(encode(r_name)) + 1) AS BIGINT) AS bytes FROM region")
def s13_binary_files(spark: SparkSession, d: str) -> DataFrame:
    path = written_text(table(spark, d, "region").select("r_name"), "texts")
    return files.binary_files(spark, f"{path}/*.txt").groupBy("suffix").agg(F.sum(F.octet_length("content")).alias("bytes"))


PAGE_LINES = "list_aggregate(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0B]')), 'string_agg', chr(10))"


@query(
    f"""WITH t AS (SELECT conv_id, turn, role = 'user' AS asks, {PAGE_LINES} AS held FROM conversations), u AS (SELECT *, sum(CAST(asks AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM t),
    q AS (SELECT conv_id, item, max(CASE WHEN asks THEN turn END) AS turn, max(CASE WHEN asks THEN held END) AS question, arg_max(CASE WHEN NOT asks THEN coalesce(held || chr(10), '') || '(임금정책과-' || turn || ', 2020.1.' || conv_id % 28 + 1 || '.)' END, CASE WHEN NOT asks THEN turn END) AS answer FROM u WHERE item > 0 GROUP BY conv_id, item),
    s AS (SELECT *, coalesce(CAST(max(CASE WHEN turn // 2 % 2 = 0 THEN turn // 4 + 4 END) OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), '') AS section FROM q)
    SELECT CAST(conv_id AS VARCHAR) AS file, 'INTER_C03_S' || CASE WHEN length(section) < 2 THEN lpad(section, 2, '0') ELSE section END || '_' || format('{{:02d}}', row_number() OVER (PARTITION BY conv_id, section ORDER BY item)) AS id, '총칙' AS chapter_title, section, 'head ' || turn || ' of two' AS title, question, coalesce(answer, '') AS answer, CASE WHEN answer IS NULL THEN '' ELSE regexp_extract(answer, '임금정책과-\\d+') END AS admin_no FROM s"""
)
def s15_page_items(spark: SparkSession, d: str) -> DataFrame:
    """Conversations laid out on pages: headings, a title in two lines, marks, lines across pages, a last line, noise behind it and page feet."""
    c = table(spark, d, "conversations").withColumn("asks", F.col("role") == "user")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\s]"))
    place = lambda page, y, text, mark=None: F.struct((F.col("turn") * 1000 + page).alias("page"), F.lit(y).cast("double").alias("y"), (text if isinstance(text, Column) else F.lit(text)).alias("text"), F.lit(mark).cast("string").alias("mark"))
    body = F.transform(lines, lambda x, i: F.struct((F.col("turn") * 1000 + F.floor(i / 40)).alias("page"), (100.0 + i % 40 * 12).alias("y"), x.alias("text"), F.lit(None).cast("string").alias("mark")))
    feet = F.transform(lines, lambda x, i: F.struct((F.col("turn") * 1000 + F.floor(i / 40)).alias("page"), F.lit(900.0).alias("y"), F.lit("총칙 / 12").alias("text"), F.lit(None).cast("string").alias("mark")))
    part = F.floor(F.col("turn") / 4)
    first = F.when(F.col("turn") == 0, F.array(place(0, 1, "제 3 장"), place(0, 2, "총 칙"))).otherwise(F.array().cast("array<struct<page:bigint,y:double,text:string,mark:string>>"))
    opened = F.when(F.col("asks") & (F.floor(F.col("turn") / 2) % 2 == 0), F.array(place(0, 20, F.concat((part + 4).cast("string"), F.lit(" 해고의 예고"))))).otherwise(F.array().cast("array<struct<page:bigint,y:double,text:string,mark:string>>"))
    asked = F.array(place(0, 50, F.concat(F.lit("head "), "turn")), place(0, 60, " of  two"), place(0, 90, None, "question"))
    closing = F.concat(F.lit("(임금정책과-"), "turn", F.lit(", 2020.1."), (F.col("conv_id") % 28 + 1).cast("string"), F.lit(".)"))
    answered = F.array(place(0, 90, None, "answer"), place(990, 10, closing), place(991, 10, "noise"))
    placed = F.concat(first, opened, F.when(F.col("asks"), asked).otherwise(answered), body, feet)
    rows = c.select(F.col("conv_id").cast("string").alias("file"), F.inline(placed))
    return pages.question_items(rows).select("file", "id", "chapter_title", "section", "title", "question", "answer", "admin_no")


def sections_of(spark: SparkSession, d: str, label: str, *lines: tuple[int | None, Column | str]) -> str:
    """Each benchmark item as a section of ``lines``; a line numbered n is left out of the items with item_id % 5 = n."""
    part = lambda at, c: F.when(F.col("item_id") % 5 != F.lit(at), c) if at is not None else c
    rows = table(spark, d, "benchmark").select(F.concat_ws("\n", *[part(at, F.lit(c) if isinstance(c, str) else c) for at, c in lines]).alias("value"))
    path = files.scratch(spark, label)
    rows.write.text(path)
    return path


ITEM = "format('{:03d}', item_id)"
BODY = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"


def body() -> Column:
    return F.coalesce("text", F.lit(""))


@query(
    f"""SELECT 'QA-' || {ITEM} AS id, CASE WHEN item_id % 5 = 4 THEN 'unknown' ELSE 'single' END AS type, 'd' || item_id % 3 AS domains, CASE WHEN item_id % 5 = 3 THEN '' ELSE 'P' || item_id % 7 END AS persona_id,
    CASE WHEN item_id % 5 = 3 THEN '' ELSE 'owner ' || item_id END AS persona, CASE WHEN item_id % 5 = 1 THEN '' ELSE {BODY} END AS question, CASE WHEN item_id % 5 IN (1, 2) THEN '' ELSE {BODY} || chr(10) || chr(10) || 'a' || item_id END AS answer,
    CASE WHEN item_id % 5 = 2 THEN '' ELSE '- e' || item_id || chr(10) || '- f' END AS evidence FROM benchmark"""
)
def s21_sections(spark: SparkSession, d: str) -> DataFrame:
    """Items whose type, persona, answer or evidence is missing keep the rest."""
    item = F.col("item_id")
    path = sections_of(
        spark, d, "named-sections",
        (None, F.concat(F.lit("### QA-"), F.format_string("%03d", item))),
        (4, "- Type: `single`"),
        (None, F.concat(F.lit("- Domains: `d"), item % 3, F.lit("`"))),
        (3, F.concat(F.lit("- Persona: `P"), item % 7, F.lit("` (owner "), item, F.lit(")"))),
        (None, F.concat(F.lit("**Question**\n"), body())),
        (1, F.concat(F.lit("**Answer**\n"), body(), F.lit("\n\na"), item)),
        (2, F.concat(F.lit("**Evidence**\n- e"), item, F.lit("\n- f\n"))),
    )
    return sections.named_items(spark, path)


@query(
    f"""SELECT 'Q' || item_id AS id, CASE WHEN item_id % 5 = 4 THEN '#### Q' || item_id || '. t' || item_id ELSE 't' || item_id END AS title, CASE WHEN item_id % 5 = 4 THEN '' ELSE 'P' || item_id % 7 END AS persona_id,
    CASE WHEN item_id % 5 = 4 THEN '' ELSE 'new owner' END AS persona, CASE WHEN item_id % 5 = 1 THEN '' ELSE {BODY} END AS question, CASE WHEN item_id % 5 IN (1, 2) THEN '' ELSE 'a' || item_id || chr(10) || {BODY} END AS answer,
    CASE WHEN item_id % 5 IN (2, 3) THEN '' ELSE '- v' || item_id END AS verification, CASE WHEN item_id % 5 = 3 THEN '' ELSE 'r' || item_id END AS reference FROM benchmark"""
)
def s22_numbered_sections(spark: SparkSession, d: str) -> DataFrame:
    item = F.col("item_id")
    path = sections_of(
        spark, d, "numbered-sections",
        (None, F.concat(F.lit("#### Q"), item, F.lit(". t"), item, F.lit(" —"), F.when(item % 5 != 4, F.concat(F.lit(" [P"), item % 7, F.lit(" new owner]"))).otherwise(""))),
        (None, F.concat(F.lit("**질문**: "), body())),
        (1, F.concat(F.lit("**기대 답변**: a"), item, F.lit("\n"), body())),
        (2, F.concat(F.lit("**검증 포인트**:\n- v"), item)),
        (3, F.concat(F.lit("**참조 데이터**: r"), item)),
        (None, "---"),
    )
    return sections.numbered_items(spark, path)


EVIDENCE = "'| e' || item_id || ' |' || chr(10) || '---'"


@query(
    f"""SELECT 'Q' || item_id AS id, CASE WHEN item_id % 5 = 4 THEN 'Medium' ELSE 'Hard' END AS difficulty, CASE WHEN item_id % 2 = 0 THEN 'B' ELSE '' END AS persona, CASE WHEN item_id % 5 = 0 THEN '' ELSE 'd' || item_id END AS domains,
    'law' AS source_type, {BODY} AS question, CASE WHEN item_id % 5 = 1 THEN '' ELSE 'a' || item_id || rtrim(chr(10) || chr(10) || {BODY}, chr(10)) END AS answer,
    CASE WHEN item_id % 5 = 2 THEN '' ELSE '---' || chr(10) || '**[답변 근거]** b' || item_id || CASE WHEN item_id % 5 = 3 THEN '' ELSE chr(10) || '**Evidence**:' || chr(10) || {EVIDENCE} END END AS basis,
    CASE WHEN item_id % 5 = 3 THEN '' ELSE {EVIDENCE} END AS evidence FROM benchmark"""
)
def s23_graded_sections(spark: SparkSession, d: str) -> DataFrame:
    """Quoted questions over several lines; an answer without a basis ends at the next rule."""
    item = F.col("item_id")
    path = sections_of(
        spark, d, "graded-sections",
        (None, F.concat(F.lit("### Q"), item, F.lit(". t"), F.when(item % 5 != 4, F.lit(" [Hard]")).otherwise(""), F.when(item % 2 == 0, F.lit(" [페르소나 B: owner]")).otherwise(""))),
        (None, "**소스 유형**: `law`"),
        (None, F.concat(F.lit("**질문**:\n> "), F.regexp_replace(body(), "\n", "\n> "))),
        (0, F.concat(F.lit("**도메인**: "), F.when(item % 2 == 0, F.concat(F.lit("`d"), item, F.lit("`"))).otherwise(F.concat(F.lit("d"), item)))),
        (None, F.when(item % 5 == 1, F.lit("**기대 답변** is missing")).otherwise(F.concat(F.lit("**기대 답변**:\na"), item, F.lit("\n\n"), body()))),
        (None, F.when(item % 5 == 2, F.lit("---")).otherwise(F.concat(F.lit("---\n**[답변 근거]** b"), item))),
        (3, F.concat(F.lit("**Evidence**:\n| e"), item, F.lit(" |\n---"))),
    )
    return sections.graded_items(spark, path)


@query(
    f"""SELECT substr('UVWX', CAST(item_id % 4 AS INTEGER) + 1, 1) || '-' || {ITEM} AS id, 'd' || item_id % 3 AS domain, CASE WHEN item_id % 5 = 4 THEN '' ELSE '상' END AS difficulty, {BODY} AS question, 'a' || item_id || chr(10) || {BODY} AS ground_truth
    FROM benchmark WHERE item_id % 5 NOT IN (1, 2)"""
)
def s24_evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """A section without a domain or an answer is no row; an answer ends at its basis or at the points to verify."""
    item = F.col("item_id")
    mark = F.substring(F.lit("UVWX"), (item % 4 + 1).cast("int"), F.lit(1))
    path = sections_of(
        spark, d, "evaluation-sections",
        (None, F.concat(F.lit("### "), mark, F.lit("-"), item, F.lit(". t"))),
        (1, F.concat(F.lit("- **도메인**: d"), item % 3)),
        (4, "- **난이도**: 상"),
        (None, F.concat(F.lit("**질문**: "), body(), F.lit("\n"))),
        (2, F.concat(F.lit("**기대 답변**:\n\na"), item, F.lit("\n"), body())),
        (None, F.when(item % 2 == 0, F.lit("---\n**[답변 근거]**")).otherwise(F.lit("\n**검증 포인트**"))),
    )
    return sections.evaluation_rows(spark, path)


@query("SELECT 'line ' || event_id AS line FROM events WHERE event_id BETWEEN (SELECT max(event_id) - 39 FROM events) AND (SELECT max(event_id) - 20 FROM events)")
def s26_log_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty, newest first."""
    path = files.scratch(spark, "log")
    ordered = table(spark, d, "events").select("event_id", F.concat(F.lit("line "), "event_id").alias("value")).repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.select("value").write.text(path)  # the files' names follow the ranges
    return files.log_page(spark, path, 2, 20)


@query("SELECT doc_id, lang, '카 ' || source AS source, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n FROM documents")
def k01_json_sink(spark: SparkSession, d: str) -> DataFrame:
    """Non-ASCII letters and nulls come back."""
    path = files.scratch(spark, "sink")
    docs = table(spark, d, "documents").select("doc_id", "lang", F.concat(F.lit("카 "), "source").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("n"))
    files.write_json_lines(docs, path)
    return files.json_lines(spark, path, "doc_id long, lang string, source string, n long")


@query("SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN 'new' ELSE 'old' END AS state FROM documents WHERE lang <> 'fr' OR doc_id % 2 = 0")
def k02_collection_sink(spark: SparkSession, d: str) -> DataFrame:
    """Writing one collection anew leaves the others."""
    path = files.scratch(spark, "collections")
    docs = table(spark, d, "documents").select("doc_id", "lang", F.lit("old").alias("state"))
    files.write_collection(docs, path, "lang")
    files.write_collection(docs.filter("lang = 'fr' AND doc_id % 2 = 0").withColumn("state", F.lit("new")), path, "lang")
    return spark.read.parquet(path).select("doc_id", "lang", "state")


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_name END AS p_name, (SELECT count_if(p_partkey % 9 = 0) FROM part) AS changed FROM part")
def k03_rewrite(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "rewrite")
    before = table(spark, d, "part").select("p_partkey", "p_name")
    after = before.withColumn("p_name", F.when(F.col("p_partkey") % 9 == 0, "x").otherwise(F.col("p_name")))
    changed = files.rewrite_if_changed(before, after, "p_partkey", path)
    return spark.read.parquet(path).withColumn("changed", F.lit(changed).cast("long"))


@query("SELECT lang AS stage, count(*) AS n, round(avg(length(text)), 4) AS mean FROM documents GROUP BY lang")
def k08_json_report(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark, "report")
    report = table(spark, d, "documents").groupBy(F.col("lang").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean"))
    files.write_report(report, path)
    return files.json_lines(spark, path, "stage string, n long, mean double")


@query("SELECT '| ' || lang || ' | ' || count(*) || ' |' AS line FROM documents GROUP BY lang UNION ALL SELECT '| stage | n |' UNION ALL SELECT '| --- | --- |'")
def k09_markdown_report(spark: SparkSession, d: str) -> DataFrame:
    report = table(spark, d, "documents").groupBy(F.col("lang").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(x,) for x in files.markdown_report(report, most=1000).split("\n")], "line string")


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def k11_turn_store(spark: SparkSession, d: str) -> DataFrame:
    """A stream of turns, delivered twice, appended once."""
    from granary.streaming import state

    source, target = files.scratch(spark, "turns"), files.scratch(spark, "store")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    turns.write.parquet(source)
    for _ in range(2):
        live = spark.readStream.schema(turns.schema).parquet(source)
        state.append_new(live, target, files.scratch(spark, "progress"), ["conv_id", "turn"]).awaitTermination()
    return spark.read.schema(turns.schema).parquet(target).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"))
