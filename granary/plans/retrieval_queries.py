"""Retrieval put together: over-fetch, reranking, multi-query, graduated retry, neighbouring domains, final merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scalars, text
from granary.operators import ranking, search
from granary.plans.registry import query, table
from granary.plans.search_queries import BM25_CTE, LISTS_CTE, NTH, VECTOR_CTE, keyword_hits, vector_hits, vector_queries
from granary.sources import files

WORDS = "[\\pL\\pN_]+"
OVERLAP_SQL = f"CAST(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '{WORDS}')), list_distinct(regexp_extract_all(lower(substr(d.text, 1, 500)), '{WORDS}')))) AS INTEGER)"
WITH_DOCS = f"WITH {BM25_CTE}, h AS (SELECT kw.query_id, kw.doc_id, kw.rank, kw.score, b.text AS query, d.text AS content, d.lang, d.source, {OVERLAP_SQL} AS overlap FROM kw JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id))"


def hits(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    """query_id, doc_id, rank, score with query, content, lang and source; hits meet the documents first, as a small table that is sent to them."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "lang", "source")
    return keyword_hits(spark, d, k).join(c, "doc_id").join(b, "query_id")


def overlap(head: int = 500) -> F.Column:
    return F.size(F.array_intersect(text.word_set(F.col("query")), text.word_set(F.substring("content", 1, head))))


@query(f"WITH {BM25_CTE} SELECT query_id AS item_id, rank, doc_id FROM kw WHERE rank <= 3")
def t01_bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    return keyword_hits(spark, d, 3).select(F.col("query_id").alias("item_id"), "rank", "doc_id")


@query(
    LISTS_CTE
    + """, l AS (SELECT * FROM lists WHERE rank <= 12), w AS (SELECT query_id, sum(weight) AS total FROM (SELECT DISTINCT query_id, list_no, weight FROM l) GROUP BY query_id),
    fused AS (SELECT query_id, id, round(sum(weight / total / (30 + rank)), 9) AS score FROM l JOIN w USING (query_id) GROUP BY query_id, id),
    both_ AS (SELECT * FROM fused WHERE query_id IN (SELECT query_id FROM kw) UNION ALL SELECT query_id // 50, vec_id, 1 - distance FROM vec WHERE rank <= 12 AND query_id // 50 NOT IN (SELECT query_id FROM kw))
    SELECT query_id, rank, id FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM both_) WHERE rank <= 12"""
)
def t02_over_fetch(spark: SparkSession, d: str) -> DataFrame:
    v = vector_hits(spark, d).select(F.expr(NTH), "rank", F.col("vec_id").alias("id"), (1 - F.col("distance")).alias("score"))
    k = keyword_hits(spark, d).select("query_id", "rank", F.col("doc_id").alias("id"), "score")
    return search.over_fetched(v, k, 4).select("query_id", "rank", "id")


@query(f"WITH {VECTOR_CTE}, r AS (SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM dist WHERE label = 1) SELECT * FROM r WHERE rank <= 5")
def i24_one_collection(spark: SparkSession, d: str) -> DataFrame:
    return search.vector(table(spark, d, "embeddings").filter("label = 1"), vector_queries(spark, d), 5).select("query_id", "vec_id", "rank")


@query(f"WITH b AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS w FROM conversations) SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM b AS a JOIN b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def u04_shared_words(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect(text.word_set(F.col("text")), text.word_set(F.col("next")))).alias("shared"))


COPIES_SQL = (
    WITH_DOCS
    + """, u AS (SELECT query_id, doc_id, score, md5(substr(content, 1, 500)) AS ck, CASE WHEN doc_id % 3 > 0 THEN source END AS origin, row_number() OVER (PARTITION BY query_id ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, rank) AS seq FROM h WHERE lang IN ('en', 'fr')),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ck ORDER BY seq) AS n FROM u) WHERE n = 1),
    g AS (SELECT *, origin IS NULL AS loose, CASE WHEN origin IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY query_id, origin) END AS first, row_number() OVER (PARTITION BY query_id, origin, origin IS NULL ORDER BY score DESC, seq) AS m FROM o),
    placed AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY loose, first) AS INTEGER) AS place FROM g WHERE loose OR m = 1)"""
)


def domain_and_common(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).select("query_id", "doc_id", "rank", "score", "lang", scalars.content_key(F.col("content")).alias("content_key"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("origin"))
    h = files.landed(h, "keyed-hits")
    return search.without_copies(h.filter("lang = 'en'"), h.filter("lang = 'fr'"))


@query(COPIES_SQL + " SELECT query_id, doc_id, place FROM placed")
def u06_without_copies(spark: SparkSession, d: str) -> DataFrame:
    return domain_and_common(spark, d).select("query_id", "doc_id", "place")


@query(COPIES_SQL + " SELECT query_id, doc_id, place FROM placed WHERE place <= 4")
def i08_single_query(spark: SparkSession, d: str) -> DataFrame:
    return domain_and_common(spark, d).filter("place <= 4").select("query_id", "doc_id", "place")


@query(
    WITH_DOCS
    + """, g AS (SELECT query_id % 5 AS root, doc_id, round(sum(1.0 / (60 + rank - 1)), 9) AS rrf FROM h GROUP BY ALL), s AS (SELECT *, max(CASE WHEN rrf >= 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY root) AS n_some, row_number() OVER (PARTITION BY root ORDER BY rrf DESC, doc_id) AS r FROM g),
    t AS (SELECT root, doc_id, r FROM s WHERE rrf >= 0.02 OR (n_some = 0 AND r = 1))
    SELECT root, doc_id, rank FROM (SELECT root, doc_id, CAST(row_number() OVER (PARTITION BY root ORDER BY r) AS INTEGER) AS rank FROM t) WHERE rank <= 5"""
)
def i09_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item is a variant of the root item % 5; lists are fused, cut at a threshold and limited to min(k, 15)."""
    lists = keyword_hits(spark, d).select((F.col("query_id") % 5).alias("query_id"), F.col("query_id").alias("list_no"), "rank", "doc_id")
    fused = ranking.fuse(lists, "doc_id", k=60, weighted=False).withColumn("score", F.round("score", 9))
    ranked = ranking.top(fused, 1 << 30, "query_id", [F.col("score").desc(), F.col("doc_id")])
    over = ranking.above_or_first(ranked, "query_id", "score", "rank", 0.02).withColumnRenamed("rank", "old_rank")
    return ranking.top(over, min(5, 15), "query_id", [F.col("old_rank")]).select(F.col("query_id").alias("root"), "doc_id", "rank")


@query(WITH_DOCS + ", n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM h) SELECT query_id, doc_id, place FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 6 THEN 0 ELSE -overlap END, rank) AS INTEGER) AS place FROM n) WHERE place <= 6")
def i10_guarded_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Any score of (query, first 500 characters) may rerank; shared words stand in for a model."""
    return search.rerank(hits(spark, d), 6, overlap()).select("query_id", "doc_id", F.col("rank").alias("place"))


@query(WITH_DOCS + " SELECT query_id, doc_id, place FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN doc_id % 4 = 0 THEN 5.0 ELSE least(10.0, doc_id % 13 + 0.5) END DESC, rank) AS INTEGER) AS place FROM h) WHERE place <= 5")
def i12_judged_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Replies with a number from 0 to 10; one without counts 5."""
    reply = F.when(F.col("doc_id") % 4 == 0, "no idea").otherwise(F.concat(F.lit("score "), F.col("doc_id") % 13, F.lit(".5")))
    judged = hits(spark, d).withColumn("judged", text.judged_score(reply)).withColumnRenamed("rank", "old_rank")
    return ranking.top(judged, 5, "query_id", [F.col("judged").desc(), F.col("old_rank")]).select("query_id", "doc_id", F.col("rank").alias("place"))


GATE_SQL = """SELECT query_id, count(*) AS n, avg(CASE WHEN sim > 0 THEN least(1.0, sim) END) AS similarity, any_value(query) AS query, lower(string_agg(content, ' ')) AS alltext FROM (SELECT *, 1 - rank / 10.0 AS sim FROM h WHERE {where}) GROUP BY query_id"""
PASS_SQL = """SELECT query_id, n >= {docs} AND CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: contains(alltext, lower(x)))) / len(w) END >= {ratio} AND similarity >= {similarity} AS passed FROM (SELECT *, regexp_extract_all(query, '[가-힣a-zA-Z]{{2,}}') AS w FROM ({gate}))"""
STRICT_SQL = PASS_SQL.format(docs=3, ratio=0.9, similarity=0.79, gate=GATE_SQL.format(where="rank <= 3 AND (lang = 'en' OR query_id % 2 = 0)"))
LOOSE_SQL = PASS_SQL.format(docs=3, ratio=0.75, similarity=0.64, gate=GATE_SQL.format(where="rank <= 6 AND (lang = 'en' OR query_id % 2 = 0)"))
WIDE_SQL = PASS_SQL.format(docs=3, ratio=0.75, similarity=0.49, gate=GATE_SQL.format(where="rank <= 9"))


@query(
    WITH_DOCS
    + f""", every AS (SELECT *, 0 AS level FROM ({STRICT_SQL}) UNION ALL SELECT *, 1 FROM ({LOOSE_SQL}) UNION ALL SELECT *, 2 FROM ({WIDE_SQL}))
    SELECT query_id, CAST(coalesce(min(CASE WHEN passed THEN level END), max(level)) AS INTEGER) AS level, bool_or(passed) AS passed FROM every GROUP BY query_id"""
)
def i17_graduated_retry(spark: SparkSession, d: str) -> DataFrame:
    """More rows and lower floors first, then the other collections; a query that never passes keeps the last try."""
    h = files.landed(hits(spark, d), "hits").withColumn("similarity", 1 - F.col("rank") / 10.0)
    own = (F.col("lang") == "en") | (F.col("query_id") % 2 == 0)
    tries = [(own & (F.col("rank") <= 3), 0.9, 0.79), (own & (F.col("rank") <= 6), 0.75, 0.64), (F.col("rank") <= 9, 0.75, 0.49)]
    levels = [search.gate(h.filter(which), least_documents=3, least_ratio=r, least_similarity=s).select("query_id", "passed") for which, r, s in tries]
    return search.graduated(levels).select("query_id", "level", "passed")


@query(
    WITH_DOCS
    + """, own AS (SELECT item_id AS query_id, ['en', 'fr', 'de', 'es'][CAST(item_id % 4 AS INTEGER) + 1] AS lang FROM benchmark), a AS (SELECT * FROM (VALUES ('en', 'fr', 1), ('de', 'en', 1), ('de', 'fr', 2), ('fr', 'en', 1)) AS v(lang, near, turn)),
    m AS (SELECT query_id, lang, 0 AS turn, 1000000 AS most FROM own UNION ALL SELECT query_id, near, turn, 3 FROM own JOIN a USING (lang)),
    s AS (SELECT h.query_id, h.lang, doc_id, rank, row_number() OVER (PARTITION BY h.query_id, h.lang ORDER BY rank) AS n FROM h)
    SELECT s.query_id, doc_id, CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY turn, rank) AS INTEGER) AS place FROM s JOIN m ON s.query_id = m.query_id AND s.lang = m.lang WHERE n <= most"""
)
def i18_neighbouring_domains(spark: SparkSession, d: str) -> DataFrame:
    domain = F.get(text.words("en", "fr", "de", "es"), (F.col("item_id") % 4).cast("int"))
    domains = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), domain.alias("domain"))
    adjacent = spark.createDataFrame([("en", "fr", 1), ("de", "en", 1), ("de", "fr", 2), ("fr", "en", 1)], "domain string, neighbour string, turn int")
    return search.with_neighbours(hits(spark, d).withColumnRenamed("lang", "domain"), domains, adjacent, 3).select("query_id", "doc_id", "place")


@query(
    WITH_DOCS
    + """, c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM h WHERE rank <= 6 + query_id % 10), k AS (SELECT *, CAST(least(greatest(5, floor(n * 0.7)), 15) AS INTEGER) AS final_k FROM c)
    SELECT query_id, doc_id, place FROM (SELECT query_id, doc_id, final_k, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= final_k THEN 0 ELSE -overlap END, rank) AS INTEGER) AS place FROM k) WHERE place <= final_k"""
)
def i20_final_rerank(spark: SparkSession, d: str) -> DataFrame:
    some = files.landed(hits(spark, d).filter(F.col("rank") <= 6 + F.col("query_id") % 10), "hits")
    counts = some.groupBy("query_id").agg(search.final_k(F.count(F.lit(1))).alias("final_k"))
    return search.rerank(some.join(counts, "query_id"), F.col("final_k"), overlap()).select("query_id", "doc_id", F.col("rank").alias("place"))


@query(WITH_DOCS + ", a AS (SELECT query_id, any_value(query) AS query, lower(string_agg(content, ' ')) AS alltext FROM h WHERE rank <= 3 GROUP BY query_id), w AS (SELECT *, regexp_extract_all(query, '[가-힣a-zA-Z]{2,}') AS w FROM a) SELECT query_id, round(CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: contains(alltext, lower(x)))) / len(w) END, 6) AS ratio FROM w")
def i22_keyword_ratio(spark: SparkSession, d: str) -> DataFrame:
    return search.gate(hits(spark, d, 3).withColumn("similarity", F.lit(1.0))).select("query_id", F.round("ratio", 6).alias("ratio"))


@query("SELECT doc_id, lang AS title, substr(text, 1, 500) AS content, coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END, ''), 'file') AS source, CASE WHEN doc_id % 3 = 0 THEN 'https://law.go.kr/' ELSE 'u' || doc_id END AS url FROM documents")
def i23_sources(spark: SparkSession, d: str) -> DataFrame:
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    name = first(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(""), F.lit("file"))
    url = first(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("u"), "doc_id")), F.lit("https://law.go.kr/"))
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("title"), F.substring("text", 1, 500).alias("content"), name.alias("source"), url.alias("url"))
