"""Search, fusion, selection and quality over the documents and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scalars, text
from granary.operators import ranking, search
from granary.plans.registry import query, table
from granary.plans.text_queries import TOKENS_SQL
from granary.sources import files

BM25_CTE = f"""toks AS (SELECT doc_id, {TOKENS_SQL.format(c='text')} AS t FROM documents),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS_SQL.format(c='text')}) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
raw AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS s
  FROM q JOIN p USING (term) JOIN f USING (term), size GROUP BY query_id, doc_id HAVING s > 0),
hits AS (SELECT query_id, doc_id, CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 1.0 END AS score FROM (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM raw WINDOW w AS (PARTITION BY query_id))),
kw AS (SELECT * FROM (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM hits) WHERE rank <= 15)"""

VECTOR_CTE = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
dist AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS distance FROM e AS a JOIN e AS b ON true WHERE a.vec_id % 50 = 0),
vec AS (SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM dist) WHERE rank <= 15)"""


def keyword_hits(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    return files.landed(search.bm25(table(spark, d, "documents"), table(spark, d, "benchmark"), k, query_id="item_id", query_col="text"), "keyword-hits")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def vector_hits(spark: SparkSession, d: str, k: int = 15) -> DataFrame:
    return files.landed(search.vector(table(spark, d, "embeddings"), vector_queries(spark, d), k), "vector-hits")


@query(f"WITH toks AS (SELECT doc_id, unnest({TOKENS_SQL.format(c='text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df FROM toks GROUP BY term")
def a17_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return search.document_frequency(table(spark, d, "documents"))


@query(f"WITH toks AS (SELECT doc_id, {TOKENS_SQL.format(c='text')} AS t FROM documents) SELECT doc_id, term, count(*) AS tf, CAST(len(t) AS INTEGER) AS dl FROM (SELECT doc_id, t, unnest(t) AS term FROM toks) GROUP BY doc_id, term, t")
def i01_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents"))


@query(f"WITH {BM25_CTE} SELECT query_id AS item_id, rank, doc_id, round(score, 6) AS score FROM kw WHERE rank <= 5")
def i02_bm25(spark: SparkSession, d: str) -> DataFrame:
    return keyword_hits(spark, d, 5).select(F.col("query_id").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {VECTOR_CTE} SELECT query_id, rank, vec_id, round(distance, 6) + 0.0 AS distance, round(greatest(0, least(1, 1 - distance)), 6) AS similarity FROM vec WHERE rank <= 10")
def t03_vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(spark, d, 10).select("query_id", "rank", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.round(scalars.similarity(F.col("distance")), 6).alias("similarity"))


@query(f"WITH {VECTOR_CTE} SELECT query_id, rank, vec_id, round(distance, 4) AS score FROM vec WHERE rank <= 5")
def t04_distance_as_score(spark: SparkSession, d: str) -> DataFrame:
    return vector_hits(spark, d, 5).select("query_id", "rank", "vec_id", F.round("distance", 4).alias("score"))


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
    dist AS (SELECT a.vec_id AS query_id, b.vec_id, b.label = 0 AS common, round(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) AS distance FROM e AS a JOIN e AS b ON b.label IN (0, 1) WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, common ORDER BY distance, vec_id) AS own FROM dist)
    SELECT query_id, vec_id, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM r WHERE own <= CASE WHEN common THEN 2 ELSE 4 END"""
)
def t05_two_sources(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = vector_queries(spark, d)
    both = search.vector(e.filter("label = 1"), q, 4).unionByName(search.vector(e.filter("label = 0"), q, 2)).drop("rank")
    return ranking.top(both, 1 << 30, "query_id", [F.col("distance"), F.col("vec_id")]).select("query_id", "vec_id", F.round("distance", 6).alias("distance"), "rank")


NTH = "query_id div 50 AS query_id"
LISTS_CTE = f"""WITH {BM25_CTE}, {VECTOR_CTE},
lists AS (SELECT query_id // 50 AS query_id, 0 AS list_no, rank, 0.7 AS weight, vec_id AS id FROM vec UNION ALL SELECT query_id, 1, rank, 0.3, doc_id FROM kw)"""


def two_lists(spark: SparkSession, d: str) -> DataFrame:
    """The n-th vector query stands beside the n-th benchmark item."""
    v = vector_hits(spark, d).select(F.expr(NTH), "rank", F.col("vec_id").alias("id"), F.lit(0).alias("list_no"), F.lit(0.7).alias("weight"))
    return v.unionByName(keyword_hits(spark, d).select("query_id", "rank", F.col("doc_id").alias("id"), F.lit(1).alias("list_no"), F.lit(0.3).alias("weight")))


@query(LISTS_CTE + ", w AS (SELECT query_id, sum(weight) AS total FROM (SELECT DISTINCT query_id, list_no, weight FROM lists) GROUP BY query_id) SELECT query_id, id, round(sum(weight / total / (30 + rank)), 6) AS score FROM lists JOIN w USING (query_id) GROUP BY query_id, id")
def i03_weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse(two_lists(spark, d), "id").withColumn("score", F.round("score", 6))


@query(LISTS_CTE + " SELECT query_id, id, round(sum(1.0 / (60 + rank - 1)), 6) AS score FROM lists GROUP BY query_id, id")
def i04_plain_fusion(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fuse(two_lists(spark, d), "id", k=60, weighted=False).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {BM25_CTE}, r AS (SELECT kw.query_id, rank, substr(text, 1, 500) AS head FROM kw JOIN documents USING (doc_id))
    SELECT query_id % 5 AS root, md5(head) AS content_key, round(sum(1.0 / (60 + rank - 1)), 6) AS rrf_score FROM r GROUP BY root, content_key"""
)
def i05_multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select("doc_id", scalars.content_key(F.col("text")).alias("content_key"))
    lists = keyword_hits(spark, d).join(texts, "doc_id").select((F.col("query_id") % 5).alias("query_id"), F.col("query_id").alias("list_no"), "rank", "content_key")
    return ranking.fuse(lists, "content_key", k=60, weighted=False).select(F.col("query_id").alias("root"), "content_key", F.round("score", 6).alias("rrf_score"))


@query(
    LISTS_CTE
    + """, w AS (SELECT query_id, sum(weight) AS total FROM (SELECT DISTINCT query_id, list_no, weight FROM lists) GROUP BY query_id),
    fused AS (SELECT query_id, id, round(sum(weight / total / (30 + rank)), 9) AS score FROM lists JOIN w USING (query_id) GROUP BY query_id, id),
    both_ AS (SELECT * FROM fused WHERE query_id IN (SELECT query_id FROM kw) UNION ALL SELECT query_id // 50, vec_id, 1 - distance FROM vec WHERE query_id // 50 NOT IN (SELECT query_id FROM kw))
    SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM both_) WHERE rank <= 5"""
)
def i06_hybrid(spark: SparkSession, d: str) -> DataFrame:
    v = vector_hits(spark, d).select(F.expr(NTH), "rank", F.col("vec_id").alias("id"), (1 - F.col("distance")).alias("score"))
    k = keyword_hits(spark, d).select("query_id", "rank", F.col("doc_id").alias("id"), "score")
    return search.hybrid(v, k, 5).withColumn("score", F.round("score", 6))


@query()
def i07_mmr(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = vector_hits(spark, d, 16).join(e.withColumnRenamed("embedding", "v"), "vec_id")
    return search.mmr(near.join(vector_queries(spark, d), "query_id").select("query_id", F.col("vec_id").alias("id"), "q", "v"), 4)


@query(
    f"""WITH {BM25_CTE}, b AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS qw FROM benchmark), c AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+')) AS dw FROM documents),
    s AS (SELECT kw.query_id, kw.doc_id, kw.rank AS old_rank, CAST(len(list_intersect(qw, dw)) AS INTEGER) AS overlap FROM kw JOIN b ON item_id = query_id JOIN c USING (doc_id))
    SELECT query_id, doc_id, overlap, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, old_rank) AS INTEGER) AS rank FROM s) WHERE rank <= 5"""
)
def i11_overlap_rerank(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    pairs = keyword_hits(spark, d).join(c, "doc_id").join(b, "query_id")
    return search.overlap_rerank(pairs, 5).select("query_id", "doc_id", "overlap", "rank")


MODE_WORDS = ["the", "and", "der", "les"]


@query(
    """WITH b AS (SELECT conv_id, turn, text, len(regexp_extract_all(text, '[가-힣a-zA-Z0-9]+')) AS n, len(list_filter(regexp_extract_all(text, '[가-힣a-zA-Z0-9]+'), lambda w: w IN ('the', 'and', 'der', 'les'))) AS m FROM conversations),
    c AS (SELECT conv_id, turn, length(text) <= 20 AND m / greatest(n, 1) >= 0.3 AS factual, length(text) >= 50 OR n >= 10 AS complex, length(text) >= 15 AND m / greatest(n, 1) < 0.1 AS vague FROM b)
    SELECT conv_id, turn, CASE WHEN factual THEN 'bm25_heavy' WHEN complex THEN 'vector_heavy' WHEN vague THEN 'mmr_diverse' ELSE 'hybrid' END AS mode, CAST(CASE WHEN factual THEN 3 WHEN complex THEN 7 WHEN vague THEN 7 ELSE 5 END AS INTEGER) AS k FROM c"""
)
def i14_search_mode(spark: SparkSession, d: str) -> DataFrame:
    mode, k = search.search_mode(F.col("text"), MODE_WORDS)
    return table(spark, d, "conversations").select("conv_id", "turn", mode.alias("mode"), k.alias("k"))


def domain_queries(spark: SparkSession, d: str) -> DataFrame:
    names = F.slice(text.words("tax", "labor", "startup", "law"), 1, (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), names.alias("domains"), (F.col("item_id") % 5 + 3).cast("int").alias("k"))


DOMAIN_CTE = "WITH b AS (SELECT item_id AS query_id, item_id % 4 + 1 AS n, item_id % 5 + 3 AS k, unnest(range(item_id % 4 + 1)) AS i FROM benchmark)"


@query(DOMAIN_CTE + " SELECT query_id, ['tax', 'labor', 'startup', 'law'][i + 1] AS domain, CAST(least(k, 4) AS INTEGER) AS budget, CAST(i + 1 AS INTEGER) AS priority FROM b")
def i15_bounded_budgets(spark: SparkSession, d: str) -> DataFrame:
    return ranking.bounded_budgets(domain_queries(spark, d))


@query(
    DOMAIN_CTE
    + """ SELECT query_id, ['tax', 'labor', 'startup', 'law'][i + 1] AS domain, CAST(CASE WHEN n = 1 THEN least(k, 15) WHEN n = 2 THEN CASE i WHEN 0 THEN 9 ELSE 6 END ELSE CASE i WHEN 0 THEN 8 ELSE greatest(1, 7 // (n - 1)) END END AS INTEGER) AS budget,
    CAST(i + 1 AS INTEGER) AS priority FROM b"""
)
def i16_proportional_budgets(spark: SparkSession, d: str) -> DataFrame:
    return ranking.proportional_budgets(domain_queries(spark, d))


MERGE_CTE = f"""WITH {BM25_CTE},
h AS (SELECT kw.query_id, lang AS collection, rank AS seq, md5(substr(text, 1, 500)) AS content_key, source AS origin, kw.score FROM kw JOIN documents USING (doc_id)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content_key ORDER BY seq) AS n FROM h) WHERE n = 1),
m AS (SELECT *, CASE WHEN count(*) OVER w >= 2 AND max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE score END AS s FROM u WINDOW w AS (PARTITION BY query_id, collection)),
g AS (SELECT *, min(seq) OVER (PARTITION BY query_id, collection, origin) AS first_seq FROM m),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection, origin ORDER BY s DESC, seq) AS k FROM g) WHERE k = 1),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY s DESC, first_seq) AS own FROM o),
b AS (SELECT * FROM c WHERE own <= 3)
SELECT query_id, collection, seq, round(s, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE collection WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END, collection, own) AS INTEGER) AS rank FROM b) WHERE rank <= 8"""


@query(MERGE_CTE)
def i19_merge_collections(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("collection"), scalars.content_key(F.col("text")).alias("content_key"), F.col("source").alias("origin"))
    hits = keyword_hits(spark, d).join(docs, "doc_id").withColumnRenamed("rank", "seq").drop("doc_id")
    budgets = hits.select("query_id", "collection").distinct().withColumn("budget", F.lit(3)).withColumn("priority", F.when(F.col("collection") == "en", 1).when(F.col("collection") == "fr", 2).otherwise(3))
    return ranking.merge_collections(hits, budgets, 8).select("query_id", "collection", "seq", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {BM25_CTE}, h AS (SELECT kw.query_id, b.text AS query, d.text AS content, kw.rank, 1 - kw.rank / 10.0 AS sim FROM kw JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id) WHERE rank <= 5),
    a AS (SELECT query_id, any_value(query) AS query, count(*) AS n_documents, lower(string_agg(content, ' ')) AS alltext, avg(CASE WHEN sim > 0 THEN least(1.0, sim) END) AS similarity FROM h GROUP BY query_id),
    r AS (SELECT query_id, n_documents, similarity, regexp_extract_all(query, '[가-힣a-zA-Z]{{2,}}') AS w, alltext FROM a),
    t AS (SELECT query_id, n_documents, similarity, CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: contains(alltext, lower(x)))) / len(w) END AS ratio FROM r)
    SELECT query_id, n_documents, round(ratio, 6) AS ratio, round(similarity, 6) AS similarity, concat_ws(',', CASE WHEN n_documents < 2 THEN 'documents' END, CASE WHEN ratio < 0.3 THEN 'keywords' END, CASE WHEN similarity < 0.5 THEN 'similarity' END) AS reasons, n_documents >= 2 AND ratio >= 0.3 AND similarity >= 0.5 AS passed FROM t"""
)
def i21_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    hits = keyword_hits(spark, d, 5).join(c, "doc_id").join(b, "query_id").withColumn("similarity", 1 - F.col("rank") / 10.0)
    return search.gate(hits).withColumn("ratio", F.round("ratio", 6)).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {BM25_CTE} SELECT query_id, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 100 - rank END) AS INTEGER) AS place FROM kw WHERE rank <= 7")
def w14_sandwich(spark: SparkSession, d: str) -> DataFrame:
    return ranking.sandwich(keyword_hits(spark, d, 7), "query_id", [F.col("score").desc(), F.col("doc_id")]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {BM25_CTE} SELECT query_id, string_agg('[' || rank || '] ' || source || ' ' || substr(text, 1, 4000), chr(10) || '---' || chr(10) ORDER BY CASE WHEN rank % 2 = 1 THEN rank ELSE 100 - rank END) AS context FROM kw JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id")
def c24_context(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 4000).alias("head"))
    placed = ranking.sandwich(keyword_hits(spark, d, 5), "query_id", [F.col("rank")]).join(docs, "doc_id")
    block = F.concat(F.lit("["), "rank", F.lit("] "), "source", F.lit(" "), "head")
    return placed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n---\n").alias("context"))


@query(f"WITH {VECTOR_CTE}, r AS (SELECT *, max(CASE WHEN 1 - distance >= 0.35 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n_over FROM vec WHERE vec_id <> query_id), k AS (SELECT *, min(rank) OVER (PARTITION BY query_id) AS lowest FROM r) SELECT query_id, vec_id, round(1 - distance, 6) AS similarity FROM k WHERE 1 - distance >= 0.35 OR (n_over = 0 AND rank = lowest)")
def f07_threshold_with_rescue(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_hits(spark, d).filter("vec_id <> query_id").withColumn("similarity", 1 - F.col("distance"))
    hits = ranking.top(hits.drop("rank"), 1 << 30, "query_id", [F.col("distance"), F.col("vec_id")])
    return ranking.above_or_first(hits, "query_id", "similarity", "rank", 0.35).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {BM25_CTE}, h AS (SELECT kw.*, lang = 'fr' AS hit, sum(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n FROM kw JOIN documents USING (doc_id)) SELECT query_id, doc_id, rank FROM h WHERE hit OR n < 2")
def f06_filter_with_relaxation(spark: SparkSession, d: str) -> DataFrame:
    hits = keyword_hits(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ranking.with_relaxation(hits, "query_id", F.col("lang") == "fr").select("query_id", "doc_id", "rank")


@query(
    f"""WITH {BM25_CTE}, h AS (SELECT kw.query_id, doc_id, kw.score, rank AS seq, lang FROM kw JOIN documents USING (doc_id)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS own FROM h),
    p2 AS (SELECT *, own <= 2 AS safe FROM o), q2 AS (SELECT *, CASE WHEN safe THEN row_number() OVER (PARTITION BY query_id, safe ORDER BY lang, own) ELSE row_number() OVER (PARTITION BY query_id, safe ORDER BY doc_id DESC) END AS pl FROM p2)
    SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY safe DESC, pl) AS INTEGER) AS rank FROM q2) WHERE rank <= 8"""
)
def t10_guaranteed_slots(spark: SparkSession, d: str) -> DataFrame:
    hits = keyword_hits(spark, d).drop("rank").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return ranking.guaranteed(hits, "query_id", "lang", 8, 2, [F.col("score").desc(), F.col("doc_id")], [F.col("doc_id").desc()]).select("query_id", "doc_id", "rank")


@query(f"WITH {VECTOR_CTE}, s AS (SELECT query_id, label, max(greatest(0, 1 - distance)) AS sim FROM dist WHERE vec_id <> query_id AND 1 - distance >= 0.3 GROUP BY query_id, label) SELECT CAST(q.vec_id AS BIGINT) AS query_id, l.label, round(coalesce(sim, 0.0), 6) AS similarity FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q JOIN (SELECT DISTINCT label FROM embeddings) l ON true LEFT JOIN s ON s.query_id = q.vec_id AND s.label = l.label")
def j11_lookup_max(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    best = search.nearest_of_each(e, vector_queries(spark, d), "label", 0.3)
    labels = F.broadcast(e.select("label").distinct())  # a row for each class
    wanted = vector_queries(spark, d).select("query_id").crossJoin(labels)
    # the SQL rounds the product with 10^6; F.round takes the shortest decimal, which may be a half where the product is none
    return wanted.join(best, ["query_id", "label"], "left").select("query_id", "label", (F.round(F.coalesce("similarity", F.lit(0.0)) * 1e6) / 1e6).alias("similarity"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def w04_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return ranking.first_by(table(spark, d, "documents"), [F.md5(F.col("text").cast("binary"))], [F.col("doc_id")]).select("doc_id")


@query("SELECT min(doc_id) AS doc_id, substr(md5(lower(lang || '|' || source)), 1, 12) AS key FROM documents GROUP BY lang, source")
def w06_key_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("key", scalars.short_key(F.col("lang"), F.col("source")))
    return ranking.first_by(docs, [F.col("key")], [F.col("doc_id")]).select("doc_id", "key")


@query(f"WITH {VECTOR_CTE}, h AS (SELECT d.query_id, d.vec_id, d.label = e.label AS hit, row_number() OVER (PARTITION BY d.query_id ORDER BY d.distance, d.vec_id) AS r FROM dist d JOIN e ON e.vec_id = d.query_id WHERE d.vec_id <> d.query_id) SELECT query_id, max(CASE WHEN r <= 5 AND hit THEN 1 ELSE 0 END) = 1 AS hit_at_5, round(avg(CASE WHEN r <= 10 THEN CAST(hit AS INT) END), 6) AS share_at_10 FROM h GROUP BY query_id")
def e02_search_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    own = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    hits = ranking.top(vector_hits(spark, d, 12).filter("vec_id <> query_id").drop("rank"), 10, "query_id", [F.col("distance"), F.col("vec_id")])
    hits = hits.join(e.select("vec_id", "label"), "vec_id").join(own, "query_id")
    return hits.groupBy("query_id").agg(F.bool_or((F.col("rank") <= 5) & (F.col("label") == F.col("wanted"))).alias("hit_at_5"), F.round(F.avg((F.col("label") == F.col("wanted")).cast("int")), 6).alias("share_at_10"))
