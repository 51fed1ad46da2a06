"""Keyword, vector and hybrid search over a batch of queries.

BM25: idf = ln((N - df + 0.5) / (df + 0.5) + 1) and
tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)) with k1 = 1.5, b = 0.75.
Query tokens count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from granary.functions import text
from granary.operators import nearest, ranking
from granary.sources import files

K1, B = 1.5, 0.75
CELL = 16384


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, tf, dl: one row for each distinct term of a document."""
    toks = docs.select(F.col(id_col).alias("doc_id"), text.tokens(F.col(text_col)).alias("t"))
    return toks.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc_id", "term", "tf", "dl")


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, df: distinct within each row before anything is shuffled, then one aggregation."""
    return docs.select(F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_col: str = "query", digits: int = 9, block: int = 512, cell: int = 8192) -> DataFrame:
    """query_id, rank, doc_id, score (min-max over all hits of the query, then the first k).

    The corpus is tokenised once. A task counts the terms of its documents and
    writes those that some query holds, with one row without a term for each
    document; corpus counts and scores both read them. Cells of about ``cell``
    documents meet blocks of about ``block`` queries, and of each query only its
    best k of a cell and its extremes there move on.
    """
    spark = queries.sparkSession
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(text.tokens(F.col(query_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = wanted.select("term").distinct().unionByName(spark.range(1).select(F.lit("").alias("term")))
    size, most = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    cells, blocks = -(-(size or 1) // cell), -(-(queries.count() or 1) // block)
    toks = docs.select(F.col(id_col).alias("doc_id"), text.tokens(F.col(text_col)).alias("t"))
    out = T.StructType([toks.schema["doc_id"], T.StructField("dl", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    posted = files.landed(toks.mapInArrow(nearest.counted(to_arrow_schema(out)), out).join(terms, "term", "left_semi").select(*out.names), "postings")
    if (most or 0) > 1:  # repeated rows of a document count as one in document frequencies, and their terms together
        posted = posted.groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("times"))
    else:
        posted = posted.withColumn("times", F.lit(1).cast("long"))
    counts = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("times").alias("n"), F.sum(F.col("dl") * F.col("times")).alias("dls"))
    corpus = counts.filter("term = ''").select("n", (F.col("dls") / F.col("n")).alias("avgdl"))
    known = wanted.join(counts.select("term", "df"), "term").crossJoin(F.broadcast(corpus))  # one row
    known = known.select("query_id", "term", "avgdl", (F.col("times") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * (K1 + 1)).alias("weight"))
    celled = posted.filter("term <> ''").select("doc_id", "dl", "term", "tf", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell"))
    hits = met(
        celled if blocks > 1 else celled.repartition(cells, "cell"),
        known,
        lambda schema: nearest.by_bm25(k, digits, K1, B, schema),
        T.StructType([known.schema["query_id"], out["doc_id"], *[T.StructField(c, T.LongType()) for c in ("key", "low", "high")]]),
        cells,
        blocks,
    )
    w = Window.partitionBy("query_id")
    hits = hits.withColumn("low", F.min("low").over(w)).withColumn("high", F.max("high").over(w))
    best = ranking.top(hits, k, "query_id", [F.col("key").desc(), F.col("doc_id")])
    score, low, high = ((F.col(c) / 10.0**digits) for c in ("key", "low", "high"))
    return best.select("query_id", "rank", "doc_id", F.when(high > low, (score - low) / (high - low)).otherwise(1.0).alias("score"))


def met(rows: DataFrame, queries: DataFrame, kernel: Callable[[pa.Schema], Callable[[pa.Table, pa.Table], pa.Table]], out: T.StructType, cells: int, blocks: int) -> DataFrame:
    """What ``kernel`` finds of each cell of the rows (by their column ``cell``) for each block of the queries, both as tables."""
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = queries.withColumn("cell", number(cells))
    keys = ["cell"]
    if blocks > 1:
        right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        rows, keys = rows.withColumn("block", number(blocks)).repartition(cells * blocks, "cell", "block"), ["cell", "block"]
    right = right.repartition(cells * blocks, *keys)
    return rows.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel(to_arrow_schema(out)), out)


def meet(rows: DataFrame, queries: DataFrame, on: Column, *, row_id: str, query_id: str = "query_id", block: int = 4096, cells: int = 64) -> DataFrame:
    """Each row with each query for which ``on`` holds, for any number of queries.

    Up to ``block`` queries are broadcast. More are dealt to blocks of about
    that size, and each of ``cells`` cells of the rows meets each block.
    """
    blocks = -(-queries.count() // block)
    if blocks <= 1:
        return rows.join(F.broadcast(queries), on)
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumn("__cell", dealt(row_id, cells)).withColumn("__block", number(blocks))
    right = queries.withColumn("__block", dealt(query_id, blocks)).withColumn("__cell", number(cells))
    return left.join(right, ["__cell", "__block"]).filter(on).drop("__cell", "__block")


def vector(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 9, block: int = 2048, cells: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest by cosine to each of ``queries`` (query_id, q).

    Cells of about 16,384 vectors meet blocks of about ``block`` queries as
    matrices; the first k of each cell move on. Distances that are not numbers
    come after all that are, and nulls last.
    """
    cells = cells or -(-(vectors.count() or 1) // CELL)
    blocks = -(-(queries.count() or 1) // block)
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(cells)).cast("int").alias("cell"))
    v = v if blocks > 1 else v.repartition(cells, "cell")
    out = T.StructType([queries.schema["query_id"], v.schema["vec_id"], T.StructField("odd", T.LongType()), T.StructField("key", T.LongType())])
    near = met(v, queries.select("query_id", "q"), lambda schema: nearest.by_cosine(k, digits, schema), out, cells, blocks)
    distance = F.when(F.col("odd") == 0, F.col("key") / 10.0**digits).when(F.col("odd") == 1, float("nan"))
    return ranking.top(near, k, "query_id", [F.col("odd"), F.col("key"), F.col("vec_id")]).select("query_id", "rank", "vec_id", distance.alias("distance"))


def nearest_of_each(vectors: DataFrame, queries: DataFrame, by: str, least: float, *, id_col: str = "vec_id", vec_col: str = "embedding", digits: int = 9, block: int = 2048, cells: int | None = None) -> DataFrame:
    """query_id, ``by``, similarity: the highest cosine of each of ``queries`` (query_id, q) with a vector of another id, for each value of ``by`` where it is ``least`` or more.

    Cells and blocks are those of ``vector``; a cell gives one row for each query
    and value. A value with a cosine that is not a number has that.
    """
    cells = cells or -(-(vectors.count() or 1) // CELL)
    blocks = -(-(queries.count() or 1) // block)
    v = vectors.filter(F.col(id_col).isNotNull() & F.col(by).isNotNull())
    v = v.select(F.col(id_col).alias("vec_id"), F.col(by).alias("label"), F.col(vec_col).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(cells)).cast("int").alias("cell"))
    v = v if blocks > 1 else v.repartition(cells, "cell")
    out = T.StructType([queries.schema["query_id"], v.schema["label"], T.StructField("odd", T.LongType()), T.StructField("key", T.LongType())])
    near = met(v, queries.select("query_id", "q"), lambda schema: nearest.nearest_of_each(digits, least, schema), out, cells, blocks)
    best = near.groupBy("query_id", F.col("label").alias(by)).agg(F.max("odd").alias("odd"), F.min("key").alias("key"))
    return best.select("query_id", by, F.when(F.col("odd") == 0, 1 - F.col("key") / 10.0**digits).otherwise(float("nan")).alias("similarity"))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, *, vector_weight: float = 0.7, rrf_k: int = 30, digits: int = 9) -> DataFrame:
    """Weighted fusion of (query_id, rank, id, score) lists; a query without keyword hits keeps its vector scores."""
    lists = vector_hits.withColumn("list_no", F.lit(0)).withColumn("weight", F.lit(vector_weight)).unionByName(keyword_hits.withColumn("list_no", F.lit(1)).withColumn("weight", F.lit(1 - vector_weight)))
    fused = ranking.fuse(lists, "id", k=rrf_k).withColumn("score", F.round("score", digits))
    worded = keyword_hits.select("query_id").distinct()
    both = fused.join(worded, "query_id", "left_semi").unionByName(vector_hits.join(worded, "query_id", "left_anti").select("query_id", "id", "score"))
    return ranking.top(both, k, "query_id", [F.col("score").desc(), F.col("id")]).select("query_id", "rank", "id", "score")


def mmr(candidates: DataFrame, k: int, balance: float = 0.6) -> DataFrame:
    """Maximal marginal relevance: query_id, rank, id from (query_id, id, q, v); one group is one query's fetched list."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
        v, q = unit(np.stack(pdf["v"]).astype(float)), unit(np.asarray(pdf["q"].iloc[0], dtype=float))
        relevance, chosen = v @ q, []
        nearest = np.full(len(v), -np.inf)
        while len(chosen) < min(k, len(v)):
            value = relevance if not chosen else balance * relevance - (1 - balance) * nearest
            value = np.where(np.isin(np.arange(len(v)), chosen), -np.inf, np.round(value, 12))
            chosen.append(int(value.argmax()))
            nearest = np.maximum(nearest, v @ v[chosen[-1]])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rank": range(1, len(chosen) + 1), "id": pdf["id"].iloc[chosen].to_numpy()})

    return candidates.groupBy("query_id").applyInPandas(pick, "query_id long, rank int, id long")


def overlap_rerank(pairs: DataFrame, k: int, query: str = "query", content: str = "content") -> DataFrame:
    """Rows of (query_id, id, rank, ...) by the number of words shared with the query, then by the old rank."""
    shared = F.size(F.array_intersect(text.word_set(F.col(query)), text.word_set(F.col(content))))
    scored = pairs.withColumn("overlap", shared).withColumnRenamed("rank", "old_rank")
    return ranking.top(scored, k, "query_id", [F.col("overlap").desc(), F.col("old_rank")])


def gate(hits: DataFrame, *, least_documents: int = 2, least_ratio: float = 0.3, least_similarity: float = 0.5) -> DataFrame:
    """The retrieval verdict per query from (query_id, query, content, similarity), one row per hit.

    Keyword ratio over all hits' texts (1 without keywords); mean over positive
    similarities, over all if none is positive; no similarity, no check. Means
    are those of decimals: a sum of doubles depends on the order of the rows, and
    with it whether a mean that equals the floor passes.
    """
    mean = lambda c: F.avg(c.cast("decimal(28,24)")).cast("double")  # noqa: E731  the values lie between 0 and 1
    words = text.gate_keywords(F.col("query"))
    low = F.lower(F.coalesce("content", F.lit("")))
    rows = hits.withColumn("held", F.array_distinct(F.filter(words, lambda w: F.contains(low, F.lower(w)))))
    per = rows.groupBy("query_id", "query").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"),
        mean(F.when(F.col("similarity") > 0, F.least(F.lit(1.0), "similarity"))).alias("positive"),
        mean(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity"))).alias("any"),
    )
    n = F.size(words)
    ratio = F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.filter(words, lambda w: F.array_contains("held", w))) / n)
    per = per.withColumn("ratio", ratio).withColumn("similarity", F.coalesce("positive", "any"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_documents") < least_documents, "documents"),
            F.when(F.col("ratio") < least_ratio, "keywords"),
            F.when(F.col("similarity") < least_similarity, "similarity"),
        )
    )
    return per.select("query_id", "n_documents", "ratio", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def search_mode(query: F.Column, domain_words: list[str]) -> tuple[F.Column, F.Column]:
    """(mode, k) of a query by its shape; rules are tried in order."""
    found = F.regexp_extract_all(query, F.lit("[가-힣a-zA-Z0-9]+"), F.lit(0))
    n, size = F.size(found), F.length(query)
    density = F.size(F.filter(found, lambda w: F.array_contains(text.words(*domain_words), w))) / F.greatest(n, F.lit(1))
    law = query.rlike(text.LAW_CITATION)
    factual = (size <= 20) & (density >= 0.3)
    complex_ = (size >= 50) | (n >= 10)
    vague = (size >= 15) & (density < 0.1)
    mode = F.when(law, "exact_plus_vector").when(factual, "bm25_heavy").when(complex_, "vector_heavy").when(vague, "mmr_diverse").otherwise("hybrid")
    k = F.when(law, 5).when(factual, 3).when(complex_, 7).when(vague, 7).otherwise(5)
    return mode, k




def rerank(pairs: DataFrame, k: int | Column, score: Column) -> DataFrame:
    """The k rows of (query_id, rank, ...) with the highest score, then by the old rank; a query with k rows or fewer keeps its order."""
    few = F.count(F.lit(1)).over(Window.partitionBy("query_id")) <= k
    scored = pairs.withColumn("__key", F.when(few, F.lit(0.0)).otherwise(-score.cast("double"))).withColumnRenamed("rank", "old_rank")
    return ranking.top(scored, k, "query_id", [F.col("__key"), F.col("old_rank")]).drop("__key")


def over_fetched(vector_hits: DataFrame, keyword_hits: DataFrame, k: int, times: int = 3, **how) -> DataFrame:
    """``hybrid`` over the first ``times`` k of either list, cut at as many."""
    held = F.col("rank") <= times * k
    return hybrid(vector_hits.filter(held), keyword_hits.filter(held), times * k, **how)


def without_copies(domain: DataFrame, common: DataFrame) -> DataFrame:
    """Domain hits, then common ones (query_id, rank, content_key, origin, score): equal contents once, and one row of each origin; adds ``place``."""
    both = domain.withColumn("__list", F.lit(0)).unionByName(common.withColumn("__list", F.lit(1)))
    both = both.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy("__list", "rank"))).drop("__list")
    once = ranking.first_by(both, [F.col("query_id"), F.col("content_key")], [F.col("seq")])
    return ranking.best_of_origin(once, "query_id", "origin", "score", "seq")


def with_neighbours(hits: DataFrame, domains: DataFrame, adjacent: DataFrame, k: int) -> DataFrame:
    """Hits (query_id, domain, rank) of a query's own domain, then the first ``k`` of each adjacent one; adds ``place``.

    ``domains``: query_id, domain; ``adjacent``: domain, neighbour, turn.
    """
    own = domains.select("query_id", "domain", F.lit(0).alias("turn"), F.lit(1 << 30).alias("most"))
    near = domains.join(adjacent, "domain").select("query_id", F.col("neighbour").alias("domain"), "turn", F.lit(k).alias("most"))
    w = Window.partitionBy("query_id", "domain").orderBy("rank")
    some = hits.withColumn("__n", F.row_number().over(w)).join(own.unionByName(near), ["query_id", "domain"]).filter(F.col("__n") <= F.col("most"))
    return some.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "rank"))).drop("__n", "most", "turn")


def graduated(levels: list[DataFrame]) -> DataFrame:
    """Verdicts (query_id, passed, ...) of several levels: the first that passed, else the last; adds ``level`` from 0."""
    every = levels[0].withColumn("level", F.lit(0))
    for k, df in enumerate(levels[1:], 1):
        every = every.unionByName(df.withColumn("level", F.lit(k)))
    order = [F.col("passed").desc(), F.when(F.col("passed"), F.col("level")).otherwise(-F.col("level"))]
    return ranking.first_by(every, [F.col("query_id")], order)


def final_k(candidates: Column, ratio: float = 0.7, least: int = 5, most: int = 15) -> Column:
    """How many of a query's candidates are left after the merge."""
    return F.least(F.greatest(F.lit(least), F.floor(candidates * ratio)), F.lit(most)).cast("int")
