"""Registered scorers and embedders, and questions split by a table function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.text import words
from granary.operators import decompose, scorers
from granary.plans.registry import query, table


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's first user text against all its assistant texts."""
    c = table(spark, d, "conversations")
    asked = c.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    said = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("content"), place.alias("rank"))
    return said.join(asked, "conv_id").withColumnRenamed("conv_id", "query_id")


ANSWERS_CTE = r"""WITH a AS (SELECT conv_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id),
s AS (SELECT c.conv_id AS query_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z가-힣]+')) AS t, list_distinct(regexp_extract_all(lower(query), '[0-9a-z가-힣]+')) AS q,
    row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS rank, count(*) OVER (PARTITION BY c.conv_id) AS n FROM conversations AS c JOIN a ON a.conv_id = c.conv_id WHERE role = 'assistant'),
r AS (SELECT *, CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END AS score FROM s)"""


@query(ANSWERS_CTE + " SELECT query_id, turn, round(score, 9) AS score FROM r")
def x03_registered_scorer(spark: SparkSession, d: str) -> DataFrame:
    return scorers.scored(answers(spark, d), "words").select("query_id", "turn", F.round("score", 9).alias("score"))


@query(ANSWERS_CTE + " SELECT query_id, turn, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 2 THEN 0 ELSE -score END, rank) AS place FROM r) WHERE place <= 2")
def x04_reranked_answers(spark: SparkSession, d: str) -> DataFrame:
    """A scorer by its name; conversations with two answers or fewer keep their order."""
    return scorers.reranked(answers(spark, d), "words", 2).select("query_id", "turn", F.col("rank").alias("place"))


@query()
def x01_embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of the seeded hashing embedder."""
    found = scorers.embedded(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("embedding").alias("dimensions"), F.xxhash64(F.transform("embedding", lambda x: F.round(x, 9))).alias("digest"))


@query(
    """WITH q AS (SELECT item_id, text, ['startup_funding', 'finance_tax', 'hr_labor'][:item_id % 4] AS domains FROM benchmark),
    s AS (SELECT item_id, domains[1] AS domain, 'about ' || item_id AS sub_query, 'reply' AS source FROM q WHERE len(domains) > 1 AND item_id % 7 > 0)
    SELECT * FROM s UNION ALL SELECT item_id, coalesce(domains[1], 'startup_funding'), text, 'single' FROM q WHERE len(domains) < 2
    UNION ALL SELECT item_id, domain, text, CASE WHEN item_id % 7 > 0 THEN 'completed' ELSE 'fallback' END FROM (SELECT item_id, text, unnest(domains) AS domain FROM q WHERE len(domains) > 1) WHERE item_id % 7 = 0 OR domain <> 'startup_funding'"""
)
def x09_decomposed_questions(spark: SparkSession, d: str) -> DataFrame:
    """The reply names the first domain, one that was not asked for, and nothing for the others; every seventh is no JSON."""
    domains = F.slice(words("startup_funding", "finance_tax", "hr_labor"), F.lit(1), (F.col("item_id") % 4).cast("int"))
    said = lambda domain, text: F.struct(F.lit(domain).alias("domain"), text.alias("query"))
    reply = F.to_json(F.struct(F.array(said("startup_funding", F.concat(F.lit("about "), "item_id")), said("weather", F.lit("x")), said("hr_labor", F.lit(""))).alias("sub_queries")))
    fenced = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), reply, F.lit("\n```"))).otherwise(reply)
    asked = table(spark, d, "benchmark").select("item_id", "text", domains.alias("domains"), F.when(F.col("item_id") % 7 > 0, fenced).otherwise("no idea").alias("reply"))
    name = decompose.register(spark)
    return spark.sql(f"SELECT item_id, domain, sub_query, source FROM {{asked}} AS q, LATERAL {name}(q.text, q.domains, q.reply)", asked=asked)
