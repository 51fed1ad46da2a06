"""Chunking, prefixes, index rows and state folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import chunking
from granary.plans.registry import query, table
from granary.sources import files


@query()
def h01_recursive_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", F.length("chunk").alias("length"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query()
def h02_dispatched_split(spark: SparkSession, d: str) -> DataFrame:
    """Each row goes to the splitter that its policy names, all in one pass."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n| a | b |\n| 1 | 2 |\n"), "source").alias("text"), F.get(text.words("default", "table_aware", "qa_aware"), F.col("doc_id") % 3).alias("policy"))
    return chunking.dispatched(docs, "policy").select("doc_id", "policy", "chunk_index", F.length("chunk").alias("length"))


@query()
def h03_table_aware_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit("\n| a | b |\n| 1 | 2 |\n"), "source").alias("text"))
    return chunking.chunk(docs, splitter="table_aware").select("doc_id", "chunk_index", F.length("chunk").alias("length"))


@query()
def h04_pair_preserving_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("\n질의 : "), "lang", F.lit("\n회시 : "), "text").alias("text"))
    return chunking.chunk(docs, splitter="qa_aware").select("doc_id", "chunk_index", F.length("chunk").alias("length"))


@query()
def h05_parents_and_children(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = chunking.parents_and_children(docs, prefix=F.concat(F.lit("["), "source", F.lit(" > "), "lang", F.lit("]")))
    return found.select("id", "chunk_type", "parent_id", "child_index", F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(
    """SELECT doc_id, 'core' AS part, md5(substr(text, 1, 300)) AS body_md5 FROM documents UNION ALL SELECT doc_id, 'reason', md5(substr(text, 1, 150) || chr(10) || substr(text, 301)) FROM documents WHERE length(text) > 600"""
)
def h06_two_part_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    core = docs.select("doc_id", F.lit("core").alias("part"), F.md5(F.substring("text", 1, 300).cast("binary")).alias("body_md5"))
    reason = docs.filter(F.length("text") > 600).select("doc_id", F.lit("reason"), F.md5(F.concat_ws("\n", F.substring("text", 1, 150), F.substring("text", 301, 1 << 30)).cast("binary")))
    return core.union(reason)


@query(
    "WITH t AS (SELECT doc_id, source, split_part(text, ' ', 1) || ' ' || substr(text, 1, 60) AS title FROM documents) SELECT doc_id, '[' || CASE WHEN source <> '' THEN source || ' > ' ELSE '' END || CASE WHEN length(title) > 50 THEN substr(title, 1, 50) || '…' ELSE title END || ']' AS prefix FROM t WHERE title IS NOT NULL"
)
def c17_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Long titles end in an ellipsis; a missing source leaves its title alone."""
    title = F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "), F.substring("text", 1, 60))
    return table(spark, d, "documents").filter(title.isNotNull()).select("doc_id", text.bracketed(F.col("source"), title).alias("prefix"))


#: Whether a source's texts are cut, by which splitter, into how many characters with how many of them twice.
POLICIES = {"src1": ("always", "default", 1500, 150), "src2": ("optional", "table_aware", 800, 80), "src3": ("always", "qa_aware", 600, 60), "src4": ("optional", "unknown", 1000, 0)}


def records(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a table and a question behind their text, as JSON lines of a folder for each source, read back."""
    path = files.scratch(spark, "records")
    content = F.concat("text", F.lit("\n| a | b |\n| 1 | 2 |\n질의 : "), F.coalesce("lang", F.lit("")), F.lit("\n회시 : "), F.substring("text", 1, 900))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), content.alias("content"), F.coalesce("source", F.lit("none")).alias("source_file"))
    files.write_json_lines(docs, path, by="source_file")
    return files.json_lines(spark, path, "id long, title string, content string, source_file string")


@query()
def s02_chunking_scan(spark: SparkSession, d: str) -> DataFrame:
    """Stand-alone records, parents and children of all sources, each by its policy, in one pass over the files."""
    by = F.create_map(*[x for name, p in POLICIES.items() for x in (F.lit(name), F.struct(*[F.lit(v).alias(k) for k, v in zip(("policy", "splitter", "size", "overlap"), p, strict=True)]))])
    rows = records(spark, d).withColumn("p", F.try_element_at(by, F.col("source_file")))
    size, overlap = F.coalesce("p.size", F.lit(1500)), F.coalesce("p.overlap", F.lit(150))
    found = chunking.index_rows(rows, id_col="id", text_col="content", prefix=text.bracketed(F.col("source_file"), F.col("title")), policy=F.coalesce("p.policy", F.lit("never")), splitter=F.col("p.splitter"), size=size, overlap=overlap, keep=["source_file"])
    return found.select("id", "source_file", "chunk_type", "parent_id", "chunk_index", "child_index", F.length("body").alias("length"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS meta_k, 'x' AS kind FROM events")
def f02_promoted_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = F.map_concat(F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, _: F.concat(F.lit("meta_"), k)), F.create_map(F.lit("kind"), F.lit("x")))
    return table(spark, d, "events").select("event_id", meta.alias("m")).select("event_id", F.try_element_at("m", F.lit("meta_k")).alias("meta_k"), F.try_element_at("m", F.lit("kind")).alias("kind"))


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'lang' ELSE '' END AS kept FROM documents")
def f03_metadata_whitelist(spark: SparkSession, d: str) -> DataFrame:
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    allowed = F.when(F.col("source").isin("src1", "src2"), text.words("lang")).otherwise(F.array().cast("array<string>"))
    kept = F.map_filter(meta, lambda k, _: F.array_contains(allowed, k))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.map_keys(kept), ",").alias("kept"))
