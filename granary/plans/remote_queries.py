"""Paged services and relational databases; each query publishes rows of a given table and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.registry import query, table
from granary.sources import databases, files, paged

SIZE = 50


def published(spark: SparkSession, docs: DataFrame, path: str) -> str:
    """Documents as the pages of a service, every second one XML; the pattern of their addresses."""
    number = (F.col("doc_id") / SIZE).cast("int") + 1
    rows = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 11 > 0, F.col("doc_id").cast("string")).otherwise("").alias("pbanc_sn"),
        F.when(F.col("doc_id") % 3 > 0, "Y").otherwise("N").alias("rcrt_prgs_yn"),
        F.coalesce("source", F.lit("<none> & co")).alias("source"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
        number.alias("page"),
        (number % 2 == 0).alias("xml"),
    )
    paged.write_pages(rows, path, order="doc_id", page="page", size=SIZE, xml="xml")
    return path + "/page={page}"


@query(
    "SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '<none> & co') AS source, md5(text) AS text_md5 FROM documents WHERE doc_id // 50 + 1 < (SELECT max(doc_id // 50) FROM documents) AND doc_id % 3 > 0 AND doc_id % 11 > 0"
)
def s10_paged_source(spark: SparkSession, d: str) -> DataFrame:
    """The last page but one is broken: what stands before it is kept."""
    path = files.scratch(spark, "service")
    docs = table(spark, d, "documents")
    url = published(spark, docs, path)
    pages = docs.agg((F.max("doc_id") / SIZE).cast("int")).first()[0] + 1
    spark.createDataFrame([("{broken",)], "value string").write.mode("overwrite").text(f"{path}/page={pages - 1}")
    items = paged.complete(paged.land(spark, url, files.scratch(spark, "landed"), size=SIZE, pages=pages), SIZE)
    found = paged.announcements(items, id_key="pbanc_sn", open_key="rcrt_prgs_yn")
    return found.select("id", *[F.element_at("item", F.lit(c)).alias(c) for c in ("source", "text_md5")])


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def s11_resumed_source(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the items are there at first, the last page of them short; a second run goes on from the checkpoint."""
    paged.register(spark)
    path, target, progress = (files.scratch(spark, x) for x in ("service", "collected", "progress"))
    docs = table(spark, d, "documents")
    most = docs.agg(F.max("doc_id")).first()[0]
    for known in (docs.filter(F.col("doc_id") <= 2 * most / 3), docs):
        url = published(spark, known, path)
        stream = spark.readStream.format(paged.FORMAT).options(url=url, size=SIZE).load()
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    item = lambda k: F.element_at("item", F.lit(k))
    return spark.read.schema(paged.SCHEMA).parquet(target).select(item("doc_id").cast("long").alias("doc_id"), item("text_md5").alias("text_md5"))


@query(
    "SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
)
def s18_relational_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders through JDBC, in partitions between the bounds that the table itself has; out of databases of the tasks where the driver's is out of reach."""
    orders = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "day")
    if not databases.one_process(spark):
        path = files.scratch(spark, "orders")
        databases.write_shards(orders, path, "orders")
        asked = "SELECT o_orderkey, o_custkey, o_totalprice, day FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
        return databases.ask_shards(spark, path, asked, "o_orderkey long, o_custkey long, o_totalprice double, day string").withColumn("day", F.to_date("day"))
    url = databases.scratch_database(spark)
    databases.write_table(orders, url, "orders")
    rows = databases.read_table(spark, url, "orders", key="o_orderkey", partitions=4)
    return rows.filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice", "day")


@query("SELECT count(*) AS n, max(o_orderkey) AS newest FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' AND o_orderpriority = '1-URGENT'")
def s18_pushed_query(spark: SparkSession, d: str) -> DataFrame:
    """A filter and aggregates that the database answers itself; where each task has one, Spark adds their answers up."""
    orders = table(spark, d, "orders").select("o_orderkey", F.to_timestamp("o_orderdate").alias("at"), "o_orderpriority")
    if not databases.one_process(spark):
        path = files.scratch(spark, "orders")
        databases.write_shards(orders, path, "orders")
        asked = "SELECT count(*) AS n, max(o_orderkey) AS newest FROM orders WHERE at > '1996-06-01 00:00:00' AND o_orderpriority = '1-URGENT'"
        return databases.ask_shards(spark, path, asked, "n long, newest long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("newest").alias("newest"))
    url = databases.scratch_database(spark)
    databases.write_table(orders, url, "orders")
    rows = spark.table(databases.catalog(spark, url.split(":")[3].split(";")[0], url) + ".APP.ORDERS")
    return rows.filter("at > timestamp'1996-06-01' AND o_orderpriority = '1-URGENT'").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("newest"))
