"""File sources and sinks of the document pipeline."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import stripped
from granary.sources import schemas


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; one of this machine's only where all tasks run here too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.gettempdir()
    return f"{found}/{label}-{uuid.uuid4().hex}"


def landed(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what is read more than once is worked out once."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank and malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, the malformed lines as ``line``)."""
    fields = T.StructType.fromDDL(schema).fields
    wide = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return rows.filter(~bad).select(*[F.col(f"r.{f.name}") for f in fields]), rows.filter(bad).select(F.col("value").alias("line"))


def folders(spark: SparkSession, base: str, by: str, schema: str) -> DataFrame:
    """All folders ``by=value`` below ``base`` in one scan, the value as ``collection`` (null for the rows without one), with ``source_file``.

    A filter on ``collection`` prunes folders.
    """
    rows = json_lines(spark, base, f"{schema}, {by} string").select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"))
    return rows.withColumnRenamed(by, "collection")


def collections(spark: SparkSession, paths: dict[str, Sequence[str]], schema: str, only: Sequence[str] | None = None) -> DataFrame:
    """The files of several collections with ``collection`` and ``source_file``; ``only`` names the files to keep."""
    parts = []
    for name, files in paths.items():
        wanted = [f for f in files if only is None or f.rsplit("/", 1)[-1] in only]
        if wanted:
            parts.append(json_lines(spark, list(wanted), schema).select("*", F.lit(name).alias("collection"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file")))
    if not parts:
        raise ValueError("no file of a known collection is left")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enveloped(spark: SparkSession, glob: str, item: str) -> DataFrame:
    """Documents of the form {total_count, data: [...]}: one row for each entry of data."""
    schema = T.StructType([T.StructField("total_count", T.LongType()), T.StructField("data", T.ArrayType(T.StructType.fromDDL(item)))])
    return spark.read.schema(schema).option("multiLine", True).json(glob).select(F.explode("data").alias("d")).select("d.*")


def law_articles(spark: SparkSession, path: str) -> DataFrame:
    """law_id, law_name, article_number, article_title, content: clauses and items folded into the article's text."""
    laws = spark.read.schema(schemas.LAWS).option("multiLine", True).json(path).select(F.explode("laws").alias("l"))
    a = laws.select("l.law_id", F.col("l.name").alias("law_name"), F.explode("l.articles").alias("a"))
    clause = lambda c: F.concat_ws("\n", c["content"], F.array_join(F.transform(F.coalesce(c["items"], F.array()), lambda i: i["content"]), "\n"))
    body = F.concat_ws("\n", F.col("a.content"), F.array_join(F.transform(F.coalesce(F.col("a.clauses"), F.array()), clause), "\n"))
    gone = F.contains(body, F.lit("삭제")) & (F.length(body) < 30)
    return a.select("law_id", "law_name", F.col("a.number").alias("article_number"), F.col("a.title").alias("article_title"), body.alias("content")).filter(~gone)


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([x.decode(e) for x, e in zip(content, encoding, strict=True)])


def legacy_csv(spark: SparkSession, path: str, encoding: str = "EUC-KR", keep: Column | None = None) -> DataFrame:
    """CSV with a heading, in any character set.

    Spark's own reader knows a short list of sets unless a setting of the whole
    session widens it, so files come as bytes, one a row, and are decoded
    first; such exports are small.
    """
    lines = spark.read.format("binaryFile").load(path).select("path", F.posexplode(F.split(decoded("content", F.lit(encoding)), r"\r?\n", -1)).alias("n", "line"))
    names = lines.filter("n = 0").orderBy("path").first()["line"].split(",")
    fields = ", ".join(f"`{n.strip()}` string" for n in names)
    rows = lines.filter("n > 0 AND line <> ''").select(F.from_csv("line", fields).alias("r")).select("r.*")
    return rows if keep is None else rows.filter(keep)


def xml_items(spark: SparkSession, path: str) -> DataFrame:
    """<item><col name=n>v</col></item> as one map column ``cols`` of trimmed values."""
    schema = "col array<struct<_VALUE:string,_name:string>>"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return rows.select(F.map_from_entries(F.transform("col", lambda c: F.struct(c["_name"], stripped(F.coalesce(c["_VALUE"], F.lit("")))))).alias("cols"))


def sections(spark: SparkSession, path: str, heading: str) -> DataFrame:
    """Sections of a Markdown file: ``heading`` (a pattern that starts a line), one row each with its text."""
    whole = spark.read.text(path, wholetext=True)
    parts = F.filter(F.split(F.col("value"), f"(?m)(?=^{heading})"), lambda x: x.rlike(f"(?m)^{heading}"))
    return whole.select(F.posexplode(parts).alias("seq", "section"))


def labelled_fields(parts: DataFrame, patterns: dict[str, Sequence[str]], required: Sequence[str] = ()) -> DataFrame:
    """Each field as the first of its patterns that matches (group 1, trimmed); rows without a required field go."""
    out = parts
    for name, tries in patterns.items():
        out = out.withColumn(name, F.coalesce(*[F.nullif(stripped(F.regexp_extract("section", p, 1)), F.lit("")) for p in tries]))
    for name in required:
        out = out.filter(F.col(name).isNotNull())
    return out


def log_page(spark: SparkSession, path: str, page: int, size: int, most: int = 10_000) -> DataFrame:
    """A page of the last ``most`` lines, newest first; of several files the one with the greatest name is the newest.

    Each task keeps its own last lines, so no more than ``most`` of a task move.
    """
    place = ["_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id()]
    rows = spark.read.text(path).select(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in zip(("file", "start", "n"), place, strict=True)]).alias("at"), F.col("value").alias("line"))
    return rows.orderBy(F.col("at").desc()).limit(most).orderBy(F.col("at").desc()).offset((page - 1) * size).limit(size).select("line")


def binary_files(spark: SparkSession, glob: str) -> DataFrame:
    """path, suffix, content: the input of an extractor function."""
    rows = spark.read.format("binaryFile").load(glob)
    return rows.select("path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("suffix"), "content")


def write_json_lines(df: DataFrame, path: str, *, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy(by) if by else w).json(path)


def write_collection(df: DataFrame, path: str, collection: str = "collection") -> None:
    """Overwrite just the partitions of the collections that occur."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(collection).parquet(path)


def rewrite_if_changed(before: DataFrame, after: DataFrame, key: str, path: str) -> int:
    """Write ``after`` to a new path if a row differs; gives the number of changed rows."""
    changed = before.select(key, F.xxhash64(*[c for c in before.columns]).alias("a")).join(after.select(key, F.xxhash64(*[c for c in before.columns]).alias("b")), key, "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).count()
    if changed:
        after.write.mode("errorifexists").parquet(path)
    return changed


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of the driver's, through Hadoop's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def write_report(df: DataFrame, path: str) -> None:
    """A report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown_report(df: DataFrame, most: int = 1000) -> str:
    """A report of ``most`` rows at the most as a Markdown table, ordered by its first column; more rows are an error."""
    rows = df.orderBy(df.columns[0]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
