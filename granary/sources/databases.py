"""Relational tables through JDBC, read in parallel between the bounds of a key.

Spark ships with Derby, which serves where no server is at hand: a database in
memory lives in the driver's JVM, so it is there for sessions whose tasks run in
that JVM too. Any other URL works with the driver that its database comes with.
Where executors are processes of their own, SQLite databases in a table of
images serve instead: each task fills and asks its own.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string as parsed

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
FETCH = 1000
SHARD = 10_000
KINDS = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "double": "REAL"}


def one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's JVM."""
    return spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"


def scratch_database(spark: SparkSession) -> str:
    """The URL of a new empty database in the memory of this JVM."""
    if not one_process(spark):
        raise RuntimeError("a database in memory is out of reach for executors; name the URL of a server")
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.field", "java.lang.System.err")  # else Derby writes a log file to the working folder
    return f"jdbc:derby:memory:granary{uuid.uuid4().hex};create=true"


def options_of(url: str, options: Mapping[str, str] | None) -> dict[str, str]:
    own = {"driver": DERBY} if url.startswith("jdbc:derby:") else {}
    return {"url": url, "fetchsize": str(FETCH), **own, **(options or {})}


def write_table(rows: DataFrame, url: str, name: str, *, partitions: int = 4, options: Mapping[str, str] | None = None) -> None:
    """Replace ``name`` by ``rows`` over at most ``partitions`` connections; text columns have up to 1,000 characters."""
    text = ", ".join(f"{f.name} VARCHAR(1000)" for f in rows.schema.fields if f.dataType.simpleString() == "string")
    kinds = {"createTableColumnTypes": text} if text else {}
    rows.write.format("jdbc").mode("overwrite").options(dbtable=name, numPartitions=str(partitions), **kinds, **options_of(url, options)).save()


def read_table(spark: SparkSession, url: str, name: str, *, key: str | None = None, partitions: int = 8, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table or view; with ``key``, a numeric, date or timestamp column, in partitions of equal ranges between its least and greatest value.

    Filters and columns go to the database. An empty table, or one whose keys
    are all null, is one partition. Rows whose key is null come with the first.
    """
    base = spark.read.format("jdbc").options(dbtable=name, **options_of(url, options))
    if key is None:
        return base.load()
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    low, high = spark.read.format("jdbc").options(query=f"SELECT MIN({quoted}) AS lo, MAX({quoted}) AS hi FROM {name}", **options_of(url, options)).load().first()
    if low is None:
        return base.load()
    return base.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions)).load()


def catalog(spark: SparkSession, name: str, url: str, *, options: Mapping[str, str] | None = None) -> str:
    """Make a database a catalog of the session: its tables are ``name.schema.table``, and it answers aggregates and limits over them too."""
    spark.conf.set(f"spark.sql.catalog.{name}", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    for key, value in options_of(url, options).items():
        spark.conf.set(f"spark.sql.catalog.{name}.{key}", value)
    return name


def write_shards(rows: DataFrame, path: str, name: str) -> None:
    """``rows`` as SQLite databases of about ``SHARD`` rows, which hold them as table ``name``; ``path`` becomes a table of their images.

    Whole numbers and doubles keep their kind, anything else is text. Not-a-number
    is text too, so that it is above all numbers, as in Spark.
    """
    kinds = {f.name: KINDS.get(f.dataType.typeName(), "TEXT") for f in rows.schema.fields}
    create = f"CREATE TABLE {name} ({', '.join(f'{c} {k}' for c, k in kinds.items())})"
    insert = f"INSERT INTO {name} VALUES ({', '.join('?' * len(kinds))})"

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db, n = None, 0
        image = lambda: pa.record_batch([pa.array([db.serialize()], pa.binary())], ["image"])
        for batch in batches:
            if db is None:
                db, n = sqlite3.connect(":memory:", isolation_level=None), 0
                db.execute(create)
            columns = [["NaN" if v != v else v for v in c.to_pylist()] for c in batch.columns]
            db.executemany(insert, zip(*columns, strict=True))
            n += batch.num_rows
            if n >= SHARD:
                yield image()
                db = None
        if db is not None:
            yield image()

    rows.select([F.col(c).cast("string") if k == "TEXT" else F.col(c) for c, k in kinds.items()]).mapInArrow(filled, "image binary").write.parquet(path)


def ask_shards(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """The rows with which each database answers ``sql``: an aggregate is a row a database, for Spark to put together."""
    kinds = parsed(schema)
    arrow = to_arrow_schema(kinds)
    doubles = [f.dataType.typeName() == "double" for f in kinds.fields]

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column("image"):
                db = sqlite3.connect(":memory:")
                db.deserialize(image.as_py())
                found = db.execute(sql)
                while rows := found.fetchmany(FETCH * 10):
                    columns = [[float(v) if double and v is not None else v for v in c] for c, double in zip(zip(*rows, strict=True), doubles, strict=True)]
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return spark.read.schema("image binary").parquet(path).mapInArrow(answered, schema)
