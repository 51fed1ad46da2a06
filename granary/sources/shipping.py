"""Rotated logs to a store: each file once, then out of the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROTATED = "*.log.*"
SCHEMA = "value string"


def keyed(rows: DataFrame) -> DataFrame:
    """service, day and file_name of each row's file; the service is the name before ``.log``, the day that of its last change."""
    name = F.col("_metadata.file_name")
    return rows.withColumns({"service": F.split_part(name, F.lit(".log"), F.lit(1)), "day": F.date_format("_metadata.file_modification_time", "yyyy-MM-dd"), "file_name": name})


def planned(spark: SparkSession, folder: str, *, service: str | None = None) -> DataFrame:
    """What a run would ship: key and bytes of each rotated log. Contents are not read."""
    found = keyed(spark.read.format("binaryFile").option("pathGlobFilter", ROTATED).load(folder).select("length", "_metadata"))
    wanted = found if service is None else found.filter(F.col("service") == service)
    return wanted.select(F.concat_ws("/", "service", "day", "file_name").alias("key"), F.col("length").alias("bytes"))


def ship(spark: SparkSession, folder: str, target: str, checkpoint: str, *, service: str | None = None, archive: str | None = None, delete: bool = False) -> StreamingQuery:
    """Append the lines of rotated logs that were not shipped before, by service and day, and stop.

    With ``archive``, or ``delete``, a file leaves its folder once a later run
    has seen that its batch is committed, so a failed run loses nothing.
    """
    clean = {"cleanSource": "archive", "sourceArchiveDir": archive} if archive else {"cleanSource": "delete"} if delete else {}
    glob = f"{service}.log.*" if service else ROTATED
    lines = spark.readStream.format("text").schema(SCHEMA).options(pathGlobFilter=glob, **clean).load(folder)
    rows = keyed(lines.select("value", "_metadata")).select("value", "service", "day", "file_name")
    return rows.writeStream.format("parquet").partitionBy("service", "day").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
