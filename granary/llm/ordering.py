"""Exact row numbers over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialise

AT = "__at"
PART_BITS = 33  # of monotonically_increasing_id: what lies above is the partition


def numbered(df: DataFrame, order: list[Column], *, name: str, label: str) -> DataFrame:
    """``df`` with ``name``, the place of each row (from 0) in ``order``; every column of ``df`` stays.

    Rows are dealt by range and sorted in their partition, written once with
    their place there, and get the number of rows in the partitions before
    theirs added. The driver sees one count for each partition. ``df`` is read
    twice (bounds, then rows), so it should be a written table. Rows equal in
    all of ``order`` share a task: end ``order`` with a column that differs.
    An empty table stays empty.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    placed = materialise(ranged, label).withColumn("__part", F.shiftright(AT, PART_BITS))
    before, offsets = 0, []
    for part, n in sorted(placed.groupBy("__part").count().collect()):
        offsets.append((part, before))
        before += n
    starts = spark.createDataFrame(offsets, "__part long, __before long")
    within = F.col(AT).bitwiseAND((1 << PART_BITS) - 1)
    return placed.join(starts, "__part").select(*df.columns, (F.col("__before") + within).alias(name))
