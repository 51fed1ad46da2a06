"""Two-pass external shuffle into shards of equal row counts.

Pass 1 scatters every record to a memory-sized bucket by a seeded hash of its
position in the input, so a third of all rows with one id or one text spread
like any other rows. Pass 2 gives each bucket a Fisher-Yates shuffle in
memory and writes it. The buckets in order are then one shuffled sequence,
which is cut into shards whose counts differ by at most one (law ``rows``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from granary.llm.common import masked, materialise, read_table

ADDED = ("bucket", "slot_in_bucket", "shard", "slot")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: each position, from the last down, swaps with one at or below it."""
    order = np.arange(n)
    picks = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffled_buckets(df: DataFrame, *, seed: int = 17, bucket_bytes: int = 32 << 20, size: F.Column) -> DataFrame:
    """Both passes; the result is a written table with ``bucket`` and ``slot_in_bucket`` added.

    ``size`` gives a row's bytes; the number of buckets is their sum over
    ``bucket_bytes``, and at least the session's shuffle partitions, so a
    bucket fits in a task's memory at every input size.
    """
    spark = df.sparkSession
    df = df.drop(*ADDED)
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bucket_bytes), 1)
    df, names, _ = masked(df)
    scattered = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__to", F.pmod(F.xxhash64("__at", F.lit(seed)), F.lit(buckets)).cast("int"))
    schema = T.StructType(df.schema.fields + [T.StructField("bucket", T.IntegerType()), T.StructField("slot_in_bucket", T.LongType())])
    plain = df.columns

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        at = np.argsort(table.column("__at").to_numpy(), kind="stable")
        bucket = TaskContext.get().partitionId()
        order = at[fisher_yates(len(at), np.random.default_rng([seed, bucket]))]
        step = max(1, int(len(order) * (8 << 20) / max(table.nbytes, 1)))
        for i in range(0, len(order), step):
            part = table.select(plain).take(pa.array(order[i : i + step])).combine_chunks()
            n = part.num_rows
            part = part.append_column("bucket", pa.array(np.full(n, bucket, dtype=np.int32))).append_column("slot_in_bucket", pa.array(np.arange(i, i + n)))
            yield from part.to_batches()

    dealt = scattered.repartitionById(buckets, F.col("__to")).drop("__to")
    return materialise(dealt.mapInArrow(shuffle, schema), "shuffled").toDF(*names, "bucket", "slot_in_bucket")


def shard(df: DataFrame, *, shards: int = 24, seed: int = 17, bucket_bytes: int = 32 << 20, size: F.Column) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in its shard).

    Shard counts differ by at most one. Nulls, empty texts, ties and repeated
    rows are ordinary rows; columns named bucket, slot_in_bucket, shard or
    slot are replaced. An empty table gives no rows.
    """
    found = shuffled_buckets(df, seed=seed, bucket_bytes=bucket_bytes, size=size)
    rows, names, _ = masked(found)
    rows = rows.toDF(*rows.columns[:-2], "bucket", "slot_in_bucket")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__all"))
    # one row for each bucket of ``bucket_bytes``: sent to the tasks, else the rows would be shuffled once more
    placed = rows.join(F.broadcast(before), "bucket").withColumn("__pos", F.col("__before") + F.col("slot_in_bucket"))
    low, extra = F.floor(F.col("__all") / shards), F.col("__all") % shards  # the first shards hold one more row
    edge = extra * (low + 1)
    in_long = F.col("__pos") < edge
    number = F.when(in_long, F.expr("__pos div (__all div %d + 1)" % shards)).otherwise(extra + F.floor((F.col("__pos") - edge) / F.greatest(low, F.lit(1))))
    first = F.when(number <= extra, number * (low + 1)).otherwise(edge + (number - extra) * low)
    return placed.withColumn("shard", number.cast("int")).withColumn("slot", (F.col("__pos") - first).cast("long")).drop("__before", "__all", "__pos", "bucket", "slot_in_bucket").toDF(*names[:-2], "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Write a sharded table as one folder per shard, rows in slot order."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    docs = read_table(spark, sf_dir, "documents")
    return shard(docs, size=size).select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
