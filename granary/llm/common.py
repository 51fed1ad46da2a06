"""Helpers shared by the training-data operators.

Every intermediate table goes to the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
never takes the only copy of a stage with it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK64 = (1 << 64) - 1
#: Setting, its default, and our value: defaults of 64 MB and of 4,096 rows hold hundreds of MB where texts are long.
BATCHES = (("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "1m"), ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"))


def bound_batches(spark: SparkSession) -> None:
    """Let whole texts reach tasks in batches of about 1 MB, read 512 rows at a time, unless the session names sizes of its own."""
    for name, default, here in BATCHES:
        if spark.conf.get(name) == default:
            spark.conf.set(name, here)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of this machine only where none is named and all tasks run here too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="granary-"))
    return _own[0]


_own: list[str] = []


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; row groups of 16 MB keep writers small."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``materialise`` has written and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        for f in df.inputFiles():
            at = jvm.org.apache.hadoop.fs.Path(f)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at.getParent(), True)


def masked(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with its columns renamed c0, c1, ... so that none clashes with a name of ours; the old names; the new names of ``columns``."""
    names = df.columns
    return df.toDF(*[f"c{k}" for k in range(len(names))]), names, [f"c{names.index(c)}" for c in columns]


HOT = 1000


def join_spread(left: DataFrame, right: DataFrame, key: str, n: str, salts: int = 64) -> DataFrame:
    """Inner join on ``key``; ``right`` has each key once, with ``n``, the number of its rows in ``left``.

    Keys with over a thousandth of all rows, a thousand of them at most, are
    dealt to ``salts`` parts of the join, so none of them fills one task.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    often = [r[0] for r in right.filter(F.col(n) * HOT > total).select(key).collect()]  # HOT of them at most
    hot = F.col(key).isin(often) if often else F.lit(False)
    salt = F.when(hot, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.explode(F.sequence(F.lit(0), F.when(hot, F.lit(salts - 1)).otherwise(F.lit(0))))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", copies), [key, "__salt"]).drop("__salt")


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5, is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def schema_with(df: DataFrame, added: str) -> T.StructType:
    """The schema of ``df`` followed by the columns of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(added).fields])


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The column as strings; null becomes the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the memory that it freed handed back at its end: a worker lives on, and what it keeps adds up over stages."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed arrays of up to 32 MB
            if trim:
                trim(0)

    return all_of


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """Consecutive runs of ``values`` as one list per entry of ``lengths``."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a C-ordered matrix."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.strides[0] if len(matrix) else 1
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])
