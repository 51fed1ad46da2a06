"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector x is rotated by one random orthogonal matrix and kept as the signs
of its components, one packed bit each. With o = x/|x| and s the signs
over sqrt(D), the stored scalar c = <s, o> corrects the estimate of an inner
product with a rotated query q:

    <q, x>  is about  |x| <q, s> / c,   off by at most
    |x| |q| sqrt((1 - c^2) / c^2) * epsilon / sqrt(D - 1)

with high probability. The query's components are rounded to ``levels`` bits,
one bit plane each, so <q, s> is a few ANDs and population counts on packed
words; the rounding widens the bound. A cell's scan estimates all its vectors
from the codes, takes the k-th largest lower bound as the score to reach, and
computes true inner products only where the upper bound reaches it. Vectors
travel with their codes: among a block of queries nearly each is reranked for
some, so shipping it once costs less than the pairs would.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import binary_rows, materialise, read_table, schema_with
from granary.llm.topk import best, matrix, same_width, top, usable


@dataclass(frozen=True)
class Params:
    """``epsilon`` widens the error bound, ``levels`` are bits of a query's component; ``cell`` vectors and ``block`` queries meet in one task."""

    k: int = 20
    epsilon: float = 3.0
    levels: int = 6
    cell: int = 16384
    block: int = 8192
    seed: int = 3


def rotation(width: int, seed: int) -> np.ndarray:
    """A uniform random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, width]).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as 64-bit words, filled up with 0."""
    packed = np.packbits(bits, axis=1)
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def lengths_of(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths; neither tiny nor huge components under- or overflow on the way."""
    most = np.abs(x).max(axis=1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(axis=1))


def encoded(vectors: DataFrame, p: Params) -> DataFrame:
    """vectors (vec_id, x) with code (packed sign bits), norm and fit (the scalar c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"))
            turn = rotation(x.shape[1], p.seed) if turn is None else turn
            unit = x / np.abs(x).max(axis=1)[:, None]
            o = (unit / np.sqrt((unit * unit).sum(axis=1))[:, None]) @ turn
            fit = np.abs(o).sum(axis=1) / np.sqrt(x.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, binary_rows(words_of(o > 0)), pa.array(lengths_of(x)), pa.array(fit)], names=[*b.schema.names, "code", "norm", "fit"])

    return vectors.mapInArrow(run, schema_with(vectors, "code binary, norm double, fit double"))


def planes(turned: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounded queries: bit planes (query, plane, word), the least value and the step of each."""
    low, most = turned.min(axis=1), (1 << levels) - 1
    step = np.maximum((turned.max(axis=1) - low) / most, np.finfo(float).tiny)
    u = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    return np.stack([words_of(u >> j & 1) for j in range(levels)], axis=1), low, step


def estimates(code: np.ndarray, width: int, bits: np.ndarray, low: float, step: float) -> np.ndarray:
    """<q, s> of one rounded query with every code: s = 2b - 1 for the stored bits b."""
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    weighed, total = np.zeros(len(code), dtype=np.int64), 0
    for j, plane in enumerate(bits):
        weighed += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << j
        total += int(np.bitwise_count(plane).sum()) << j
    return 2 * (step * weighed + low * ones) - (step * total + low * width)


def true_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, each row summed in one order, so equal vectors get equal scores in every cell."""
    return (x * q).sum(axis=1)


def nearest(vectors: DataFrame, queries: DataFrame, params: Params | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` found with the largest inner products.

    ``vectors`` has vec_id and x (array<double>, no zero vector), ``queries``
    query_id and q; shorter vectors count as filled up with 0. Scores are
    those of the original vectors. Ties go to the smaller vec_id; a query
    never finds its own id. A repeated vec_id is a candidate each time; of
    queries with one id the least vector counts. Empty tables give no rows.
    """
    p, spark = params or Params(), vectors.sparkSession
    filled, asked = same_width(vectors.select("vec_id", "x"), queries.groupBy("query_id").agg(F.min("q").alias("q")))
    coded = materialise(encoded(filled, p).withColumn("n", F.monotonically_increasing_id()), "codes")
    asked = materialise(asked, "queries")
    rows, number = coded.count(), asked.count()
    if not rows or not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    cells = max(1, -(-rows // p.cell))
    blocks = max(1, -(-number // p.block))
    # every cell meets every block of the stated query set
    left = coded.withColumn("cell", F.pmod(F.xxhash64("n", F.lit(p.seed)), F.lit(cells))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("n")
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(p.seed)), F.lit(blocks)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)).cast("array<long>")))

    def scan(key: tuple, data: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if data.num_rows and wanted.num_rows:
            ids, x = data.column("vec_id").to_numpy(), matrix(data.column("x").combine_chunks())
            width = x.shape[1]
            code = np.frombuffer(b"".join(data.column("code").to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
            norm, fit = data.column("norm").to_numpy(), data.column("fit").to_numpy()
            spread = norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * p.epsilon / np.sqrt(max(width - 1, 1))
            scale = norm / fit / np.sqrt(width)
            qids, q = wanted.column("query_id").to_numpy(), matrix(wanted.column("q").combine_chunks())
            bits, low, step = planes(q @ rotation(width, p.seed), p.levels)
            lengths = (q * q).sum(axis=1) ** 0.5
            for k, own in enumerate(qids):
                e = estimates(code, width, bits[k], low[k], step[k]) * scale
                wide = spread * lengths[k] + scale * (p.epsilon * step[k] * np.sqrt(width / 12))
                least = np.where(ids == own, -np.inf, e - wide)
                reach = np.partition(least, len(least) - p.k)[len(least) - p.k] if len(least) > p.k else -np.inf
                at = np.flatnonzero(~(e + wide < reach) & (ids != own))  # what cannot be told stays
                true = true_scores(x[at], q[k])
                kept = best(true, ids[at], p.k)
                out.append((np.full(len(kept), own), ids[at][kept], true[kept]))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    found = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(scan, "query_id long, vec_id long, score double")
    return top(found, p.k)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").filter(F.exists("x", lambda v: v != 0))
    queries = rows.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    return nearest(rows, queries)
