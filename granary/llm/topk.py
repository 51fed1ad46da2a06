"""Exact top-k inner products over a pivot-distance index.

Largest inner product becomes nearest neighbour by one more component: a
vector x gets sqrt(M - |x|^2) with M the largest squared norm, a query gets 0,
and then |q - x|^2 = |q|^2 + M - 2 <q, x>.

The index keys each vector by its nearest pivot and its distance to it. Each
pivot's distances are cut into rings at their quantiles, so every annulus
holds about equally many rows and its inner and outer radius bound what it
can hold: by the triangle inequality no member is nearer to q than d(q, pivot)
lies outside of the ring. A first pass searches each query's home annulus and
the rings next to it, which yields a score that the k best must reach. The
second expands to all annuli whose bound still reaches it, and stops at the
others. Bounds are widened by a rounding margin, scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import materialise, mix64, read_table, schema_with


@dataclass(frozen=True)
class Params:
    """``sample`` bounds the rows from which pivots are chosen; ``pivots`` times ``rings`` bounds the annuli.

    An annulus larger than ``cell`` rows is dealt to several cells by a hash
    of the row, and queries come in blocks of ``block``, so a task holds one
    cell of vectors and one block of queries.
    """

    k: int = 5
    pivots: int = 12
    rings: int = 8
    sample: int = 4096
    cell: int = 8192
    block: int = 4096
    seed: int = 5


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): rows with an id and a non-empty vector of non-null, finite components."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad)


def same_width(vectors: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with their vectors (x, q) filled up with 0 to the greatest width among them."""
    wide = [df.agg(F.min(F.size(c)), F.max(F.size(c))).first() for df, c in ((vectors, "x"), (queries, "q"))]
    seen = [w for row in wide for w in row if w is not None]
    if len(set(seen)) <= 1:
        return vectors, queries
    fill = lambda c, kind: F.concat(c, F.array_repeat(F.lit(0).cast(kind.elementType), F.lit(max(seen)) - F.size(c)))
    return vectors.withColumn("x", fill("x", vectors.schema["x"].dataType)), queries.withColumn("q", fill("q", queries.schema["q"].dataType))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of equal width."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def pivots_of(sample: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each row to each pivot."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * x @ pivots.T, 0))


def lifted(ints: np.ndarray, most: float) -> np.ndarray:
    x = ints.astype(float)
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))]


def keyed(vectors: DataFrame, pivots: np.ndarray, most: float) -> DataFrame:
    """vectors with pivot (nearest) and distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = to_pivots(lifted(matrix(b.column("x")), most), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=[*b.schema.names, "pivot", "distance"])

    return vectors.mapInArrow(run, schema_with(vectors, "pivot int, distance double"))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these hold them, else in 64-bit integers."""
    if left.size and right.size and left.shape[1] * float(np.abs(left).max()) * float(np.abs(right).max()) < 2.0**53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    return left @ right.T


def searched(cells: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The best k of each cell for each query asked of it: query_id, vec_id, score.

    ``cells`` has cell, vec_id, x; ``asked`` has cell, block, query_id, q and
    ``least``, the score below which a candidate cannot matter (null: none).
    """
    blocks = asked.select(F.col("cell").alias("of_cell"), F.col("block").alias("of_block")).distinct()
    copies = cells.join(blocks, F.col("cell") == F.col("of_cell")).select("of_cell", "of_block", "vec_id", "x")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids, x = left.column("vec_id").to_numpy(), matrix(left.column("x").combine_chunks())
        qids, q = right.column("query_id").to_numpy(), matrix(right.column("q").combine_chunks())
        least = right.column("least").fill_null(-(1 << 62)).to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, len(q), 512):
            scores = products(q[i : i + 512], x)
            for row, s in enumerate(scores):
                at = np.flatnonzero((s >= least[i + row]) & (ids != qids[i + row]))
                at = at[best(s[at], ids[at], k)]
                out.append((np.full(len(at), qids[i + row]), ids[at], s[at]))
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return copies.groupBy("of_cell", "of_block").cogroup(asked.groupBy("cell", "block")).applyInArrow(run, "query_id long, vec_id long, score long")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, queries: DataFrame, params: Params | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest integer inner products among all other rows.

    ``vectors`` has vec_id (long) and x (array<long>), ``queries`` query_id
    and q; shorter vectors count as filled up with 0. Ties go to the smaller
    vec_id. A repeated vec_id is a candidate of its own each time and never of
    a query with that id; of queries with one id the least vector counts.
    Empty tables give no rows.
    """
    p = params or Params()
    vectors, queries = same_width(vectors.select("vec_id", "x"), queries.groupBy("query_id").agg(F.min("q").alias("q")))
    vectors = materialise(vectors, "vectors")
    most, rows = vectors.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)), F.count(F.lit(1))).first()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    picked = vectors.orderBy(F.xxhash64("vec_id", F.lit(p.seed))).limit(p.sample).toArrow()
    pivots = pivots_of(lifted(matrix(picked.column("x").combine_chunks()), most), p.pivots, p.seed)

    index = materialise(keyed(vectors, pivots, most).withColumn("n", F.monotonically_increasing_id()), "keyed")
    cuts = F.array(*[F.lit(i / p.rings) for i in range(1, p.rings)])
    edges = index.groupBy("pivot").agg(F.percentile_approx("distance", cuts, F.lit(1000)).alias("edges"))
    ringed = index.join(F.broadcast(edges), "pivot").withColumn("ring", F.size(F.filter("edges", lambda e: e < F.col("distance"))))
    annuli = ringed.groupBy("pivot", "ring").agg(F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.count(F.lit(1)).alias("n"))
    annuli = annuli.withColumn("parts", F.ceil(F.col("n") / p.cell).cast("int"))
    held = annuli.toArrow().to_pydict()  # at most pivots times rings rows
    inner, outer, parts = np.array(held["inner"]), np.array(held["outer"]), np.array(held["parts"])
    of_pivot, ring = np.array(held["pivot"]), np.array(held["ring"])
    number = {(a, b): i for i, (a, b) in enumerate(zip(held["pivot"], held["ring"], strict=True))}
    labels = vectors.sparkSession.createDataFrame([(a, b, i, int(parts[i])) for (a, b), i in number.items()], "pivot int, ring int, annulus int, parts int")
    part_of = F.pmod(F.xxhash64("n", F.lit(p.seed)), F.col("parts"))
    cells = materialise(ringed.join(F.broadcast(labels), ["pivot", "ring"]).select((F.col("annulus") * (1 << 20) + part_of).alias("cell"), "vec_id", "x"), "cells")

    # widest rounding error of a bound, in units of the score
    slack = 1e-9 * (most + 1) * 4 + 0.5

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells to search for each query: home annuli without a least score, else all others that can reach it."""
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("q"))
            least, qids = b.column("least").to_pylist(), b.column("query_id").to_pylist()
            d = to_pivots(np.c_[q.astype(float), np.zeros(len(q))], pivots)
            norms = (q.astype(float) ** 2).sum(axis=1)
            out: list[tuple[int, int]] = []
            for row in range(len(q)):
                gap = np.maximum(np.maximum(d[row, of_pivot] - outer, inner - d[row, of_pivot]), 0)
                if b.column("round")[row].as_py() == 0:
                    chosen = np.argsort(gap, kind="stable")[:2]
                else:
                    reach = (norms[row] + most - gap**2) / 2 + slack
                    chosen = np.flatnonzero(reach >= (-np.inf if least[row] is None else least[row]))
                out += [(row, int(a) << 20 | i) for a in chosen for i in range(parts[a])]
            if not out:
                continue
            at, cell = map(np.array, zip(*out, strict=True))
            block = (mix64(np.array(qids)[at].view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            t = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(block), t.column("query_id"), t.column("q"), t.column("least")], names=["cell", "block", "query_id", "q", "least"])

    queries = materialise(queries, "queries")
    blocks = max(1, -(-queries.count() // p.block))
    schema = "cell long, block long, query_id long, q array<long>, least long"
    first = queries.select("query_id", "q", F.lit(None).cast("long").alias("least"), F.lit(0).alias("round")).mapInArrow(ask, schema)
    near = top(searched(cells, first, p.k), p.k)
    floor = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == p.k, F.min("score")).alias("least"))
    second = queries.join(floor, "query_id", "left").select("query_id", "q", "least", F.lit(1).alias("round")).mapInArrow(ask, schema)
    return top(searched(cells, second, p.k), p.k)


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    vectors = rows.select("vec_id", F.transform("x", lambda v: F.floor(v * 256)).alias("x"))
    queries = vectors.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    return exact_top_k(vectors, queries)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, v.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
