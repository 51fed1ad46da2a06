"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes a set of hashed word shingles; equal sets become one
   node before anything is compared, so exact copies never meet in pairs.
2. Nodes share a bucket if one of the signature's bands agrees. In the
   buckets of the first ``lead`` bands each member is paired with the smallest
   node; then, in the buckets of all bands, the smallest node of each component
   with that of the component with most members there.
3. A candidate pair is compared one signature batch after another. After n
   compared positions with m agreements the posterior of the similarity (flat
   prior) is Beta(m + 1, n - m + 1); the pair is dropped as soon as the
   probability of reaching the threshold falls under ``miss``.
4. Survivors are verified exactly on their full shingle sets.
5. The links join nodes into components. Buckets, of all bands, whose members
   are then in different components become cells of bounded size, which hold the sets of
   their members: candidates across components are pruned as in 3, verified
   on the spot, the likeliest first, and only links that join two components
   leave the cell. So a group of near copies costs its members, not its
   pairs, in rows; pairs are compared only where nothing has joined them yet,
   and each in the first bucket that it shares.

With 44 bands of 6 a pair at similarity 0.8 shares no band with probability
1.5e-6; its eight tests at ``miss`` add at most 8e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.blocks import Bloom, cells, links_across
from granary.llm.common import binary_rows, discard, join_spread, masked, materialise, mix64, read_table, released, texts_of
from granary.llm.components import components


@dataclass(frozen=True)
class Plan:
    """Shingle width, threshold in percent, bands, rows a band; signature positions compared, by batch; miss probability.

    ``cell`` bounds the shingles (with 256 more a member) of the part of a bucket that one task compares with another part.
    ``lead`` bands are searched before the rest, so that most near copies are joined before all bands are.
    A node and those that it is compared with are verified in parts of about ``star`` members, at most ``most_parts`` of them.
    """

    words: int = 5
    percent: int = 80
    bands: int = 44
    rows: int = 6
    batch: int = 33
    compared: int = 264
    cell: int = 1 << 21
    lead: int = 4
    star: int = 1024
    most_parts: int = 4096
    miss: float = 1e-6
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; A-Z are lower-cased, ASCII white space parts words.

    A text with fewer than ``width`` words is one shingle, one without words none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width_now = min(width, len(ids))
    mixed = np.full(len(ids) - width_now + 1, width_now, dtype=np.uint64)
    for j in range(width_now):
        mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - width_now + 1 + j])
    return np.unique(mixed)


def signer(plan: Plan):
    rng = np.random.default_rng(plan.seed)
    a = (rng.integers(0, 1 << 63, plan.hashes, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
    b = rng.integers(0, 1 << 63, plan.hashes, dtype=np.uint64)[:, None]

    def sign(values: np.ndarray) -> np.ndarray:
        """The least upper 32 bits of each of the hash functions over the set, cut to their low 16 bits."""
        least = np.full(plan.hashes, 0xFFFFFFFF, dtype=np.uint64)
        for i in range(0, len(values), 2048):
            np.minimum(least, ((values[None, i : i + 2048] * a + b) >> np.uint64(32)).min(axis=1), out=least)
        return least.astype(np.uint16)

    return sign


def least_matches(plan: Plan) -> list[int]:
    """For each batch end n: the fewest agreements at which the threshold is still likely enough.

    P(similarity >= t | m of n) under a flat prior is P(Binomial(n + 1, t) <= m).
    """
    t, found = plan.percent / 100, []
    for n in range(plan.batch, plan.compared + 1, plan.batch):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= plan.miss:
                break
            m += 1
        found.append(m)
    return found


def shingled(docs: DataFrame, plan: Plan, id_col: str, text_col: str, passed: list[str]) -> DataFrame:
    """``passed`` columns with __row (unique), __id, __text, n_shingles, digest (of the set) and sig."""
    source = docs.select(*[F.col(c) for c in passed], F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    added = [T.StructField("__row", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType())]
    schema = T.StructType([*source.schema.fields, *added])
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, row = signer(plan), TaskContext.get().partitionId() << 33
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                sets = [shingles(t, plan.words) for t in texts_of(batch, "__text")]
                n = len(sets)
                columns = [
                    *[batch.column(c) for c in names],
                    pa.array(np.arange(row, row + n)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    binary_rows(np.stack([sign(s) for s in sets])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
                row += n

    return source.mapInArrow(released(run), schema)


def _prune(left: np.ndarray, right: np.ndarray, plan: Plan, bounds: list[int]) -> np.ndarray:
    """Positions of the signature pairs that stay likely through every batch."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
    for k, need in enumerate(bounds):
        part = slice(k * plan.batch, (k + 1) * plan.batch)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= need]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _likely(pairs: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) whose signatures leave the threshold likely enough, with ``part``: the share of u's star that v belongs to."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    hubs = materialise(sizes.join(nodes.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu"), F.col("sig").alias("su")), "u"), "hubs")
    parts = F.least(F.ceil(F.col("n") / plan.star), F.lit(plan.most_parts))
    with_sigs = (
        join_spread(pairs, hubs, "u", "n")
        .withColumn("part", F.pmod(F.xxhash64("v"), parts).cast("int"))
        .join(nodes.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv"), F.col("sig").alias("sv")), "v")
        .filter(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * plan.percent)
        .select("u", "v", "part", "su", "sv")
    )
    bounds = least_matches(plan)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                alive = _prune(_signatures(b.column("su")), _signatures(b.column("sv")), plan, bounds)
                yield b.select(["u", "v", "part"]).take(pa.array(alive))

    likely = materialise(with_sigs.mapInArrow(prune, "u long, v long, part int"), "likely")
    discard(spark, hubs)
    return likely


class _Cell:
    """The members of a cell: pruned by signature, verified on their sets."""

    def __init__(self, held: pa.Table, plan: Plan, bounds: list[int]) -> None:
        self.plan, self.bounds, self.band = plan, bounds, held.column("band").to_numpy()
        self.sig = _signatures(held.column("sig").combine_chunks())
        self.sets = [np.frombuffer(x, dtype=np.uint64) for x in held.column("set").to_pylist()]
        self.size = np.array([len(x) for x in self.sets])

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        size, plan = self.size, self.plan
        near = others[np.minimum(size[i], size[others]) * 100 >= np.maximum(size[i], size[others]) * plan.percent]
        near = near[_prune(np.broadcast_to(self.sig[i], (len(near), plan.hashes)), self.sig[near], plan, self.bounds)]
        if not len(near):
            return near
        same = self.sig[near] == self.sig[i]
        first = same.reshape(len(near), plan.bands, plan.rows).all(axis=2).argmax(axis=1)
        mine = first >= self.band[i]  # with an earlier band in common, they meet in that bucket
        return near[mine][np.argsort(-same[mine].sum(axis=1), kind="stable")]

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        shared = np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], dtype=np.int64)
        return 100 * shared >= self.plan.percent * (self.size[a] + self.size[b] - shared)


def _sets(wanted: DataFrame, base: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """node, sig and set (sorted 64-bit hashes) of the wanted nodes."""
    needed = Bloom(wanted, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                b = b.filter(pa.array(needed.passes(b.column("__row").to_numpy())))
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array([shingles(t, plan.words).tobytes() for t in texts_of(b, "__text")], pa.binary())], names=["node", "set"])

    sets = base.select("__row", "__text").mapInArrow(released(run), "node long, set binary")
    return sets.join(wanted, "node", "left_semi").join(nodes.select("node", "sig"), "node")


def _verified(pairs: DataFrame, base: DataFrame, plan: Plan) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold; exact.

    Each part of a star is a run of rows, the hub's text first and then those
    of its members, so a hub travels and is shingled once a part.
    """
    hubs = pairs.select("u", "part").distinct().select("u", "part", F.lit(None).cast("long").alias("v"), F.col("u").alias("__row"))
    asked = hubs.unionByName(pairs.select("u", "part", "v", F.col("v").alias("__row")))
    texts = Bloom(asked.select("__row").distinct(), "__row").rows(base.select("__row", "__text"), "__row")
    runs = asked.join(texts, "__row").drop("__row").repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, dtype=np.uint64)
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b, keep = whole.slice(i, 200), []
                for v, text in zip(b.column("v").to_pylist(), texts_of(b, "__text"), strict=True):
                    values = shingles(text, plan.words)
                    if v is None:
                        hub = values
                        keep.append(False)
                        continue
                    shared = len(np.intersect1d(hub, values, assume_unique=True))
                    keep.append(100 * shared >= plan.percent * (len(hub) + len(values) - shared))
                yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return runs.mapInArrow(released(verify), "u long, v long")


def _banded(nodes: DataFrame, plan: Plan, bands: int) -> DataFrame:
    """``nodes`` without signature, once for each of the first ``bands`` bands, with band and key."""
    width = 2 * plan.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    return nodes.select("*", F.posexplode(keys).alias("band", "key")).drop("sig")


def _open(nodes: DataFrame, roots: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """The keys (key, n) of the buckets that hold nodes of several components, and all their rows with root."""
    rooted = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = _banded(rooted, plan, plan.bands)
    keys = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).filter("a != b")
    keys = materialise(keys.select("key", "n"), "open")
    return keys, Bloom(keys, "key").rows(rows, "key")


def _linked(stars: DataFrame, nodes: DataFrame, base: DataFrame, plan: Plan) -> DataFrame:
    """The pairs of ``stars`` that are links, written."""
    stars = materialise(stars.distinct(), "pairs")
    likely = _likely(stars, nodes, plan)
    links = materialise(_verified(likely, base, plan), "links")
    discard(base.sparkSession, stars, likely)
    return links


def _joined(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` after the components that ``links`` join have become one; both tables are discarded."""
    joined = components(links.unionByName(roots.select("u", F.col("root").alias("v"))))
    discard(links.sparkSession, links, roots)
    return joined


def cluster(base: DataFrame, plan: Plan) -> DataFrame:
    """(digest, root) of a ``shingled`` table that has been written: ``root`` names the component."""
    spark = base.sparkSession
    filled = base.filter(F.col("n_shingles") > 0)
    groups = filled.groupBy("digest").agg(F.min("__row").alias("node"))
    nodes = filled.select(F.col("__row").alias("node"), "n_shingles", "sig").join(groups.select("node"), "node", "left_semi")
    nodes = materialise(nodes, "nodes")

    first = _banded(nodes.select("node", "sig"), plan, min(plan.lead, plan.bands))
    shared = first.groupBy("key").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    shared = materialise(shared, "shared")
    stars = join_spread(first, shared, "key", "n").select("u", F.col("node").alias("v")).filter("u != v")
    links = _linked(stars, nodes, base, plan)
    roots = components(links)
    discard(spark, shared, links)

    keys, rows = _open(nodes, roots, plan)
    held = materialise(rows.groupBy("key", "root").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")), "held")
    heads = held.groupBy("key").agg(F.max_by("v", F.struct("n", "root")).alias("u"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    heads = materialise(heads, "heads")
    stars = join_spread(held.select("key", "v"), heads, "key", "roots").select("u", "v").filter("u != v")
    roots = _joined(_linked(stars.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), nodes, base, plan), roots)
    discard(spark, keys, held, heads)

    keys, rows = _open(nodes, roots, plan)
    rooted = join_spread(rows, keys.filter("n > 2"), "key", "n")  # a bucket of two has had its pair compared
    rooted = materialise(rooted.select("key", "band", "node", (F.col("n_shingles") + 256).alias("weight"), "root"), "rooted")
    met = materialise(cells(rooted, plan.cell), "cells")
    discard(spark, keys, rooted)
    if not met.isEmpty():
        bounds = least_matches(plan)
        contents = materialise(_sets(met.select("node").distinct(), base, nodes, plan), "sets")
        found = materialise(links_across(met, contents, lambda held: _Cell(held, plan, bounds)), "links")
        discard(spark, contents)
        roots = _joined(found, roots)
    discard(spark, met, nodes)
    return groups.join(roots.withColumnRenamed("u", "node"), "node", "left").select("digest", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, plan: Plan | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether
    it is the row's own. Null and empty texts have no shingles and no links.
    Repeated rows share a component; a row with a null id takes part, is never
    a component's id, and is kept only where its component has no id at all.
    Extra columns are ignored.
    """
    plan = plan or Plan()
    base = materialise(shingled(docs, plan, id_col, text_col, []), "shingled")
    labels = cluster(base, plan)
    rows = base.select("__id", "n_shingles", "digest")
    linked = rows.filter(F.col("n_shingles") > 0).groupBy("digest").agg(F.min("__id").alias("least")).join(labels, "digest")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("digest", "root").join(least, "root").select("digest", "component_id")
    some = rows.filter(F.col("n_shingles") > 0).join(named, "digest").select("__id", "n_shingles", "component_id")
    none = rows.filter(F.col("n_shingles") == 0).select("__id", "n_shingles", F.col("__id").alias("component_id"))
    found = some.unionByName(none).select(F.col("__id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    found = materialise(found, "near-duplicates")
    discard(docs.sparkSession, base)
    return found


def keep_one(docs: DataFrame, plan: Plan | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the row with the smallest id of each component stays.

    Rows without words all stay. Columns come back as they were.
    """
    plan = plan or Plan()
    plain, names, (id_at, text_at) = masked(docs, id_col, text_col)
    base = materialise(shingled(plain, plan, id_at, text_at, [c for c in plain.columns if c != text_at]), "shingled")
    labels = cluster(base, plan)
    rank = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    first = base.filter(F.col("n_shingles") > 0).groupBy("digest").agg(F.min(rank).alias("r"))
    stay = first.join(labels, "digest").groupBy("root").agg(F.min("r").alias("r")).select(F.col("r.row").alias("__row"))
    kept = base.filter(F.col("n_shingles") > 0).join(stay, "__row", "left_semi").unionByName(base.filter(F.col("n_shingles") == 0))
    return kept.select(*[F.col("__text").cast(plain.schema[c].dataType).alias(n) if c == text_at else F.col(c).alias(n) for c, n in zip(plain.columns, names, strict=True)])


CONTRACT = Plan(words=2)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), CONTRACT)
