"""Links inside buckets: a spanning forest of the members' links instead of their pairs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import join_spread, materialise, mix64

MIN_BITS, MAX_BITS = 20, 28
ANCHORS = 256


class Pairs(Protocol):
    """What a cell's members, prepared once, answer about pairs of their positions."""

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may be linked with ``i``, the most likely first."""
        ...

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are linked; exact."""
        ...


def forest(pairs: Pairs, root: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of links that join whatever the links of all pairs would join.

    Members with one ``root`` are joined already. Where two parts meet, only
    pairs across them count, and the first part's members seek partners.
    Members outside the largest group seek partners outside their own group:
    first the most likely one each, then four times as many, and so on, until
    none is left that a link so far found has not joined with them.
    """
    group = np.unique(root, return_inverse=True)[1]
    two = len(np.unique(part)) > 1
    seeks = part == part.min() if two else group != np.bincount(group).argmax()
    open_ = part != part.min() if two else np.ones(len(root), dtype=bool)
    anchors, found_a, found_b = np.flatnonzero(seeks), [], []
    for k in range(0, len(anchors), ANCHORS):
        some = anchors[k : k + ANCHORS]
        waiting: list[tuple[int, np.ndarray]] = []
        for i in some:
            open_[i] = False  # every other seeker has met it, or will not have to
            others = np.flatnonzero(open_ & (group != group[i]))
            if len(others) and len(others := pairs.likely(int(i), others)):
                waiting.append((int(i), others))
        take = 1
        while waiting:
            a = np.concatenate([np.full(len(o[:take]), i) for i, o in waiting])
            b = np.concatenate([o[:take] for _, o in waiting])
            hit = pairs.linked(a, b)
            for i, j in zip(a[hit], b[hit], strict=True):
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
                    found_a.append(i)
                    found_b.append(j)
            rest = [(i, o[take:]) for i, o in waiting]
            waiting = [(i, o) for i, o in ((i, o[group[o] != group[i]]) for i, o in rest) if len(o)]
            take *= 4
    return np.array(found_a, dtype=np.int64), np.array(found_b, dtype=np.int64)


def cells(members: DataFrame, cell: int) -> DataFrame:
    """``members`` (key, node, root, weight, ...) without key and weight, in the cells (__cell, __part) in which they meet.

    Buckets with a single root are left out. Up to twice ``cell`` of weight a
    bucket is one cell. A heavier one is split, the members of its most
    frequent root apart from the others, into parts of about ``cell`` each;
    each two parts meet in a cell of their own, but no two parts of that root.
    So a task holds two parts at most, and a group that is mostly joined
    already costs rows in proportion to what is not.
    """
    roots = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    sizes = roots.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("__most"), F.max_by("w", F.struct("n", "root")).alias("__major"), F.sum("w").alias("__all"), F.count(F.lit(1)).alias("__roots"), F.sum("n").alias("__n"))
    parts = lambda w: F.greatest(F.lit(1), F.ceil(w / cell).cast("int"))
    whole = F.col("__all") <= 2 * cell
    sizes = sizes.filter("__roots > 1").select(
        "key", "__n", "__most", F.when(whole, 1).otherwise(parts(F.col("__all") - F.col("__major"))).alias("__minors"), F.when(whole, 0).otherwise(parts(F.col("__major"))).alias("__majors")
    )
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    minor = (F.col("__majors") == 0) | (F.col("root") != F.col("__most"))
    # a minor part meets every part, itself included; a major part meets the minor ones only
    last = F.when(minor, F.col("__minors") + F.col("__majors")).otherwise(F.col("__minors")) - 1
    return (
        join_spread(members, materialise(sizes, "sizes"), "key", "__n")
        .withColumn("__part", F.when(minor, dealt("__minors")).otherwise(F.col("__minors") + dealt("__majors")))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("__cell", F.struct("key", F.least("__part", "__other").alias("a"), F.greatest("__part", "__other").alias("b")))
        .drop("key", "__n", "__most", "__minors", "__majors", "__other", "weight")
    )


def links_across(met: DataFrame, contents: DataFrame, prepare: Callable[[pa.Table], Pairs]) -> DataFrame:
    """(u, v), u < v: links that join the members of each cell as far as the links of all its pairs do.

    ``met`` comes from ``cells``; ``contents``, one row for each node, has the
    bulky columns that ``prepare`` reads.
    """

    def join(held: pa.Table) -> pa.Table:
        node = held.column("node").to_numpy()
        a, b = forest(prepare(held), held.column("root").to_numpy(), held.column("__part").to_numpy())
        return pa.table({"u": np.minimum(node[a], node[b]), "v": np.maximum(node[a], node[b])})

    return met.join(contents, "node").groupBy("__cell").applyInArrow(join, "u long, v long")


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(values.view(np.uint64) + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 1 << 40, 1 << 50)]


class Bloom:
    """A filter over a column of longs: sixteen bits a value, 2**20 at least and 2**28 (32 MB) at most.

    It spares shuffles rows that a join would drop anyway; the join must still
    follow. Where there are too many values for its size, more rows pass.
    """

    def __init__(self, values: DataFrame, column: str) -> None:
        self.bits = size = min(max(int(16 * values.count()).bit_length(), MIN_BITS), MAX_BITS)

        def words(batches):
            for b in batches:
                if b.num_rows:
                    at = np.concatenate(_places(b.column(0).to_numpy(), size))
                    yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], names=["word", "bits"])

        found = values.select(column).mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(1 << (size - 5), dtype=np.uint32)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
        self.sent = values.sparkSession.sparkContext.broadcast(bits)

    def __getstate__(self) -> dict:
        return {"sent": self.sent, "bits": self.bits}

    def passes(self, values: np.ndarray) -> np.ndarray:
        inside, bits = np.ones(len(values), dtype=bool), self.sent.value
        for at in _places(values, self.bits):
            inside &= (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
        return inside

    def rows(self, df: DataFrame, column: str, *, passing: bool = True) -> DataFrame:
        """The rows of ``df`` whose ``column`` passes, or those whose does not."""

        def keep(batches):
            for b in batches:
                stays = self.passes(b.column(column).to_numpy()) == passing
                if stays.any():
                    yield b.filter(pa.array(stays))

        return df.mapInArrow(keep, df.schema)
