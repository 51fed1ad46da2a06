"""Toxicity by class-conditional Kneser-Ney models of letter sequences.

Two models share everything but their highest order. For a class c, a
character w after the context h of ``order - 1`` characters has

    P_c(w | h) = (max(n_c(h w) - D, 0) + D * T_c(h) * P(w | h')) / n_c(h)

with n_c the class's counts, T_c the distinct characters it saw after h, and
P(w | h') the shared backoff one order lower: continuation counts over both
classes (how many characters precede a sequence), smoothed in the same way by
the order below, down to single letters and then a uniform distribution. A
sequence that a class never saw after a known context costs its backoff mass,
and one that neither class knows costs both the same, so rare words decide
nothing.

A text's evidence is its log-likelihood ratio per character, the same per
word above a margin (mean, log of the sum), and its strongest word. A logistic
curve over the four makes the score. It is fitted on all labelled rows, each
weighed by a model that left out its fold; the model that scores has all
folds. Where a class exceeds the bounded sample, each of its rows there counts
for as many as it stands for, so the curve keeps the true class ratio.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import held_out, masked, materialise, read_table, released, schema_with
from granary.llm.tokens import segments

STEP = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32
SEGMENT, SLICE = 1 << 18, 1 << 18  # characters of a text, and of several texts, that are counted at once


@dataclass(frozen=True)
class Params:
    """``labels_per_class`` bounds the labelled ids that the models learn from, in ``folds`` parts; both are in every result."""

    order: int = 5
    discount: float = 0.75
    labels_per_class: int = 50_000
    margin: float = 4.0
    folds: int = 3
    alphabet: int = 500


class Table:
    """Values by 64-bit hash: 12 bytes for each sequence that the labelled rows hold, all of them kept, and an index of 4 to 8 bytes each."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        bits = max(len(hashes).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def look_up(self, h: np.ndarray, empty: float) -> np.ndarray:
        """The value of each hash, ``empty`` where the table does not hold it."""
        found = np.full(len(h), empty, dtype=np.float32)
        slot = (h >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        todo = np.flatnonzero(at < end)
        while len(todo):
            hit = self.hashes[at[todo]] == h[todo]
            found[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return found


@dataclass(frozen=True)
class Model:
    params: Params
    ratio: Table  # by sequence: log P_toxic - log P_ordinary
    back: Table  # by context: log of the backoff masses' ratio
    weights: np.ndarray  # bias, then one for each piece of evidence


def codes(segment: str) -> np.ndarray:
    """Lower-cased characters, white space as single blanks, one blank around; NUL and surrogates as U+FFFD."""
    c = np.frombuffer((" " + " ".join(segment.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where((c == 0) | ((c >= 0xD800) & (c < 0xE000)), np.uint32(0xFFFD), c)


def rolling(c: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each ``order`` consecutive characters."""
    c = c.astype(np.uint64)
    h = c
    for k in range(1, order):
        h = h[:-1] * STEP + c[k:]
    return h * STEP


def allowed(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """__id and y of the labelled ids outside the held-out part."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")).filter(F.col("__id").isNotNull() & F.col("y").isin(0, 1))
    return known.filter(~held_out("__id")).groupBy("__id").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, known: DataFrame, params: Params, id_col: str, text_col: str) -> DataFrame:
    """text, y and fold of the ids of ``known``, at most ``labels_per_class`` a class; of an id's rows the least text."""
    picked = [known.filter(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(params.labels_per_class) for y in (0, 1)]
    fold = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(params.folds)).cast("int")
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "__id")  # bounded by labels_per_class
    return chosen.groupBy("__id", "y").agg(F.min("text").alias("text")).select("text", "y", fold.alias("fold"))


def standing_for(known: DataFrame, params: Params) -> np.ndarray:
    """By label, how many allowed ids each sampled one stands for: 1 up to the bound."""
    all_ = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    return np.array([max(all_.get(y, 0) / params.labels_per_class, 1.0) for y in (0, 1)])


def sequence_counts(rows: DataFrame, params: Params) -> DataFrame:
    """gram (``order`` characters), and t0, o0, t1, ...: its toxic and ordinary count in each fold."""
    order, kinds = params.order, 2 * params.folds

    def count(held: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        gram = np.concatenate([rolling(c, order) for c, _ in held])
        kind = np.concatenate([np.full(len(c) - order + 1, k) for c, k in held])
        each = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, order) for c, _ in held])
        _, first, back = np.unique(gram, return_index=True, return_inverse=True)
        n = np.bincount(back * kinds + kind, minlength=len(first) * kinds)
        some = np.flatnonzero(n)
        text = np.ascontiguousarray(each[first]).view(f"<U{order}").ravel()
        return pa.RecordBatch.from_arrays([pa.array(text[some // kinds], pa.string()), pa.array((some % kinds).astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["gram", "kind", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for b in batches:
            for text, y, fold in zip(b.column("text"), b.column("y").to_pylist(), b.column("fold").to_pylist(), strict=True):
                for segment in segments(text.as_py(), SEGMENT):
                    c = codes(segment)
                    if len(c) >= order:
                        held.append((c, 2 * fold + 1 - y))
                        chars += len(c)
                    if chars >= SLICE:
                        yield count(held)
                        held, chars = [], 0
        if held:
            yield count(held)

    each = rows.select("text", "y", "fold").mapInArrow(released(run), "gram string, kind int, n long")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{'to'[k % 2]}{k // 2}") for k in range(kinds)]
    return each.groupBy("gram").agg(*sums)


def shared_backoff(grams: DataFrame, params: Params) -> DataFrame:
    """(s, p): the chance of each sequence of ``order - 1`` characters by continuation counts, recursively smoothed."""
    d, levels = params.discount, []
    types = grams.select("gram")
    for _ in range(params.order - 1):
        kinds = types.groupBy(F.substring("gram", 2, params.order).alias("s")).agg(F.count(F.lit(1)).alias("kinds"))
        levels.append(kinds)
        types = kinds.select(F.col("s").alias("gram"))
    lower = None  # from single letters, above a uniform distribution, upwards
    for kinds in reversed(levels):
        seen = kinds.withColumn("h", F.expr("substring(s, 1, length(s) - 1)"))
        each = seen.join(seen.groupBy("h").agg(F.sum("kinds").alias("all"), F.count(F.lit(1)).alias("followers")), "h")
        if lower is None:
            each = each.withColumn("q", F.lit(1 / params.alphabet))
        else:
            each = each.join(lower.select(F.col("s").alias("below"), F.col("p").alias("q")), F.substring("s", 2, params.order) == F.col("below"))
        lower = each.select("s", ((F.greatest(F.col("kinds") - d, F.lit(0.0)) + d * F.col("followers") * F.col("q")) / F.col("all")).alias("p"))
    return lower


def log_ratios(grams: DataFrame, shared: DataFrame, params: Params, without: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(gram, value) and (context, value): the two tables of the model of all folds, or of all but one."""
    d, folds = params.discount, [k for k in range(params.folds) if k != without]
    both = grams.select("gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), *[reduce(add, [F.col(f"{c}{k}") for k in folds]).alias(n) for c, n in (("t", "toxic"), ("o", "ordinary"))])
    both = both.filter(F.col("toxic") + F.col("ordinary") > 0)
    contexts = both.groupBy("context").agg(
        F.sum("toxic").alias("nt"), F.sum("ordinary").alias("no"), F.count_if(F.col("toxic") > 0).alias("tt"), F.count_if(F.col("ordinary") > 0).alias("to")
    )
    chance = lambda n, all_, kinds: F.when(all_ > 0, (F.greatest(n - d, F.lit(0.0)) + d * kinds * F.col("p")) / all_).otherwise(F.col("p"))
    ratio = F.log(chance(F.col("toxic"), F.col("nt"), F.col("tt")) / chance(F.col("ordinary"), F.col("no"), F.col("to")))
    value = both.join(contexts, "context").join(shared, F.substring("gram", 2, params.order) == F.col("s")).select("gram", ratio.cast("float").alias("value"))
    mass = lambda all_, kinds: F.when(all_ > 0, d * kinds / all_).otherwise(1.0)
    back = contexts.select(F.col("context").alias("gram"), F.log(mass(F.col("nt"), F.col("tt")) / mass(F.col("no"), F.col("to"))).cast("float").alias("value"))
    return value, back


def collected(values: DataFrame, length: int) -> Table:
    """All rows of a table of the model on the driver, as many as there are sequences in the bounded sample."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array(rolling(c, length)[::length].view(np.int64)), b.column("value")], names=["h", "value"])

    found = values.select("gram", "value").mapInArrow(hashed, "h long, value float").toArrow()
    return Table(found.column("h").to_numpy().view(np.uint64), found.column("value").to_numpy())


def evidence(text: str, ratio: Table, back: Table, params: Params) -> list[float]:
    """Mean per character, mean and log sum of words above the margin, strongest word."""
    order = params.order
    total, chars, above, words, most = 0.0, 0, 0.0, 0, 0.0
    for segment in segments(text, SEGMENT):
        c = codes(segment)
        if len(c) < order:
            continue
        value = ratio.look_up(rolling(c, order), np.nan)
        unseen = np.flatnonzero(np.isnan(value))
        value[unseen] = back.look_up(rolling(c, order - 1)[unseen], 0.0)
        starts = np.concatenate(([0], np.flatnonzero(c[order - 1 :] == SPACE) + 1))
        each = np.add.reduceat(value, starts[starts < len(value)])
        total, chars = total + float(value.sum(dtype=np.float64)), chars + len(value)
        above, words, most = above + float(np.maximum(each - params.margin, 0).sum()), words + len(each), max(most, float(each.max()))
    return [total / max(chars, 1), above / max(words, 1), float(np.log1p(above)), most]


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bias first) by damped Newton steps with a small ridge; row k counts ``times[k]`` times."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve(a.T @ (a * (times * (p * (1 - p) + 1e-6))[:, None]) + 1e-3 * np.eye(len(w)), a.T @ (times * (y - p)) - 1e-3 * w)
    return np.r_[w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale]


def fit(docs: DataFrame, labels: DataFrame, params: Params | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows whose crc32(id as text) mod 5 is not 0.

    Where these have one label only, or there are none, every score is the
    share of label 1 among them (0 without any).
    """
    params, spark = params or Params(), docs.sparkSession
    known = allowed(labels, id_col, label_col)
    rows = materialise(labelled(docs, known, params, id_col, text_col), "labelled")
    grams = materialise(sequence_counts(rows, params), "grams")
    shared = materialise(shared_backoff(grams, params), "backoff")

    def tables(without: int | None) -> tuple[Table, Table]:
        value, back = log_ratios(grams, shared, params, without)
        return collected(value, params.order), collected(back, params.order - 1)

    def weighed(fold: int) -> pd.DataFrame:
        sent = spark.sparkContext.broadcast(tables(fold))

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array([evidence(t.as_py(), *sent.value, params) for t in b.column("text")]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([b.column("y"), *[pa.array(x[:, k]) for k in range(4)]], names=["y", "a", "b", "c", "d"])

        seen = rows.filter(F.col("fold") == fold).select("text", "y").mapInArrow(released(weigh), "y int, a double, b double, c double, d double").toPandas()
        sent.destroy()
        return seen

    by_label = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(by_label) < 2:
        none = Table(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        return Model(params, none, none, np.array([np.inf if 1 in by_label else -np.inf, 0, 0, 0, 0]))
    seen = pd.concat([weighed(k) for k in range(params.folds)])
    y = seen["y"].to_numpy()
    weights = logistic(seen[["a", "b", "c", "d"]].to_numpy(), y, standing_for(known, params)[y])
    return Model(params, *tables(None), weights)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, name: str = "toxicity") -> DataFrame:
    """``keep`` columns (default the id) with ``name``, 0 to 1, which replaces a column of that name.

    Null and empty texts get the score of no evidence. Repeated rows get equal
    scores.
    """
    keep = [c for c in (keep or [id_col]) if c != name]
    rows, _, _ = masked(docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    at = rows.columns[-1:]
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema, kept = schema_with(rows.drop(*at), "__score double"), rows.columns[: len(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if b.num_rows:
                x = np.array([evidence(t.as_py(), m.ratio, m.back, m.params) for t in b.column(at[0])])
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(m.weights[0] + x @ m.weights[1:])))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(p)], names=[*kept, "__score"])

    return rows.mapInArrow(released(run), schema).toDF(*keep, name)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
