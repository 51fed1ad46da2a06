"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its
letters by elementwise product after rotating each by its place; a text's
vector bundles (sums) its n-gram vectors, and a language's prototype bundles
the texts known to be in it. A text belongs to the prototype with the
largest cosine.

A text's vector is the sum over its distinct n-grams of count times n-gram
vector. Tasks bundle their texts by language; Spark adds the bundles up.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import held_out, read_table, schema_with
from granary.llm.tokens import segments

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """``letters`` codes: 0 is the gap between words, the others go to lower-case letters in turn, over and over.

    With 128 codes the 127 first letters (Latin with its common accents) have
    one each, and so has every other small alphabet within itself.
    """

    letters: int = 128
    dimensions: int = 1024
    seed: int = 11


@lru_cache
def letter_table(letters: int) -> np.ndarray:
    """The codes of the first planes of characters; from U+3000 on a letter's code follows from its number."""
    table = np.zeros(0x20000, dtype=np.uint8)
    lower = 0
    for point in range(len(table)):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L" and (kind == "Lu" or point >= 0x3000):  # capitals without a lower case of their own too
            table[point] = 1 + point % (letters - 1)
        elif kind[0] == "L":
            table[point] = 1 + lower % (letters - 1)
            lower += 1
    return table


class Letters:
    """Codes of characters: gaps 0, letters 1 to ``letters - 1``; other characters vanish into gaps."""

    def __init__(self, params: Params) -> None:
        self.params, self.table = params, letter_table(params.letters)

    def codes(self, segment: str) -> np.ndarray:
        """Lower-cased letters with one gap between words and at both ends; empty without letters."""
        points = np.frombuffer(segment.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(points) and points.max() >= len(self.table):  # other scripts, by the same rule
            high = points >= len(self.table)
            c = self.table[np.where(high, 0, points)]
            c[high] = [1 + int(p) % (self.params.letters - 1) if unicodedata.category(chr(p))[0] == "L" else 0 for p in points[high]]
        else:
            c = self.table[points]
        kept = np.flatnonzero((c[1:] != 0) | (c[:-1] != 0)) + 1  # the first of each run of gaps stays
        c = np.concatenate((c[:1], c[kept], np.zeros(1, np.uint8))) if len(c) else c
        if not c.any():
            return np.empty(0, dtype=np.int64)
        at = np.flatnonzero(c)
        return np.concatenate(([0], c[at[0] : at[-1] + 1], [0])).astype(np.int64)

    def trigrams(self, text: str) -> np.ndarray:
        """The code of each three consecutive letters and gaps of the whole text."""
        n, parts = self.params.letters, []
        for segment in segments(text):
            c = self.codes(segment)
            if len(c) > 2:
                parts.append((c[:-2] * n + c[1:-1]) * n + c[2:])
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


class Space:
    """The random letter vectors and the n-gram vectors bound from them."""

    def __init__(self, params: Params) -> None:
        rng = np.random.default_rng(params.seed)
        letters = rng.integers(0, 2, (params.letters, params.dimensions), dtype=np.int8) * 2 - 1
        self.n = params.letters
        self.places = [np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        n = self.n
        return self.places[0][grams // (n * n)] * self.places[1][grams // n % n] * self.places[2][grams % n]


def profile_counts(docs: DataFrame, params: Params, text_col: str, lang_col: str) -> DataFrame:
    """lang, dimension, n: the bundle of all texts of each language; each task bundles its own first.

    Null texts add nothing; rows without a language are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, space, held = Letters(params), Space(params), {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                if lang not in held:
                    held[lang] = np.zeros(params.letters**3, dtype=np.int64)
                t = letters.trigrams(text.as_py() or "")
                if len(t):
                    grams, n = np.unique(t, return_counts=True)
                    held[lang][grams] += n
            if len(held) > 8:  # bounds the task's memory
                yield from told(held, space)
                held = {}
        yield from told(held, space)

    def told(held: dict[str, np.ndarray], space: Space) -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            grams, total = np.flatnonzero(n), np.zeros(params.dimensions, dtype=np.int64)
            for k in range(0, len(grams), 8192):
                part = grams[k : k + 8192]
                total += n[part] @ space.vectors(part)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(np.arange(len(total))), pa.array(total)], names=["lang", "dimension", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    return rows.mapInArrow(count, "lang string, dimension long, n long").groupBy("lang", "dimension").agg(F.sum("n").alias("n"))


def prototypes(counts: DataFrame, params: Params) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit vectors; one row for each language and dimension is collected."""
    table = counts.toArrow()
    langs, at, n = (table.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "dimension", "n"))
    names = sorted(set(langs))
    found = np.zeros((len(names), params.dimensions))
    found[np.searchsorted(names, langs) if names else at, at] = n
    return names, found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, names: list[str], unit: np.ndarray, params: Params | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the best cosine, at least 0) of each row's whole text.

    A null text or one without letters is ``und`` with score 0, as is every
    text where no language was learned; ties go to the first language by name.
    """
    params = params or Params()
    held = docs.sparkSession.sparkContext.broadcast((names, unit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, space = Letters(params), Space(params)
        langs, profiles = held.value
        profiles = profiles.astype(np.float32)
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                counted = [np.unique(letters.trigrams(t or ""), return_counts=True) for t in b.column("text").to_pylist()]
                pred, score = [UNKNOWN] * len(counted), np.zeros(len(counted))
                grams = np.unique(np.concatenate([g for g, _ in counted]))
                if len(grams) and langs:
                    bundle = np.zeros((len(counted), params.dimensions), dtype=np.float32)
                    for k in range(0, len(grams), 8192):
                        part = grams[k : k + 8192]
                        counts = np.zeros((len(counted), len(part)), dtype=np.float32)
                        for row, (g, n) in enumerate(counted):
                            inside = slice(*np.searchsorted(g, [part[0], part[-1] + 1]))
                            counts[row, np.searchsorted(part, g[inside])] = n[inside]
                        bundle += counts @ space.vectors(part).astype(np.float32)
                    cosine = (bundle @ profiles.T) / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-12)
                    best = cosine.argmax(axis=1)
                    for row, (g, _) in enumerate(counted):
                        if len(g):
                            pred[row], score[row] = langs[best[row]], min(1.0, max(0.0, float(cosine[row, best[row]])))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema_with(rows.drop("text"), "lang_pred string, score double"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, params = read_table(spark, sf_dir, "documents"), Params()
    names, unit = prototypes(profile_counts(docs.filter(~held_out()), params, "text", "lang"), params)
    return identify(docs, names, unit, params).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
