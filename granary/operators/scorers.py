"""Named models for pairs and texts: loaded once a worker, fed by bytes, with a defined value where they fail.

A model is a function of lists, and its loader a function without arguments, so
a cross-encoder, a remote service or a rule take the same slot. The ones that
are registered here need no files: words in common, and a seeded hashing
embedder whose cosine also scores pairs.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame

from granary.operators.search import rerank
from granary.sources.schemas import schema_with

PairModel = Callable[[list[str], list[str]], Sequence[float]]
TextModel = Callable[[list[str]], np.ndarray]

DIMENSIONS = 1024
WORD = re.compile(r"[0-9A-Za-z가-힣]+")


def hashing_embedder(dimensions: int = DIMENSIONS, seed: int = 7) -> TextModel:
    """Unit vectors of signed counts of words and their pairs, each at a place that its seeded hash names; a text without words is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, text in enumerate(texts):
            words = WORD.findall(text.lower())
            for term in (*words, *map(" ".join, zip(words, words[1:], strict=False))):
                h = zlib.crc32(term.encode(), seed)
                out[row, h // 2 % dimensions] += 1.0 if h & 1 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1.0, length)

    return embed


def words_in_common() -> PairModel:
    """The share of the query's distinct words that the text has; 0 for a query without words."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        found = []
        for q, t in zip(queries, texts, strict=True):
            wanted = set(WORD.findall(q.lower()))
            found.append(len(wanted & set(WORD.findall(t.lower()))) / len(wanted) if wanted else 0.0)
        return found

    return score


def hashed_cosine() -> PairModel:
    embed = hashing_embedder()
    return lambda queries, texts: (embed(queries) * embed(texts)).sum(axis=1).tolist()


SCORERS: dict[str, Callable[[], PairModel]] = {"words": words_in_common, "hashed": hashed_cosine}
EMBEDDERS: dict[str, Callable[[], TextModel]] = {"hashing": hashing_embedder}
_loaded: dict[str, Callable] = {}


def loader_of(registry: dict[str, Callable[[], Callable]], name: str) -> Callable[[], Callable]:
    if name not in registry:
        raise ValueError(f"unknown model {name}; there are {', '.join(sorted(registry))}")
    return registry[name]


def loaded(key: str, loader: Callable[[], Callable]) -> Callable:
    """The model, made by the first task of a worker that asks for it; each task has a loader of its own, but the same key."""
    if key not in _loaded:
        _loaded[key] = loader()
    return _loaded[key]


def by_size(columns: Sequence[list[str]], most: int) -> Iterator[slice]:
    """Slices of rows that have about ``most`` characters in all; a longer row is one by itself."""
    begin = chars = 0
    for row, parts in enumerate(zip(*columns, strict=True)):
        size = sum(map(len, parts))
        if row > begin and chars + size > most:
            yield slice(begin, row)
            begin, chars = row, 0
        chars += size
    if columns and len(columns[0]) > begin:
        yield slice(begin, len(columns[0]))


def _applied(df: DataFrame, columns: Sequence[str], added: str, kind: pa.DataType, name: str, loader: Callable, most: int, failure: object) -> DataFrame:
    rest = df.drop(added)
    key = f"{name}-{hashlib.sha256(cloudpickle.dumps(loader)).hexdigest()}"
    spark_kind = {pa.float64(): "double"}.get(kind, "array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(key, loader)
        for b in batches:
            parts = [[x or "" for x in b.column(c).to_pylist()] for c in columns]
            found: list[object] = []
            for some in by_size(parts, most):
                given = [p[some] for p in parts]
                try:
                    answer = [x if isinstance(x, float) else x.tolist() for x in map(lambda v: v if isinstance(v, np.ndarray) else float(v), model(*given))]
                    if len(answer) != len(given[0]):
                        raise ValueError("a model must answer every row")
                except Exception:
                    answer = [failure] * len(given[0])
                found += answer
            yield b.append_column(added, pa.array(found, kind))

    return rest.mapInArrow(run, schema_with(rest, f"`{added}` {spark_kind}"))


def scored(pairs: DataFrame, scorer: str, *, query: str = "query", text: str = "content", score: str = "score", most_chars: int = 1 << 18, failure: float = 0.0) -> DataFrame:
    """``pairs`` with the score of a registered scorer. Nulls are empty texts; a batch that the model fails on scores ``failure``."""
    return _applied(pairs, [query, text], score, pa.float64(), scorer, loader_of(SCORERS, scorer), most_chars, failure)


def embedded(texts: DataFrame, embedder: str = "hashing", *, text: str = "text", vector: str = "embedding", most_chars: int = 1 << 18) -> DataFrame:
    """``texts`` with the vector of a registered embedder; null where the model fails. Null texts count as empty."""
    return _applied(texts, [text], vector, pa.list_(pa.float64()), embedder, loader_of(EMBEDDERS, embedder), most_chars, None)


def reranked(hits: DataFrame, scorer: str, k: int | Column, **how) -> DataFrame:
    """``rerank`` of (query_id, rank, query, content) by a registered scorer."""
    mark = "score_of_" + "_".join(hits.columns)
    by = scored(hits, scorer, score=mark, **how)
    return rerank(by, k, by[mark]).drop(mark)
