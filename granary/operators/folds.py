"""Folds over ordered rows: what a row becomes depends on all rows before it in its group.

Spark deals rows to partitions by group and sorts them there; a task then
holds one batch of rows and the state of one group, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from granary.sources.schemas import schema_with


def folded(df: DataFrame, by: str, order: list[str], values: list[str], start: Any, step: Callable[..., tuple[Any, tuple]], added: str) -> DataFrame:
    """``df`` with the columns ``added`` (DDL): ``step(state, *values)`` gives the next state and the row's new values."""
    fields = T.StructType.fromDDL(added).fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = (), start
        for b in batches:
            out = []
            for key, *v in zip(*[b.column(c).to_pylist() for c in (by, *values)], strict=True):
                if (key,) != held:
                    held, state = (key,), start
                state, new = step(state, *v)
                out.append(new)
            for k, f in enumerate(fields):
                b = b.append_column(f.name, pa.array([o[k] for o in out], to_arrow_type(f.dataType)))
            yield b

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema_with(df, added))


def merged_articles(df: DataFrame, by: str, order: list[str], length: str, *, least: int = 200, most: int = 3000) -> DataFrame:
    """``run``: the number of the record that an article goes to, from 1 in each law.

    Articles under ``least`` gather until they would pass ``most``; one that
    would make them pass it opens the next record and takes small ones too.
    Any other article, and one over ``most``, is a record alone.
    """

    def step(state: tuple[int, int | None], size: int) -> tuple[tuple[int, int | None], tuple[int]]:
        run, waiting = state
        if size > most:
            return (run + 1, None), (run + 1,)
        if waiting is not None and waiting + size > most:
            return (run + 1, size), (run + 1,)
        if size >= least:
            return (run + 1, None), (run + 1,)
        return ((run, waiting + size), (run,)) if waiting is not None else ((run + 1, size), (run + 1,))

    return folded(df, by, order, [length], (0, None), step, "run int")


def packed_clauses(df: DataFrame, by: str, order: list[str], length: str, *, most: int = 3000) -> DataFrame:
    """``run``: the number of the piece that a clause goes to, from 1: a piece is closed before it would pass ``most``."""

    def step(state: tuple[int, int], size: int) -> tuple[tuple[int, int], tuple[int]]:
        run, chars = state
        state = (run + 1, size) if run == 0 or chars + size > most else (run, chars + size)
        return state, (state[0],)

    return folded(df, by, order, [length], (0, 0), step, "run int")
