"""Cost-balanced packing of documents into fixed-length token sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention
inside a document does. Each task reads its own input partition: it cuts
documents into full sequences and a rest, gathers rests until ``buffer``
pieces wait, opens as many sequences as their tokens fill, and deals the
pieces in descending order to the sequence with the lowest cost so far that
has room. A piece that fits nowhere whole is cut at the room of the cheapest
sequence. What is left after the last buffer of a task (under one sequence)
goes to sequences whose lengths are powers of two, which need no padding.
No shuffle takes place, and a task holds one buffer of rests at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import read_table
from granary.llm.tokens import Encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacities: np.ndarray, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Deal pieces to sequences.

    Returns (piece, start in piece, length, sequence, offset) for what was
    placed and (piece, start in piece, length) for what found no room.
    """
    room, cost = capacities.astype(np.int64).copy(), np.zeros(len(capacities))
    placed, left = [], []
    for piece in np.lexsort((np.arange(len(lengths)), -lengths)):
        start, need = 0, int(lengths[piece])
        while need:
            fits = room >= need
            if not fits.any():
                fits = room > 0
                if not fits.any():
                    left.append((int(piece), start, need))
                    break
            to = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(need, int(room[to]))
            placed.append((int(piece), start, take, to, int(capacities[to] - room[to])))
            room[to] -= take
            cost[to] += linear * take + quadratic * take * take
            start, need = start + take, need - take
    return placed, left


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    json_file: str,
    rank_file: str,
    end_id: int = 0,
    max_tokens: int = 1024,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
    buffer: int = 2048,
) -> DataFrame:
    """Pack every row's text, followed by ``end_id``, into sequences.

    One output row per piece: the tokens ``start`` to ``start + length`` of
    the document lie in ``sequence_id`` from ``offset`` on; ``ids`` holds them
    as little-endian unsigned 32-bit integers. Null and empty texts are one
    token (``end_id``). Null ids and repeated rows are packed like any other
    row. Extra columns are ignored. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(json_file, rank_file)
        base, used = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple[int, int, int, bytes]] = []  # doc_id, start, tokens of the document, ids
        out: list[tuple] = []
        out_bytes = 0

        def deal(capacities: np.ndarray) -> None:
            nonlocal used, waiting
            lengths = np.array([len(w[3]) // 4 for w in waiting], dtype=np.int64)
            placed, left = assign(lengths, capacities, linear, quadratic)
            for piece, start, length, to, offset in placed:
                doc, first, total, ids = waiting[piece]
                out.append((doc, first + start, length, total, base + used + to, offset, ids[4 * start : 4 * (start + length)]))
            used += len(capacities)
            waiting = [(waiting[p][0], waiting[p][1] + s, waiting[p][2], waiting[p][3][4 * s : 4 * (s + n)]) for p, s, n in left]

        def flush() -> pa.RecordBatch:
            nonlocal out, out_bytes
            columns = list(zip(*out, strict=True))
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
            out, out_bytes = [], 0
            return batch

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total // max_tokens * max_tokens
                for start in range(0, whole, max_tokens):
                    out.append((doc, start, max_tokens, total, base + used, 0, ids[4 * start : 4 * (start + max_tokens)]))
                    used += 1
                if whole < total:
                    waiting.append((doc, whole, total, ids[4 * whole :]))
                out_bytes += len(ids)
                if len(waiting) >= buffer:
                    tokens = sum(len(w[3]) for w in waiting) // 4
                    deal(np.full(tokens // max_tokens, max_tokens))
                if out_bytes > 8 << 20 and out:
                    yield flush()
        tokens = sum(len(w[3]) for w in waiting) // 4
        deal(np.full(tokens // max_tokens, max_tokens))
        tokens = sum(len(w[3]) for w in waiting) // 4
        deal(np.array([1 << b for b in range(tokens.bit_length() - 1, -1, -1) if tokens >> b & 1], dtype=np.int64))
        if out:
            yield flush()

    return source.mapInArrow(run, SCHEMA)


def pack_pieces(docs: DataFrame) -> DataFrame:
    """``pack`` with the production tokenizer, each piece's ids as their crc32."""
    import public_tokenizers

    packed = pack(docs, json_file=public_tokenizers.path("byte_bpe_50k.json"), rank_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_pieces(read_table(spark, sf_dir, "documents"))
