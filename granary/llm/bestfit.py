"""Best-fit packing by exact complements, planned on counts of lengths.

How pieces can share sequences depends on their lengths alone, and there are
at most ``capacity`` of those. So Spark counts the pieces of each length, the
driver plans on these counts, and every piece finds its sequence from its
place among the pieces of its length. A plan entry is a pattern of lengths and
how often it is used. The pattern starts with the longest piece left; its gap
is looked up in an index of the sums that one, two or three available lengths
make, and a combination that fills it exactly closes it; else the longest
piece that fits goes in, and the rest of the gap is looked up again. A pattern
is used as often as the availability of its lengths allows, which empties a
length or nearly does. Patterns number at most ``capacity * (1 + ln
capacity)``, whatever the size of the corpus.

One range shuffle puts pieces in the order of their lengths; the pieces of a
common length are spread over many tasks by their place in the table.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialise, read_table, released, schema_with
from granary.llm.ordering import numbered

#: White space that the tokenizer drops; nothing joins across it, so chunks between it are encoded one by one.
CHUNK = re.compile(r"[^\t-\r ]+")
PIECES = "doc_id long, piece int, start long, length long, ids binary"


#: Ends a word without ever joining it: no letter, no digit, and nothing that composes with what stands before.
TAIL = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())
#: Below this, letters have one form in NFC; only lower-casing can add a mark.
PLAIN = "\u0250"
#: The model spells a byte as one printable character: itself where it has one, else the next from U+0100 on.
_SEEN = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
SPELLING = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


class Memo(dict):
    """The ids of recent chunks as little-endian unsigned 32-bit integers.

    Two generations of at most ``most`` chunks of up to 64 characters: when
    the young one is full it becomes the old one, whose chunks come back when
    they occur again. A Latin word is a single piece for the tokenizer's
    model, which is asked directly; a word and the marks behind it are looked
    up apart; everything else goes through the whole tokenizer.
    """

    def __init__(self, json_file: str, most: int = 300_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old = Tokenizer.from_file(json_file), most, {}
        self.pieces = self.tokenizer.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.encoded(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def encoded(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isalpha():
            if low.isascii():
                return packed([p.id for p in self.pieces(low)])
            if max(chunk) < PLAIN:
                return packed([p.id for p in self.pieces(low.encode().decode("latin-1").translate(SPELLING))])
        elif "<|" not in chunk:  # such may be an added token
            word = chunk.rstrip(TAIL)
            if word and len(word) < len(chunk) and word[-1] < PLAIN and word[-1].lower().isalnum():
                return self[word] + self[chunk[len(word) :]]
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_kept: dict[str, Memo] = {}


def pieces_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", json_file: str, end_id: int = 0, max_tokens: int = 2048) -> DataFrame:
    """Each text's ids and ``end_id``, cut into pieces of ``max_tokens`` only where they exceed it; the last piece may be shorter.

    Null and empty texts are one token (``end_id``). Null ids and repeated
    rows are cut like any other row; extra columns are ignored. Added tokens
    in a text are encoded as the tokenizer does by default.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    end, width = end_id.to_bytes(4, "little"), 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if json_file not in _kept:
            _kept[json_file] = Memo(json_file)
        get = _kept[json_file].__getitem__
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = b"".join(map(get, CHUNK.findall(text.as_py() or ""))) + end
                rows += [(doc, k, k * max_tokens, len(part) // 4, part) for k, part in enumerate(ids[at : at + width] for at in range(0, len(ids), width))]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return source.mapInArrow(released(run), PIECES)


class SumIndex:
    """Which sums one, two and three of the available lengths make."""

    def __init__(self, available: np.ndarray) -> None:
        one = (available > 0).astype(np.float32)
        self.one = one > 0
        self.two = self._sums(one, one)
        self.three = self._sums(self.two.astype(np.float32), one)

    @staticmethod
    def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size = 2 * len(a)
        return (np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size) > 0.5)[: len(a)]


def _pair(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two available lengths up to ``most`` with this sum, as equal as can be."""
    a = np.arange(max(1, total - most), total // 2 + 1)
    good = a[(left[a] > 0) & (left[total - a] > (2 * a == total))]
    return (int(total - good[-1]), int(good[-1])) if len(good) else None


def exact_fill(left: np.ndarray, index: SumIndex, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths whose sum is ``gap``, fewest first; ``left`` has how many there are of each."""
    if index.one[gap] and left[gap] > 0:
        return (gap,)
    if index.two[gap] and (found := _pair(left, gap, gap)):
        return found
    if index.three[gap]:
        longest = np.arange(-(-gap // 3), gap - 1)
        longest = longest[(left[longest] > 0) & index.two[gap - longest]]
        for a in map(int, longest):
            left[a] -= 1
            found = _pair(left, gap - a, a)
            left[a] += 1
            if found:
                return (a, *found)
    return None


def plan(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns (uses of each length, longest first) and their copies, which use up ``counts[length]`` pieces of every length."""
    capacity = len(counts) - 1
    left, patterns = counts.astype(np.int64).copy(), []
    index = SumIndex(left)
    while len(open_lengths := np.flatnonzero(left)):
        uses: Counter[int] = Counter()
        gap, take = capacity, (int(open_lengths[-1]),)
        while take:
            for n in take:
                uses[n] += 1
                left[n] -= 1
                gap -= n
            take = ()
            if gap and not (take := exact_fill(left, index, gap) or ()):
                fits = np.flatnonzero(left[: gap + 1])
                take = (int(fits[-1]),) if len(fits) else ()
        copies = 1 + min(int(left[n]) // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= k * (copies - 1)
        if any(left[n] == 0 for n in uses):
            index = SumIndex(left)
        patterns.append((dict(sorted(uses.items(), reverse=True)), copies))
    return patterns


def place(pieces: DataFrame, *, capacity: int = 2048, label: str = "best-fit") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every column rides along, so carry only what the result needs.

    ``pieces`` has a column ``length`` (1 to ``capacity``). Sequences have no
    more than ``capacity`` tokens and no gaps before their end. Repeated rows
    are pieces of their own. An empty table stays empty.
    """
    written = materialise(pieces, label + "-pieces").withColumn("__row", F.monotonically_increasing_id())
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in written.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    first_number = np.concatenate([[0], np.cumsum(counts)[:-1]])
    used, runs, sequences = np.zeros(capacity + 1, np.int64), [], 0
    for uses, copies in plan(counts):
        offset = 0
        for n, k in uses.items():
            runs.append((n, int(used[n]), k, sequences, offset))
            used[n] += k * copies
            offset += k * n
        sequences += copies
    runs.sort()
    of_length, from_rank, per_copy, first_sequence, first_offset = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else [()] * 5))
    starts = first_number[of_length] + from_rank  # ascending, as numbers follow lengths
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("__number").to_numpy()
            at = np.searchsorted(starts, number, side="right") - 1
            copy, slot = np.divmod(number - starts[at], per_copy[at])
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first_sequence[at] + copy), pa.array(first_offset[at] + slot * of_length[at])], names=[*names, "sequence_id", "offset"])

    ranked = numbered(written, [F.asc("length"), F.asc("__row")], name="__number", label=label + "-order").drop("__row")
    return ranked.mapInArrow(run, schema_with(pieces, "sequence_id long, offset long"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pieces_of(read_table(spark, sf_dir, "documents"), json_file=public_tokenizers.path("word_bpe_49k.json"))
    return place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
