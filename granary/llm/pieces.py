"""Subword encoding by an Aho-Corasick automaton that drives a single-pass Viterbi.

The automaton holds every ordinary piece. Reading a text once, it reports at
each position all pieces that end there, longest first, by its output links;
each of them relaxes the best score of that position. A character that no
single-character piece covers costs the lowest score less ten and becomes
byte pieces. Of equal scores the longer last piece wins.

White space becomes the marker U+2581 and a marker goes before the text, as
the model asks; a marker that the text itself holds is written as its bytes,
so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import read_table

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Memo(dict):
    """What ``find`` gives for a key; at most ``most`` keys of up to ``longest`` characters are kept."""

    def __init__(self, find: Callable[[str], bytes], most: int, longest: int = 48) -> None:
        self.find, self.most, self.longest = find, most, longest

    def __missing__(self, key: str) -> bytes:
        found = self.find(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


class Known(dict):
    """The bytes of ids; those of U+FFFD for an unknown one."""

    def __missing__(self, key: int) -> bytes:
        return b"\xef\xbf\xbd"


class Pieces:
    """Scores of a piece model; the memo keeps at most ``most`` chunks of up to 48 characters."""

    def __init__(self, model_file: str, most: int = 600_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ordinary = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self._build([(i, model.id_to_piece(i), model.get_score(i)) for i in ordinary], {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}, most)

    def _build(self, ordinary: list[tuple[int, str, float]], byte_ids: dict[int, int], most: int) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, piece, score in ordinary:
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.byte_ids, self.memo = byte_ids, Memo(self._chunk, most)
        self.code = {i: i.to_bytes(4, "little") for i in [*(i for i, _, _ in ordinary), *byte_ids.values()]}
        self.unknown = min(score for _, _, score in ordinary) - 10
        self.window, self.longest = 1 << 16, max(len(piece) for _, piece, _ in ordinary)
        self.single = {piece for _, piece, _ in ordinary if len(piece) == 1}
        # a chunk starts at a marker after other characters; no piece may lie across
        self.chunked = not any(re.search(f"[^{MARK}]{MARK}", piece) for _, piece, _ in ordinary)
        self.bytes_of = Known({i: piece.replace(MARK, " ").encode() for i, piece, _ in ordinary} | {i: bytes([b]) for b, i in byte_ids.items()})

    @classmethod
    def of(cls, ordinary: list[tuple[int, str, float]], byte_ids: dict[int, int]) -> Pieces:
        made = cls.__new__(cls)
        made._build(ordinary, byte_ids, 1000)
        return made

    def viterbi(self, chunk: str) -> list[int]:
        """ids of the best segmentation of a chunk.

        Every ``window`` characters the part on which all paths that can go on
        agree is settled, so a chunk without blanks holds no more than that.
        """
        if len(chunk) < self.window and self.single.issuperset(chunk):
            return self._covered(chunk)
        n, ids, base, done = len(chunk), [], 0, 0  # positions up to done are final, those before base are settled
        best, back = [0.0], [(0, 0)]

        def reach(at: int) -> None:
            short = at - base + 1 - len(best)
            if short > 0:
                best.extend([float("-inf")] * short)
                back.extend([(0, 0)] * short)

        def single(at: int) -> None:
            reach(at)
            if chunk[at - 1] not in self.single and best[at - 1 - base] + self.unknown > best[at - base]:
                best[at - base], back[at - base] = best[at - 1 - base] + self.unknown, (-1, 1)

        def path(at: int) -> list[int]:
            found: list[int] = []
            while at > base:
                i, length = back[at - base]
                found.extend([i] if i >= 0 else [self.byte_ids[x] for x in reversed(chunk[at - 1].encode("utf-8", "surrogatepass"))])
                at -= length
            return found[::-1]

        def settle() -> None:
            nonlocal base
            live = {at for at in range(max(base, done + 1 - self.longest), done + 1) if best[at - base] > float("-inf")}
            while len(live) > 1:
                at = max(live)
                live.remove(at)
                live.add(at - back[at - base][1])
            at = live.pop()
            ids.extend(path(at))
            del best[: at - base], back[: at - base]
            base = at

        for last, (i, length, score) in self.automaton.iter(chunk):
            end = last + 1
            while done < end - 1:
                done += 1
                single(done)
                if done - base >= self.window and done % self.window == 0:
                    settle()
            reach(end)
            value = best[end - length - base] + score
            if value > best[end - base]:
                best[end - base], back[end - base] = value, (i, length)
        while done < n:
            done += 1
            single(done)
        return ids + path(n)

    def _covered(self, chunk: str) -> list[int]:
        """As ``viterbi`` for a chunk of one window whose characters are all pieces: every position is reached, none by bytes."""
        best, back = [float("-inf")] * len(chunk) + [0.0], [(0, 0, 0.0)] * len(chunk)  # by the last character; the start is at -1
        for last, piece in self.automaton.iter(chunk):
            _, length, score = piece
            value = best[last - length] + score
            if value > best[last]:
                best[last] = value
                back[last] = piece
        at, found = len(chunk) - 1, []
        while at >= 0:
            i, length, _ = back[at]
            found.append(i)
            at -= length
        return found[::-1]

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.code.__getitem__, self.viterbi(chunk)))

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers; none for the empty text."""
        if not text:
            return b""
        own = [b"".join(self.byte_ids[b].to_bytes(4, "little") for b in MARK.encode())] if MARK in text else []
        out = []
        for k, part in enumerate(text.split(MARK)):
            part = part.replace(" ", MARK)
            if k:
                out += own
            else:
                part = MARK + part
            chunks = map(itemgetter(0), CHUNK.finditer(part)) if self.chunked else [part] if part else []
            out.append(b"".join(map(self.memo.__getitem__, chunks)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids, without the blank that encoding puts first; U+FFFD for unknown ids and for what is no UTF-8."""
        text = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""
        return text.removeprefix(b" ").decode("utf-8", "replace")


_kept: dict[str, Pieces] = {}


def pieces_of(model_file: str) -> Pieces:
    """One automaton per worker process."""
    if model_file not in _kept:
        _kept[model_file] = Pieces(model_file)
    return _kept[model_file]


def encode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (binary, little-endian unsigned 32-bit) of each row's whole text; null where the text is null."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = rows.select("doc_id", F.lit(None).cast("binary").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                ids = [None if t is None else pieces.encode(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """The columns of ``encoded`` and ``text`` from its ``ids``; null stays null."""
    rows = encoded.drop("text")
    schema = rows.select("*", F.lit(None).cast("string").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                yield b.append_column("text", pa.array([None if x is None else pieces.decode(x) for x in b.column("ids").to_pylist()], pa.string()))

    return rows.mapInArrow(run, schema)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document and decode it again: the crc32 of the ids and of the text that comes back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decode(encode(read_table(spark, sf_dir, "documents"), model), model)
    return back.select(
        "doc_id",
        (F.coalesce(F.octet_length("ids"), F.lit(0)) / 4).cast("long").alias("n_ids"),
        F.crc32(F.coalesce(F.col("ids"), F.lit(b""))).alias("ids_crc32"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
