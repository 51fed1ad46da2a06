"""Byte-level BPE ids of whole texts, one white-space-led chunk at a time.

The pre-tokeniser never joins a visible character with white space that
follows it, so a text can be cut there and each chunk be encoded on its own.
Words repeat, so the ids of recent chunks are kept as bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

CHUNK = re.compile(r"\s*\S+|\s+")
BREAK = re.compile(r"(?<=\S)(?=\s)")
SEGMENT_CHARS = 1 << 20


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Pieces of about ``size`` characters, cut only where a chunk ends."""
    at = 0
    while len(text) - at > size:
        m = BREAK.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class _Memo(dict):
    def __init__(self, rank_file: str, json_file: str, most: int) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_file)
        self.most = most

    def __missing__(self, chunk: str) -> bytes:
        if "<|" in chunk:  # may hold an added token
            ids = self.full.encode(chunk, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(chunk)
        found = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = found
        return found


_kept: dict[tuple[str, str], _Memo] = {}


class Encoder:
    """ids of a text as little-endian unsigned 32-bit integers.

    ``json_file`` defines the ids; ``rank_file`` holds the same vocabulary as
    ranks and serves chunks without added tokens. The memo holds at most
    ``most`` chunks of up to 64 characters and lives as long as the worker.
    """

    def __init__(self, json_file: str, rank_file: str, most: int = 150_000) -> None:
        key = (json_file, rank_file)
        if key not in _kept:
            _kept[key] = _Memo(rank_file, json_file, most)
        self.memo = _kept[key]

    def encode(self, text: str) -> bytes:
        get = self.memo.__getitem__
        return b"".join([b"".join(map(get, CHUNK.findall(x))) for x in segments(text)])
