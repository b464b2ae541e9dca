"""Byte-level pair encoding of texts of any length and shape."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

#: Fixed value: the public split pattern that belongs to the 50k byte-level vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary is broadcast; a larger file is refused.
MAX_VOCABULARY_BYTES = 32 << 20
#: Characters of a run that the split pattern is trusted with: its look-ahead walks back through a run of white space.
LONG_RUN = 1000
#: White space as the split pattern knows it, without the four separators that only Python counts.
_LONG_SPACE = re.compile(rf"[^\S\x1c-\x1f]{{{LONG_RUN},}}")
#: Characters of a text encoded at a time.
PIECE = 1 << 18
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file at ``path``, which the driver reads and broadcasts."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def entry_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable Latin-1 characters are
    themselves, the other bytes follow from 256 on in their order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def ranks_of_lines(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary in lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, data.splitlines()))}


def ranks_of_json(data: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level vocabulary with merges, without its special tokens.

    Ids stand for ranks, so the merges must make the tokens in the order of their ids.
    """
    told = json.loads(data)
    special, of = {t["id"] for t in told["added_tokens"] if t["special"]}, entry_bytes()
    model = told["model"]
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        raise ValueError("the merges are not in the order of the ids")
    return {bytes(of[c] for c in entry): i for entry, i in model["vocab"].items() if i not in special}


def _may_run(text: str) -> bool:
    """Whether a run of LONG_RUN spaces is possible: such a run covers one of the slices that are looked at."""
    half = LONG_RUN // 2
    return any(text[at : at + half].isspace() for at in range(half - 1, len(text), half))


class ByteEncoding:
    """Ids of texts under a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.ranks = ranks
        self._inner = tiktoken.Encoding("plain", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_ordinary(self, text: str) -> list[int]:
        """Long runs of white space go to the merges on their own.

        The pattern leaves the last character of such a run to what follows it, so the run is cut before
        that; before a run it always cuts. The ids are those of the whole text.
        """
        if not _may_run(text):
            return self._inner.encode_ordinary(text)
        ids: list[int] = []
        at = 0
        for run in _LONG_SPACE.finditer(text):
            stop = run.end() - (run.end() < len(text))
            ids += self._inner.encode_ordinary(text[at : run.start()])
            ids += self._inner._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + self._inner.encode_ordinary(text[at:])


def word_pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """A text in pieces of about ``most`` characters, cut only before a space between two letters of A to Z,
    where no token crosses. What has no such place stays whole."""
    at = 0
    while len(text) - at > most:
        cut = _BETWEEN_WORDS.search(text, at + most)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def line_encoding(data: bytes) -> ByteEncoding:
    return ByteEncoding(ranks_of_lines(data))


@lru_cache(maxsize=2)
def json_encoding(data: bytes) -> ByteEncoding:
    return ByteEncoding(ranks_of_json(data))
