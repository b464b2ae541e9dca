"""Sets of hashed word shingles, and their minhash signatures, in numpy."""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Words are what stands between these bytes: space, tab, line feed, vertical tab, form feed, return.
_SEPARATOR = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed at a time.
PIECE = 1 << 19


@lru_cache(maxsize=4)
def _ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(base))])) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of a multiplier modulo 2^64 and of its inverse."""
    return _ladder(max(2 * PIECE, 1 << (n - 1).bit_length()))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bytes_ = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)
    return bytes_, *powers(2 * PIECE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``data`` (up to PIECE bytes, or one long word) in order."""
    values = np.frombuffer(data, np.uint8)
    out = _SEPARATOR[values]
    edge = np.diff(np.concatenate([[True], out, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    bytes_, up, down = _powers()
    if len(values) > 2 * PIECE:  # one word longer than a piece: folded part by part
        return np.array([_long_word(data[s:e]) for s, e in zip(starts, ends, strict=True)], np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(bytes_[values] * up[: len(values)])])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _long_word(word: bytes) -> int:
    parts = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
    total = 0
    for part in parts:
        values = np.frombuffer(part, np.uint8)
        bytes_, up, _ = _powers()
        total = (total * 0xD6E8FEB86659FD93 + int((bytes_[values] * up[: len(values)]).sum(dtype=np.uint64)) + len(parts)) % (1 << 64)
    return total


def _runs(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, pieces) of about PIECE bytes; a longer text gives pieces cut between words."""
    numbers: list[int] = []
    pieces: list[bytes] = []
    held = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace").translate(_LOWER)
        at = 0
        while at < len(data):
            stop = at + PIECE
            if stop < len(data):
                cuts = [c for c in (data.rfind(s, at, stop) for s in b" \n\t\r\v\f") if c > at]
                while not cuts and stop < len(data) and not _SEPARATOR[data[stop]]:
                    stop += 1
                stop = max(cuts) if cuts else stop
            if held + stop - at > PIECE and pieces:
                yield numbers, pieces
                numbers, pieces, held = [], [], 0
            numbers.append(i)
            pieces.append(data[at:stop] + b" ")
            held += len(pieces[-1])
            at = stop
    if pieces:
        yield numbers, pieces


def word_lists(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words, A-Z lower-cased, in order."""
    words: list[list[np.ndarray]] = [[] for _ in texts]
    for numbers, pieces in _runs(texts):
        hashes = word_hashes(b"".join(pieces))
        if len(pieces) == 1:
            words[numbers[0]].append(hashes)
            continue
        bounds = np.cumsum([0, *(len(p) for p in pieces)])
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        gap = _SEPARATOR[flat]
        starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        at = np.searchsorted(starts, bounds)
        for k, i in enumerate(numbers):
            words[i].append(hashes[at[k] : at[k + 1]])
    return [parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint64), *parts]) for parts in words]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; a text with fewer words
    has its whole sequence as the only one, a text without words has none."""
    factors = np.random.default_rng(13).integers(0, 1 << 64, width, dtype=np.uint64) | np.uint64(1)
    out = []
    for w in word_lists(texts):
        n = len(w)
        if not n:
            out.append(w)
        elif n < width:
            out.append(mixed(np.array([(w * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64)))
        else:
            total = w[: n - width + 1] * factors[0]
            for j in range(1, width):
                total += w[j : n - width + 1 + j] * factors[j]
            out.append(np.unique(mixed(total)))
    return out


def signature(shingles: np.ndarray, symbols: int) -> np.ndarray:
    """``symbols`` 16-bit minhash symbols of a set that isn't empty."""
    rng = np.random.default_rng(17)
    times, plus = rng.integers(0, 1 << 64, symbols, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, symbols, dtype=np.uint64)
    least = np.full(symbols, np.uint64((1 << 64) - 1))
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * times + plus).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.int32)
