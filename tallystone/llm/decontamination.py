"""Benchmark decontamination by pigeonhole edit matching.

A passage within k edits of a test item leaves at least one of any k + 1 pieces of the item intact.
Each item is split into k + 1 pieces; one automaton finds all exact piece hits in a document; the
stretch of text that a hit points to is then verified with the bit-parallel edit distance of Myers,
so that every passage within the budget is found, at any place of a text of any length.

Both sides are compared as lower-case words with one space between, so case, punctuation and line
breaks cost no edits. Items are searched in blocks of bounded size, each a pass over the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.session import table

#: Edits allowed, as a share of an item's length.
ERROR_RATE = 0.08
#: Bytes of items in an automaton, about.
BLOCK_BYTES = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    words = _WORD.findall(text or "")
    return f" {' '.join(words).lower()} " if words else ""


def budget(item: str) -> int:
    """Edits allowed: the rate at every length, rounded down, so items under 13 characters must match."""
    return int(len(item) * ERROR_RATE)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(s, item[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, text: str, masks: dict[str, int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to any substring of ``text``, and where the first such ends.

    Myers' bit vectors: bit i of ``up`` / ``down`` says that the distance rises / falls from row i - 1
    to row i of the current column; a Python integer holds a column of any height.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        right = down | (full & ~(level | up))
        left = up & level
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right = (right << 1) & full
        left = (left << 1) & full
        up = left | (full & ~(vertical | right))
        down = right & vertical
        if distance < best:
            best, end = distance, at
    return best, end


def _masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """The items of one block, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, n) for i, n in ((i, normalised(t)) for i, t in items) if n]
        self.errors = [budget(n) for _, n in self.items]
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item, self.errors[k]):
                places.setdefault(piece, []).append((k, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, at)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item within its budget; the
        places are characters of the text as given."""
        words = normalised(text)
        if not words or not self.items:
            return []
        begins: dict[int, list[int]] = {}
        for end, hits in self.automaton.iter(words):
            for k, into in hits:
                begins.setdefault(k, []).append(end + 1 - into)
        out = []
        for k, at in begins.items():
            item_id, item = self.items[k]
            errors, m = self.errors[k], len(item)
            if errors == 0:
                out.append((item_id, 0, min(at), min(at) + m))
                continue
            at = sorted(set(at))
            spans: list[list[int]] = []
            for b in at:  # hits that point to overlapping stretches are verified once
                lo, hi = max(b - errors, 0), min(b + m + errors, len(words))
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
            if k not in self.masks:
                self.masks[k] = (_masks(item), _masks(item[::-1]))
            best, end = min((d, lo + e) for lo, hi in spans for d, e in [best_match(item, words[lo:hi], self.masks[k][0])])
            if best <= errors:
                lo = max(end - m - errors, 0)
                back = best_match(item[::-1], words[lo:end][::-1], self.masks[k][1])
                out.append((item_id, best, end - back[1], end))
        return [(i, d, *_original(text, words, s, e)) for i, d, s, e in out]


def _original(text: str, words: str, start: int, end: int) -> tuple[int, int]:
    """The characters of ``text`` of the words that words[start:end] touches."""
    first = words.count(" ", 0, start + 1) - (words[start] != " " if start < len(words) else 0)
    last = words.count(" ", 0, max(end - 1, 1))
    spots = [m.span() for m in _WORD.finditer(text)]
    first, last = min(max(first - (words[start] == " "), 0), len(spots) - 1), min(max(last - 1, 0), len(spots) - 1)
    return spots[first][0], spots[max(last, first)][1]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about ``block_bytes``; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes)
    for b in range(blocks):
        yield sorted((r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect())


def _matchers(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> Iterator:
    for block in item_blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # about block_bytes
        ready: list[Matcher] = []

        def matcher(sent=sent, ready=ready) -> Matcher:
            if not ready:
                ready.append(Matcher(sent.value))
            return ready[0]

        yield matcher


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, stop: the best match of each item in each row of ``docs``
    (doc_id, text; further columns ignored) that is within the item's budget.

    Null and empty texts match nothing; items without words are matched by nothing; items that share
    an id are searched on their own; equal rows give equal matches; an empty table of either kind
    gives no rows. Nothing is shuffled.
    """
    schema = "doc_id long, item_id long, distance int, start long, stop long"
    out = docs.sparkSession.createDataFrame([], schema)
    for matcher in _matchers(docs, benchmark, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            for batch in batches:
                found = [(d, *hit) for at in range(0, batch.num_rows, 512) for d, t in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True) for hit in matcher().find(t)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "stop"])

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(search, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (text; any further columns stay) in which no item is found; no shuffle."""
    for matcher in _matchers(docs, benchmark, block_bytes):
        place = docs.columns.index("text")

        def clean(batches: Iterator[pa.RecordBatch], matcher=matcher, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    piece = batch.slice(at, 512)
                    yield piece.filter(pa.array([not matcher().find(t) for t in piece.column(place).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
