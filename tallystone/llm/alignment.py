"""Alignment of two tokenizers over the same bytes.

Each text is encoded once by either, and the ids are written. The tokens of a whole Arrow batch then
stand behind one another, with the byte offset at which each document ends: the ends of A's and B's
tokens are counted by offset (bincount), and where both occur the text is cut into groups. Between two
successive ends of either kind lies one overlap of an A and a B token, so prefix sums over the counts
name the tokens of each link, and their differences at the documents' ends recover what belongs to each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.byte_pairs import json_encoding, read_vocabulary, word_pieces
from tallystone.session import table, written

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Byte offsets that are counted at a time, and characters encoded at a time.
WINDOW, PIECE = 1 << 18, 1 << 18
#: Id pairs whose counts every task holds at once, 17 bytes each; more of them take several passes.
MAX_PAIRS = 2_000_000
#: Pairs that a task gathers before it gives them on.
HELD_PAIRS = 1 << 20
_SPACE = "▁"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


@lru_cache(maxsize=2)
def _pieces(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_bytes(piece: str) -> bytes:
    """The bytes that a piece of B stands for."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(_SPACE, " ").encode()


@lru_cache(maxsize=2)
def token_bytes(a: bytes, b: bytes) -> tuple[list[bytes], list[bytes]]:
    """The bytes of every id of A and of B; an id that no token has is empty."""
    ranks, model = json_encoding(a).ranks, _pieces(b)
    of_a = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        of_a[i] = token
    return of_a, [piece_bytes(model.id_to_piece(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def _tables(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each id of A and B; each id in decimal with what follows it: A , | and B , ; or nothing."""
    sizes = [np.array([len(t) for t in side], np.int64) for side in token_bytes(a, b)]
    shown = [np.array([[f"{i}{end}".encode() for end in ends] for i in range(len(size))]) for size, ends in zip(sizes, ([",", "|"], [",", ";", ""]), strict=True)]
    return (*sizes, *shown)


def _id_type(a: bytes, b: bytes) -> str:
    """The narrowest type of ids, two or four bytes, that holds both vocabularies."""
    return "<u2" if max(map(len, token_bytes(a, b))) <= 1 << 16 else "<u4"


def _encoded(texts: list[str | None], a: bytes, b: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of space and text by A, of text by B; none where their bytes aren't those of space and text."""
    encode, model, (of_a, of_b) = json_encoding(a).encode_ordinary, _pieces(b), token_bytes(a, b)
    none = np.zeros(0, np.int64)
    left, right = [], []
    for text in texts:
        if not text:
            left.append(none)
            right.append(none)
            continue
        ids_a, ids_b, whole = [], [], True
        for piece in word_pieces(" " + text):
            # each piece begins with the space that B adds itself
            raw, now_a, now_b = piece.encode("utf-8", "replace"), encode(piece), model.encode(piece[1:])
            whole = whole and b"".join(map(of_a.__getitem__, now_a)) == raw == b"".join(map(of_b.__getitem__, now_b))
            ids_a.append(np.array(now_a, np.int64))
            ids_b.append(np.array(now_b, np.int64))
        left.append(np.concatenate(ids_a) if whole else none)
        right.append(np.concatenate(ids_b) if whole else none)
    return left, right


def encoded_documents(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """row (a number of its own), doc_id, a, b (little-endian ids of ``_id_type``) of each row of ``docs`` (doc_id, text).

    Written once: encoding is the dearest step, and all others read its ids.
    """
    spark = docs.sparkSession.sparkContext
    sent_a, sent_b = spark.broadcast(read_vocabulary(vocabulary_a)), spark.broadcast(read_vocabulary(vocabulary_b))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = _id_type(sent_a.value, sent_b.value)
            sizes = np.array([s or 0 for s in pc.binary_length(batch.column(2)).to_pylist()])
            bounds = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
            for lo, hi in zip([0, *bounds], [*bounds, batch.num_rows], strict=True):
                piece = batch.slice(lo, hi - lo)
                ids = _encoded(piece.column(2).to_pylist(), sent_a.value, sent_b.value)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array([x.astype(kind).tobytes() for x in side], pa.binary()) for side in ids)], names=["row", "doc_id", "a", "b"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(encode, "row long, doc_id long, a binary, b binary"), "align-tokens")


class _Batch:
    """The tokens of the documents of a batch, one behind the other; documents without tokens take no bytes."""

    def __init__(self, a: pa.Array, b: pa.Array, size_a: np.ndarray, size_b: np.ndarray, kind: str):
        ids = lambda column: [np.frombuffer(x.as_buffer() if x.is_valid else b"", kind) for x in column]
        each_a, each_b = ids(a), ids(b)
        self.n_a, self.n_b = np.array([len(x) for x in each_a], np.int64), np.array([len(x) for x in each_b], np.int64)
        self.a, self.b = (np.concatenate([np.zeros(0, kind), *each]).astype(np.int64) for each in (each_a, each_b))
        self.ends_a, self.ends_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        # where each document ends, in bytes
        self.stops = np.concatenate([[0], self.ends_a])[np.cumsum(self.n_a)]

    def windows(self) -> Iterator[_Window]:
        """Byte ranges of about WINDOW that end at a cut; a longer stretch without a cut is one range."""
        total = int(self.stops[-1]) if len(self.stops) else 0
        start = from_a = from_b = 0
        width = WINDOW
        while start < total:
            stop = min(start + width, total)
            to_a, to_b = (int(np.searchsorted(ends, stop, "right")) for ends in (self.ends_a, self.ends_b))
            at_a = np.bincount(self.ends_a[from_a:to_a] - start - 1, minlength=stop - start)
            at_b = np.bincount(self.ends_b[from_b:to_b] - start - 1, minlength=stop - start)
            both = np.flatnonzero((at_a > 0) & (at_b > 0))
            if not len(both):
                width *= 2
                continue
            size = int(both[-1]) + 1
            found = _Window(self, start, size, from_a, from_b, at_a[:size], at_b[:size], both)
            yield found
            start, from_a, from_b, width = start + size, found.to_a, found.to_b, WINDOW


class _Window:
    def __init__(self, batch: _Batch, start: int, size: int, from_a: int, from_b: int, at_a: np.ndarray, at_b: np.ndarray, cuts: np.ndarray):
        upto_a, upto_b = np.cumsum(at_a), np.cumsum(at_b)
        self.to_a, self.to_b = from_a + int(upto_a[-1]), from_b + int(upto_b[-1])
        self.a, self.b = batch.a[from_a : self.to_a], batch.b[from_b : self.to_b]
        #: offsets at which a link ends, and the groups' last offsets
        self.ends, self.cuts = np.flatnonzero(at_a + at_b), cuts
        self.link_a = self.a[(upto_a - at_a)[self.ends]]
        self.link_b = self.b[(upto_b - at_b)[self.ends]]
        # the documents that the window touches, and the offset after the last byte of each in it
        self.first = int(np.searchsorted(batch.stops, start, "right"))
        last = int(np.searchsorted(batch.stops, start + size, "left"))
        self.docs = slice(self.first, last + 1)
        self.bounds = np.minimum(batch.stops[self.docs] - start, size)
        self.closed = batch.stops[self.docs] <= start + size
        self._places = batch.ends_a[from_a : self.to_a] - start - 1, batch.ends_b[from_b : self.to_b] - start - 1

    def by_document(self, at: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """The number, or the sum of the values, of what ends at the offsets ``at``, for each document of the window."""
        upto = np.searchsorted(at, self.bounds - 1, "right")
        return np.diff(upto if values is None else np.concatenate([[0], np.cumsum(values)])[upto], prepend=0)

    def groups(self, shown_a: np.ndarray, shown_b: np.ndarray) -> list[bytes]:
        """Each document's groups in the window as text, ``;`` after each but a document's last."""
        place_a, place_b = self._places
        group_a, group_b = np.searchsorted(self.cuts, place_a, "left"), np.searchsorted(self.cuts, place_b, "left")
        ends_a = np.isin(place_a, self.cuts, assume_unique=True)
        ends_b = np.isin(place_b, self.cuts, assume_unique=True).astype(np.int64)
        ends_b[np.isin(place_b, self.bounds[self.closed] - 1)] = 2
        text = np.zeros(len(place_a) + len(place_b), f"S{max(shown_a.itemsize, shown_b.itemsize)}")
        text[np.arange(len(place_a)) + np.searchsorted(group_b, group_a, "left")] = shown_a[self.a, ends_a.astype(np.int64)]
        text[np.arange(len(place_b)) + np.searchsorted(group_a, group_b, "right")] = shown_b[self.b, ends_b]
        upto = np.concatenate([[0], np.searchsorted(place_a, self.bounds - 1, "right") + np.searchsorted(place_b, self.bounds - 1, "right")])
        return [text[lo:hi].tobytes().translate(None, b"\0") for lo, hi in zip(upto, upto[1:], strict=False)]


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose ids take some bytes together; a longer row is one slice."""
    sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("a")])
    bounds = np.flatnonzero(np.diff(sizes // WINDOW)) + 1
    for lo, hi in zip([0, *bounds], [*bounds, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def pair_counts(tokens: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """b, a, n: how many links of all documents hold each pair of ids; best: whether none of its b has more.

    Tasks add up what they meet before it is shuffled, so a common pair is a few rows a task.
    """
    spark = tokens.sparkSession.sparkContext
    sent_a, sent_b = spark.broadcast(read_vocabulary(vocabulary_a)), spark.broadcast(read_vocabulary(vocabulary_b))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b, *_ = _tables(sent_a.value, sent_b.value)
        kind = _id_type(sent_a.value, sent_b.value)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        more: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes // len(size_a), pa.int64()), pa.array(codes % len(size_a), pa.int64()), pa.array(counts, pa.int64())], names=["b", "a", "n"])

        for batch in batches:
            for rows in _slices(batch):
                for w in _Batch(rows.column("a"), rows.column("b"), size_a, size_b, kind).windows():
                    more.append(np.unique(w.link_b * len(size_a) + w.link_a, return_counts=True))
                    held += len(more[-1][0])
                    if held > HELD_PAIRS:
                        codes, counts = _summed(*(np.concatenate(x) for x in zip((codes, counts), *more, strict=True)))
                        more, held = [], 0
                        if len(codes) > HELD_PAIRS:
                            yield out()
                            codes, counts = codes[:0], counts[:0]
        codes, counts = _summed(*(np.concatenate(x) for x in zip((codes, counts), *more, strict=True)))
        yield out()

    pairs = written(tokens.select("a", "b").mapInArrow(count, "b long, a long, n long").groupBy("b", "a").agg(F.sum("n").alias("n")), "align-pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    return written(pairs.join(most, "b").select("b", "a", "n", (F.col("n") == F.col("most")).alias("best")), "align-counted")


def _ranges(pairs: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of b (from, before) with at most ``most`` pairs each, or one b: a row per id of B's vocabulary comes to the driver."""
    ranges, held = [], 0
    for r in pairs.groupBy("b").count().orderBy("b").collect():
        if not ranges or held + r["count"] > most:
            ranges.append((r["b"], r["b"] + 1))
            held = 0
        ranges[-1], held = (ranges[-1][0], r["b"] + 1), held + r["count"]
    return ranges


def align_tokens(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """How A (a byte-level vocabulary with merges) and B (a model of pieces) cut each text of ``docs`` (doc_id, text).

    A encodes a space and the text, B the text, before which it adds the space; special tokens are
    plain text. Further columns are ignored. Null and empty texts, and texts whose tokens don't give
    back their bytes, have no tokens. Long texts are encoded in pieces between words and aligned in
    ranges of bytes; their whole ids are one value. Repeated rows count as often as they occur; an
    empty table gives none.

    The counts of up to ``max_pairs`` id pairs (counted first) are broadcast; of more pairs, ranges of
    B's ids take a pass each over the written ids, and the passes are summed by row.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (text: ``a1,a2|b1;a3|b2``).
    """
    spark = docs.sparkSession.sparkContext
    tokens = encoded_documents(docs, vocabulary_a, vocabulary_b)
    pairs = pair_counts(tokens, vocabulary_a, vocabulary_b)
    sent_a, sent_b = spark.broadcast(read_vocabulary(vocabulary_a)), spark.broadcast(read_vocabulary(vocabulary_b))
    ranges = [(0, 1 << 32)] if pairs.limit(max_pairs + 1).count() <= max_pairs else _ranges(pairs, max_pairs)

    def one_pass(lo: int, hi: int, first: bool) -> DataFrame:
        rows = pairs.filter((F.col("b") >= lo) & (F.col("b") < hi)).orderBy("b", "a").toArrow()
        known = [rows.column(c).to_numpy() for c in ("b", "a", "n", "best")]
        sent = spark.broadcast([x.astype(kind) for x, kind in zip(known, ("<u4", "<u4", "<i8", "?"), strict=True)])

        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size_a, size_b, shown_a, shown_b = _tables(sent_a.value, sent_b.value)
            kind = _id_type(sent_a.value, sent_b.value)
            b, a, n, best = sent.value
            # a last entry that no link has, for searches that run past the end
            codes = np.append(b.astype(np.int64) * len(size_a) + a, np.iinfo(np.int64).max)
            n, best = np.append(n, 0), np.append(best, False)
            for batch in batches:
                for rows in _slices(batch):
                    all_ = _Batch(rows.column("a"), rows.column("b"), size_a, size_b, kind)
                    sums = np.zeros((4, rows.num_rows), np.int64)
                    groups: list[list[bytes]] = [[] for _ in range(rows.num_rows)]
                    for w in all_.windows():
                        links, at = np.unique(w.link_b * len(size_a) + w.link_a, return_inverse=True)
                        place = np.searchsorted(codes, links)
                        hit = codes[place] == links
                        sums[2, w.docs] += w.by_document(w.ends, (best[place] & hit)[at].astype(np.int64))
                        sums[3, w.docs] += w.by_document(w.ends, (n[place] * hit)[at])
                        if first:
                            sums[0, w.docs] += w.by_document(w.cuts)
                            sums[1, w.docs] += w.by_document(w.ends)
                            for k, text in enumerate(w.groups(shown_a, shown_b), w.first):
                                groups[k].append(text)
                    shown = pa.array([b"".join(g) for g in groups] if first else [None] * len(groups), pa.binary()).cast(pa.string())
                    n_a, n_b = (all_.n_a, all_.n_b) if first else (sums[0], sums[1])
                    yield pa.RecordBatch.from_arrays([rows.column("row"), rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_a, n_b, *sums)), shown], names=["row", "doc_id", *SUMS, "groups"])

        return tokens.mapInArrow(align, "row long, doc_id long, " + ", ".join(f"{c} long" for c in SUMS) + ", groups string")

    passes = [one_pass(lo, hi, k == 0) for k, (lo, hi) in enumerate(ranges)]
    if len(passes) == 1:
        return passes[0].drop("row")
    sums = [p.select("row", "n_best", "count_sum") for p in passes]
    added = sums[0]
    for more in sums[1:]:
        added = added.union(more)
    added = added.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return passes[0].drop("n_best", "count_sum").join(added, "row").select("doc_id", *SUMS, "groups")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(table(spark, sf_dir, "documents"))
    return out.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))).drop("groups")
