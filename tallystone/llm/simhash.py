"""Near-duplicates by simhash fingerprints under an inverted index of byte positions with count filtering.

A fingerprint is eight bytes. Two that differ in at most DISTANCE = 4 bits differ in at most four bytes,
so they share at least four: the guaranteed minimum of matches. The index files a fingerprint under each
(position, byte) it has. Of the positions that a pair shares, the first is one of the first five, so
those lists are enough, and a pair is dealt with only under the list of the first position it shares.
In a list, shared positional bytes are tallied for each pair; pairs that reach the minimum are verified
by their differing bits.

A list with more than LIST_MOST members is not tallied but intersected with the lists of the positions
after it, under which a pair comes by the second position it shares, and so on: the length of the lists
stays bounded as the corpus grows. A list of four positions and bytes has reached the minimum; if it is
still long, it is cut into blocks that are compared in cells of two. Cells return what links their
members as a forest, never all pairs.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.components import connected_components
from tallystone.llm.sized import semi_or_anti
from tallystone.session import table, written

DISTANCE, POSITIONS = 4, 8
MATCHES = POSITIONS - DISTANCE
SEED = 42
LIST_MOST = 128
#: Members of a block of a list that can't be cut further.
CELL = 2048
#: Keys that a filter holds; more of them are joined.
FILTER_KEYS = 2000
#: Bytes of a text that are cut into words at a time, and links held before they become a forest.
PIECE, LINKS = 1 << 20, 1 << 20
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: By place in the tuple: the positions of the lists of 1, 2, 3 and 4 positions. A pair with MATCHES shared positions leaves room for those that follow.
LISTS = tuple(tuple(combinations(range(POSITIONS - MATCHES + depth), depth)) for depth in range(1, MATCHES + 1))
#: By set of shared positions (as bits, position 0 first): how many there are, and the list of the first 1 to 4 of them (-1: too few).
_SHARED = [[p for p in range(POSITIONS) if mask >> (POSITIONS - 1 - p) & 1] for mask in range(1 << POSITIONS)]
_TALLY = np.array([len(s) for s in _SHARED])
_FIRST = [np.array([LISTS[d].index(tuple(s[: d + 1])) if len(s) >= MATCHES else -1 for s in _SHARED]) for d in range(MATCHES)]
#: Which bits each byte value has, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _word_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some PIECE bytes of it at a time; a piece ends between words."""
    data = (text or "").encode("utf-8", "replace").translate(_LOWER)
    at = 0
    while at < len(data):
        stop = at + PIECE
        while stop < len(data) and data[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield data[at:stop].split()
        at = stop


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """The 64-bit simhash of a text's shingles of ``width`` words: a bit is 1 if over half of their hashes have it."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    counts, n, tail = np.zeros(64, np.int64), 0, []
    for piece in _word_pieces(text):
        words = tail + piece
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate([[0], ends[: len(words) - width] + 1])
            hashes = np.array([hashed(joined[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], ">u8")
            octets = hashes.view(np.uint8).reshape(-1, 8)
            counts += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
            n += len(hashes)
        tail = words[-(width - 1) :] if width > 1 else []
    if not n:
        return hashed(b" ".join(tail), seed) if tail else 0
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (a signed 64-bit number) of each row of ``docs`` (doc_id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, fingerprint long")


#: By number of a list and position: the number of the list that the position extends it to (-1: none).
_EXTENDED = [[[LISTS[d].index((*places, p)) if (*places, p) in LISTS[d] else -1 for p in range(POSITIONS)] for places in (LISTS[d - 1] if d else [()])] for d in range(MATCHES)]


def _extended(filed: DataFrame, depth: int) -> DataFrame:
    """fingerprint, list, key: every member of the lists ``filed`` of ``depth`` - 1 under each list that has one position more.

    A key is the list's number above the bytes that it holds.
    """
    numbers = F.array(*[F.lit(n) for row in _EXTENDED[depth - 1] for n in row])
    held = 8 * (depth - 1)
    octets = F.col("key").bitwiseAND((1 << held) - 1)
    further = filed.select("fingerprint", octets.alias("octets"), F.slice(numbers, F.col("list") * POSITIONS + 1, POSITIONS).alias("numbers"))
    each = further.select("fingerprint", "octets", F.posexplode("numbers").alias("place", "list")).filter("list >= 0")
    octet = F.expr(f"shiftrightunsigned(fingerprint, 8 * ({POSITIONS - 1} - place))").bitwiseAND(255)
    key = F.shiftleft(F.col("list").cast("long"), held + 8).bitwiseOR(F.shiftleft("octets", 8)).bitwiseOR(octet)
    return each.select("fingerprint", "list", key.alias("key"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links a-b: each node but the least of a component, with the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(least[left], least[right])
        now = least.copy()
        for side in (left, right):
            np.minimum.at(now, side, low)
            np.minimum.at(now, least[side], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == least).all():
            break
        least = now
    other = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[least[other]], nodes[other]


def _near_in_runs(prints: np.ndarray, ends: np.ndarray, lists: np.ndarray, part: np.ndarray, depth: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between the members of a run (rows up to ``ends``), each pair tallied once and verified.

    ``part``: 0 for rows of a cell of one block; 1 and 2 where only pairs of different blocks count.
    """
    at, step, blocks = np.arange(len(prints)), 1, part.any()
    while len(at := at[at + step < ends[at]]):
        one = at[(part[at] == 0) | (part[at] != part[at + step])] if blocks else at
        other = one + step
        differ = prints[one] ^ prints[other]
        shared = np.packbits(differ.view(np.uint8).reshape(-1, 8)[:, ::-1] == 0, axis=1)[:, 0]
        enough = (_TALLY[shared] >= MATCHES) & (_FIRST[depth - 1][shared] == lists[one])
        near = enough.copy()
        near[enough] = np.bitwise_count(differ[enough]) <= distance
        if near.any():
            yield prints[one[near]], prints[other[near]]
        step += 1


def _links(rows: DataFrame, depth: int, distance: int) -> DataFrame:
    """``rows``: key, i, j (the cell's blocks), list, block, fingerprint. a, b: links, as a forest of each task's share."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            a, b = forest(np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.uint64),) * 2
            left.clear()
            right.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64), pa.int64()), pa.array(b.view(np.int64), pa.int64())], names=["a", "b"])

        def runs(cells: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, lists, block, prints = (cells.column(k).to_numpy() for k in ("key", "i", "j", "list", "block", "fingerprint"))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            bounds = np.concatenate([[0], edges, [len(key)]])
            ends = np.repeat(bounds[1:], np.diff(bounds))
            part = np.where(i == j, 0, 1 + (block == j))
            for a, b in _near_in_runs(prints.view(np.uint64), ends, lists, part, depth, distance):
                left.append(a)
                right.append(b)
                if sum(map(len, left)) > LINKS:
                    a, b = forest(np.concatenate(left), np.concatenate(right))
                    left[:], right[:] = [a], [b]
                    if len(a) > LINKS // 2:
                        yield out()

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            cell = [held.column(k).to_numpy() for k in ("key", "i", "j")]
            same = np.logical_and.reduce([c == c[-1] for c in cell])
            open_ = len(same) - int(same[::-1].argmin()) if not same.all() else 0
            if open_:
                yield from runs(held.slice(0, open_))
                held = held.slice(open_)
        if held is not None and held.num_rows:
            yield from runs(held)
        yield out()

    cells = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.select("key", "i", "j", "list", "block", "fingerprint").mapInArrow(compare, "a long, b long")


def _of_lists(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``rows`` whose key is (``left_semi``) or isn't (``left_anti``) that of one of ``lists``; a few keys are a plain filter."""
    few = [r["key"] for r in lists.select("key").limit(FILTER_KEYS + 1).collect()]
    if len(few) > FILTER_KEYS:
        return semi_or_anti(rows, lists.select("key"), ["key"], how)
    hit = F.col("key").isin(few)
    return rows.filter(hit if how == "left_semi" else ~hit)


def fingerprint_links(nodes: DataFrame, distance: int = DISTANCE, list_most: int = LIST_MOST, cell: int = CELL) -> DataFrame:
    """a, b: links that join what the pairs of ``nodes`` (fingerprint, distinct) within ``distance`` bits join.

    Any distance up to DISTANCE is exact: fewer differing bits leave as many shared bytes at least.
    """
    if distance > DISTANCE:
        raise ValueError(f"at most {DISTANCE} differing bits guarantee {MATCHES} shared bytes")
    found, filed = [], nodes.select("fingerprint", F.lit(0).alias("list"), F.lit(0).cast("long").alias("key"))
    n = nodes.count()
    for depth in range(1, MATCHES + 1):
        filed = _extended(filed, depth)
        if n >> 8 * depth > list_most and depth < MATCHES:
            continue  # lists that are long on average needn't be counted
        filed = written(filed, "simhash-postings")
        long_lists = written(filed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > list_most), "simhash-long")
        alone = F.lit(0)
        short = _of_lists(filed, long_lists, "left_anti").select("key", "list", "fingerprint", alone.alias("i"), alone.alias("j"), alone.alias("block"))
        found.append(written(_links(short, depth, distance), "simhash-links"))
        if long_lists.isEmpty():
            break
        if depth < MATCHES:
            filed = _of_lists(filed, long_lists, "left_semi")
    else:
        sized = long_lists.select(F.col("key").alias("_key"), F.ceil(F.col("n") / cell).cast("int").alias("blocks"))
        dealt = filed.join(sized, filed["key"] == F.col("_key")).withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
        spread = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = spread.select("key", "list", "fingerprint", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block")
        found.append(written(_links(cells, MATCHES, distance), "simhash-links"))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = DISTANCE, seed: int = SEED, **options: int) -> DataFrame:
    """The component of each row of ``docs`` (doc_id, text; further columns ignored) under close fingerprints.

    Words are what ASCII white space parts, A-Z lower-cased; each occurrence of a shingle of ``width``
    words votes with its XXH64. A text with fewer words has its whole sequence as the only shingle, one
    without words (null and empty ones too) the fingerprint zero, which links like any other. Texts are
    hashed whole, a piece at a time. Rows that share a doc_id link on their own; rows with a null id
    link others but name no component (a component of such rows alone is null). An empty table gives none.

    Returns doc_id, fingerprint (signed 64-bit), component_id (the least doc_id that it reaches).
    """
    signed = written(fingerprints(docs, width, seed), "simhash-signed")
    # equal fingerprints are one node from here on
    nodes = written(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    joined = connected_components(fingerprint_links(nodes.select("fingerprint"), distance, **options))
    whole = nodes.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    whole = written(whole, "simhash-components")
    # written, so that the joins below have sides of their own and Spark can split a common key
    named = written(whole.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-names")
    by_print = written(whole.join(named, "component").select("fingerprint", "component_id"), "simhash-named")
    return signed.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))
