"""Near-duplicates by minhash signatures under a multi-index Hamming join.

A signature is SYMBOLS minhash symbols of 16 bits, cut into CHUNKS. Two signatures that differ in at
most CHUNKS * (ERRORS + 1) - 1 symbols agree in some chunk up to ERRORS symbols, by pigeonhole; so
each chunk is filed under every choice of ERRORS symbols left out, and all pairs within that distance
(19 of 50) meet under some key. Pairs that meet are confirmed on their full shingle sets (sets of 64-bit
hashes of shingles). A pair at a similarity of exactly 0.8 is missed with a probability of 1.6e-6 because
it never meets, 2e-9 because it is further apart than FARTHEST, 1e-9 by its sketch; a closer one less.

No key lists its pairs. The least document of a key is compared with each of the others first, which
settles groups of copies; only keys that still hold several components are compared throughout, in
cells of bounded size. There a pair counts under the first key that it shares alone, and a sketch (the
SKETCH least hashes of a set, all of a smaller one) settles most pairs that are close, but not enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.llm.components import connected_components
from tallystone.llm.shingles import shingle_sets, signature
from tallystone.llm.sized import semi_or_anti, shuffled
from tallystone.session import table, written

CHUNKS, CHUNK_SYMBOLS, ERRORS = 10, 5, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Pairs further apart than this are not confirmed, well beyond the distance that is guaranteed to meet.
FARTHEST = 30
#: Members of a key that one cell compares with as many others.
CELL = 256
_SETS_AT_ONCE = 256
#: Hashes in a sketch, and how many standard deviations below the threshold its estimate may lie.
SKETCH, DEVIATIONS = 256, 6
#: Places of a signature that each key of a document takes in.
KEYS = tuple(kept for c in range(CHUNKS) for kept in combinations(range(c * CHUNK_SYMBOLS, (c + 1) * CHUNK_SYMBOLS), CHUNK_SYMBOLS - ERRORS))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SETS_AT_ONCE):
                piece = batch.slice(at, _SETS_AT_ONCE)
                sets = shingle_sets(piece.column(1).to_pylist(), width)
                digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                symbols = [signature(s, SYMBOLS) if len(s) else None for s in sets]
                sketches = [(s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(symbols, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n_shingles", "set_digest", "symbols", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, "doc_id long, n_shingles long, set_digest binary, symbols array<int>, sketch binary")


def _keys() -> Column:
    return F.posexplode(F.array(*[F.xxhash64(F.lit(n), *[F.col("symbols")[k] for k in kept]) for n, kept in enumerate(KEYS)]))


def _near(threshold: int) -> Column:
    """Whether the sizes and symbols of a pair (columns a_*, b_*) leave the threshold possible."""
    apart = F.aggregate(F.zip_with("a_symbols", "b_symbols", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    return (small * 100 >= large * threshold) & (apart <= FARTHEST)


def _with_signatures(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda p: shuffled(sets.select(F.col("doc_id").alias(p), F.col("n_shingles").alias(f"{p}_n"), F.col("symbols").alias(f"{p}_symbols")))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose full sets reach the threshold.

    The pairs of one ``a`` go to as many groups as their number asks for, each with one copy of its
    text, so a group holds a bounded number of texts.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    dealt = pairs.join(shuffled(sizes), "a").withColumn("cell", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int"))
    others = dealt.join(shuffled(texts.withColumnRenamed("doc_id", "b")), "b").select("a", "cell", "b", "text")
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")).join(shuffled(texts.withColumnRenamed("doc_id", "a")), "a").select("a", "cell", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.union(others).repartition("a", "cell").sortWithinPartitions("a", "cell", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heads_of = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, _SETS_AT_ONCE):
                piece = batch.slice(at, _SETS_AT_ONCE)
                a, cell, b, text = (c.to_pylist() for c in piece.columns)
                left, right = [], []
                for i, s in enumerate(shingle_sets(text, width)):
                    if (a[i], cell[i]) != group:
                        group, heads_of = (a[i], cell[i]), []
                    if b[i] is None:
                        heads_of.append(s)
                        continue
                    for head in heads_of:
                        common = len(np.intersect1d(head, s, assume_unique=True))
                        if 100 * common >= threshold * (len(head) + len(s) - common):
                            left.append(a[i])
                            right.append(b[i])
                            break
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _alike(sketches: np.ndarray, n: np.ndarray, one: int, others: np.ndarray, threshold: int) -> np.ndarray:
    """Which of ``others`` the sketch of ``one`` leaves possible: up to the end of the shorter of two
    sketches that were cut, both show all their sets have; uncut sketches show all there is."""
    ends = np.where(n > SKETCH, sketches[:, -1], 1 << 39)
    upto = np.minimum(ends[others], ends[one])[:, None]
    mine, rows = sketches[one], sketches[others]
    common = ((mine[np.minimum(np.searchsorted(mine, rows), SKETCH - 1)] == rows) & (rows <= upto)).sum(1)
    union = (rows <= upto).sum(1) + (mine <= upto).sum(1) - common
    share = threshold / 100
    cut = upto[:, 0] < 1 << 39
    return common + 1 >= union * (share - cut * DEVIATIONS * (share * (1 - share) / SKETCH) ** 0.5)


def _cross_pairs(members: DataFrame, sets: DataFrame, signed: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components under keys that hold several, near enough by signature and sketch.

    ``members``: key, slot, doc_id, component. A key's members are dealt to blocks of about CELL; each
    pair of blocks is a cell, compared at once; only near pairs leave it, each under one key.
    """
    keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("n > 2 and lo < hi").select("key", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    mixed = written(members.join(shuffled(keys), "key"), "near-mixed")
    # an id that stands for several sets is shown with each of them; of rows with equal id and set, one
    sketches = signed.select("doc_id", "set_digest", "sketch").dropDuplicates(["doc_id", "set_digest"])
    shown = sets.join(shuffled(mixed.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "set_digest", "n_shingles", "symbols").join(shuffled(sketches), ["doc_id", "set_digest"]).drop("set_digest")
    spread = (
        mixed.join(shuffled(written(shown, "near-shown")), "doc_id")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "slot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "component", "n_shingles", "symbols", "sketch")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
    )

    kept_by_key = np.array([[place in kept for place in range(SYMBOLS)] for kept in KEYS], np.float32)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            doc, comp, n = (cell.column(k).to_numpy() for k in ("doc_id", "component", "n_shingles"))
            symbols = cell.column("symbols").combine_chunks().flatten().to_numpy().reshape(len(doc), SYMBOLS)
            i, j, block, slot = (cell.column(k).to_numpy() for k in ("i", "j", "block", "slot"))
            sketches = np.full((len(doc), SKETCH), 1 << 40)
            for r, sketch in enumerate(cell.column("sketch").to_pylist()):
                sketches[r, : len(sketch) // 4] = np.frombuffer(sketch, "<u4")
            found = []
            for r in range(len(doc)):
                ok = (doc > doc[r]) & (comp != comp[r]) & ((i[r] == j[r]) | (block != block[r]))
                ok &= np.minimum(n, n[r]) * 100 >= np.maximum(n, n[r]) * threshold
                at = np.flatnonzero(ok)
                same = symbols[at] == symbols[r]
                near = SYMBOLS - same.sum(1) <= FARTHEST
                at, same = at[near], same[near]
                first = (same.astype(np.float32) @ kept_by_key.T == CHUNK_SYMBOLS - ERRORS).argmax(1) == slot[r]
                at = at[first]
                at = at[_alike(sketches, n, r, at, threshold)]
                found.append((np.full(len(at), doc[r]), doc[at]))
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))

        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key = np.stack([held.column(k).to_numpy() for k in ("key", "i", "j")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            bounds = [0, *cuts.tolist()]
            out = [pairs(held.slice(s, e - s)) for s, e in zip(bounds, bounds[1:], strict=False)]
            held = held.slice(bounds[-1])
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if held is not None and held.num_rows:
            a, b = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return spread.mapInArrow(cells, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """The near-duplicate component of each row of ``docs`` (doc_id, text; further columns ignored).

    Documents link when 100 * |intersection| >= ``threshold`` * |union| of their sets of shingles of
    ``width`` words (A-Z lower-cased, words cut at ASCII white space). A document without words links
    with nothing and is its own component. Rows that share a doc_id are one document that links by
    any of its texts; rows with a null id get a null component. An empty table gives none.

    Returns doc_id, n_shingles, component_id (the least doc_id that it reaches), kept.
    """
    signed = written(_signed(docs, width), "near-signed")
    # equal sets are one node from here on
    sets = written(signed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("symbols").alias("symbols")), "near-sets")
    same_id = signed.filter("n_shingles > 0").select(F.col("doc_id").alias("b"), "set_digest").join(shuffled(sets.select(F.col("doc_id").alias("a"), "set_digest")), "set_digest").select("a", "b").filter("a <> b")
    filed = sets.select("doc_id", _keys().alias("slot", "key"))

    heads = filed.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1")
    # most keys are one document's: what goes on is small
    shared = written(filed.join(shuffled(heads), "key").select("key", "slot", "a", "doc_id"), "near-keys")
    stars = shared.select("a", F.col("doc_id").alias("b")).filter("a <> b").distinct()
    stars = written(_with_signatures(stars, sets).filter(_near(threshold)).select("a", "b").distinct(), "near-stars")

    # one node of equal sets may stand for several ids; its own text is enough
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def texts(pairs: DataFrame) -> DataFrame:
        ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "near-ids")
        return written(semi_or_anti(words, ids, ["doc_id"], "left_semi"), "near-texts")

    linked = written(_confirmed(stars, texts(stars), width, threshold), "near-linked")
    first = written(connected_components(linked), "near-components")

    members = shared.join(shuffled(first.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("key", "slot", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    rest = written(_cross_pairs(members, sets, signed, threshold), "near-rest")
    more = written(_confirmed(rest, texts(rest), width, threshold), "near-linked")
    several = signed.filter("n_shingles > 0").groupBy("doc_id").agg(F.count_distinct("set_digest").alias("d")).filter("d > 1").select(F.col("doc_id").alias("b"))
    whole = connected_components(linked.union(more).union(same_id.join(shuffled(several), "b", "left_semi").select("a", "b")))

    nodes = sets.select("set_digest", F.col("doc_id").alias("node")).join(shuffled(whole), "node", "left").select("set_digest", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "set_digest").join(shuffled(nodes), "set_digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of ``docs`` (doc_id, text; all columns stay) of each near-duplicate group: the one
    with the least doc_id. Of its rows that repeat id and text one stays, rows that share only the id
    all stay, and so do rows with a null id."""
    kept = near_duplicates(docs, width, threshold).filter("kept and doc_id is not null").select("doc_id").distinct()
    hashed = F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind])
    first = F.row_number().over(Window.partitionBy("doc_id", "row.text").orderBy(hashed))
    rows = docs.filter("doc_id is not null").select("doc_id", F.struct("*").alias("row")).join(kept, "doc_id", "left_semi")
    # the window uses the join's partitions; the row is one column, so no name can clash
    named = rows.withColumn("n", first).filter("n = 1").select("row.*")
    return named.unionByName(docs.filter("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=80)


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t),
d AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a WHERE r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
