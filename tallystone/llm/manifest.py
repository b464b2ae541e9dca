"""A Merkle manifest of a table: a digest of every row, of every group and of the whole, with proofs.

The rows of a group are the leaves of a tree in which every ARITY consecutive nodes become one. It is
built by blocks of ARITY ** HEIGHT aligned nodes: one recursive traversal in postorder returns the
digest of a block and, on its way back, appends to each leaf below the siblings met at that level. The
roots of the blocks are the nodes of the next such traversal, until a group has one root; the groups'
roots then go the same way to the root of the table.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystone.session import table, written

ARITY, HEIGHT = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32


def row_digest(columns: Sequence[Column]) -> Column:
    """SHA-256, as lowercase hex, of the columns' values: ``-`` for null, else byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def block_traversal(leaves: Sequence[str], levels: int, arity: int = ARITY) -> tuple[str, list[list[int]], list[list[bytes]]]:
    """The digest of the block and, by leaf, its place among its run and the run's others, level by level."""
    places: list[list[int]] = [[] for _ in leaves]
    siblings: list[list[bytes]] = [[] for _ in leaves]

    def visit(start: int, level: int) -> str:
        if not level:
            return leaves[start]
        span = arity ** (level - 1)
        stop = min(start + span * arity, len(leaves))
        run = [visit(child, level - 1) for child in range(start, stop, span)]
        raw = [bytes.fromhex(digest) for digest in run]
        for place in range(len(run)):
            others = b"".join(raw[:place] + raw[place + 1 :])
            first = start + place * span
            for leaf in range(first, min(first + span, stop)):
                places[leaf].append(place)
                siblings[leaf].append(others)
        return sha256("".join(run).encode()).hexdigest()

    return visit(0, levels), places, siblings


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0) by ``order`` in their group ``grp`` and ``size``, the group's rows.

    A range sort over all groups; what its partitions hold of each group gives a partition its first rank.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last key parts rows that are alike, so that many of them share no task; the order of such rows doesn't matter
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions, "grp", *order, "tie")
    # written before it is numbered: a retried task can't see other range bounds
    placed = written(ranged.withColumn("part", F.spark_partition_id()), name)
    of_group = Window.partitionBy("grp")
    counts = placed.groupBy("part", "grp").agg(F.count("*").alias("n"))
    earlier = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("part").alias("_part"), F.col("grp").alias("_grp"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(of_group).alias("size"))
    inside = F.row_number().over(Window.partitionBy("part", "grp").orderBy(*order, "tie"))
    joined = placed.withColumn("inside", inside).join(starts, (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp")))
    return joined.withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "tie", "_part", "_grp", "before", "inside")


def _traversed(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """Each row of ``nodes`` (grp, rank, size, digest) with its block, the block's root and its path in the block."""
    span = arity**height

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(rows: pa.Table, last: bool) -> Iterator[tuple[pa.RecordBatch | None, pa.Table]]:
            ranks, sizes = rows.column("rank").to_pylist(), rows.column("size").to_pylist()
            at = 0
            while at < len(ranks):
                n = min(span, sizes[at] - ranks[at])
                if at + n > len(ranks):
                    break
                part = rows.slice(at, n)
                levels = 0
                while levels < height and arity**levels < sizes[at]:
                    levels += 1
                root, places, siblings = block_traversal([d.hex() for d in part.column("digest").to_pylist()], levels, arity)
                yield (
                    pa.RecordBatch.from_arrays(
                        [part.column("grp").combine_chunks(), part.column("rank").combine_chunks(), pa.array([ranks[at] // span] * n, pa.int64()), pa.array([-(-sizes[at] // arity**levels)] * n, pa.int64()),
                         pa.array([bytes.fromhex(root)] * n, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(siblings, pa.list_(pa.binary()))],
                        names=["grp", "rank", "block", "blocks", "block_root", "places", "siblings"],
                    ),
                    rows,
                )
                at += n
            assert not last or at == len(ranks), "a block is incomplete"
            yield None, rows.slice(at)

        for batch in batches:
            held.append(batch)
            for out, rest in blocks(pa.Table.from_batches(held), last=False):
                if out is not None:
                    yield out
            held = rest.to_batches()
        if held:
            for out, _ in blocks(pa.Table.from_batches(held), last=True):
                if out is not None:
                    yield out

    block = F.floor(F.col("rank") / span)
    kind = dict(nodes.dtypes)["grp"]
    rows = nodes.select("grp", "rank", "size", "digest").repartition("grp", block).sortWithinPartitions("grp", "rank")
    return rows.mapInArrow(traverse, f"grp {kind}, rank long, block long, blocks long, block_root binary, places array<int>, siblings array<binary>")


def _trees(nodes: DataFrame, arity: int, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The traversals from ``nodes`` (grp, rank, size, digest) up, and grp, digest of every group's root."""
    passes, span = [], arity**height
    while True:
        done = written(_traversed(nodes, arity, height), name)
        passes.append(done)
        above = done.filter(F.col("rank") % span == 0)
        nodes = above.select("grp", F.col("block").alias("rank"), F.col("blocks").alias("size"), F.col("block_root").alias("digest"))
        if (nodes.agg(F.max("size")).first()[0] or 0) <= 1:
            return passes, nodes.select("grp", "digest")


def _paths(passes: list[DataFrame], top: DataFrame) -> DataFrame:
    """grp, rank, places, siblings and what ``top`` (grp, places, siblings, ...) adds, from the leaf to the top."""
    more = [c for c in top.columns if c not in ("grp", "places", "siblings")]
    above = top.withColumn("rank", F.lit(0).cast("long"))
    for step in reversed(passes):
        up = above.select(F.col("grp").alias("_grp"), F.col("rank").alias("_rank"), F.col("places").alias("_places"), F.col("siblings").alias("_siblings"), *more)
        joined = step.join(up, step["grp"].eqNullSafe(F.col("_grp")) & (step["block"] == F.col("_rank")))
        above = joined.select("grp", "rank", F.concat("places", "_places").alias("places"), F.concat("siblings", "_siblings").alias("siblings"), *more)
    return above


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", order: str = "doc_id", altered: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """The proof of each row of ``docs``: a tree over the rows of each ``group`` by ``order``, and one over the groups.

    A leaf is ``row_digest`` of ``columns``; further columns are ignored. While several nodes remain,
    every ``arity`` consecutive ones, the last run as many as are left, become the digest of their hex
    digests; a single leaf is its group's root. Groups ascend with null first, bytewise; rows ascend by
    ``order`` with null first, rows that share it by their digest (equal rows have equal proofs up to
    places among themselves). Null and empty values differ; a text of any length is hashed where it is
    read and not shuffled. An empty table gives an empty result.

    Returns order, leaf, altered_leaf (of the row with the columns of ``altered`` instead; else null),
    subroot, root (binary digests), places (among each run, from the leaf up to the root) and siblings
    (each run's other digests, joined), one row per input row.
    """
    told = [F.col(c) for c in columns]
    other = F.unhex(row_digest([altered.get(c, F.col(c)) for c in columns])) if altered is not None else F.lit(None).cast("binary")
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("id"), F.unhex(row_digest(told)).alias("digest"), other.alias("altered_leaf"))
    # written first, as a range sort reads its input twice: texts are hashed once
    leaves = written(_ranked(written(leaves, "manifest-hashed"), ["id", "digest"], "manifest-leaves"), "manifest-ranked")
    passes, subroots = _trees(leaves, arity, height, "manifest-blocks")
    tops = written(_ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), "digest"), ["id"], "manifest-groups"), "manifest-subroots")
    steps, root = _trees(tops, arity, height, "manifest-tops")
    nothing = [F.array().cast("array<int>").alias("places"), F.array().cast("array<binary>").alias("siblings")]
    by_group = _paths(steps, root.select("grp", *nothing, F.col("digest").alias("root")))
    named = tops.select(F.col("id").alias("grp"), F.col("digest").alias("subroot"), "rank").join(by_group.drop("grp"), "rank").drop("rank")
    paths = _paths(passes, named)
    found = paths.select(F.col("grp").alias("_grp"), F.col("rank").alias("_rank"), "subroot", "root", "places", "siblings")
    joined = leaves.join(found, leaves["grp"].eqNullSafe(F.col("_grp")) & (leaves["rank"] == F.col("_rank")))
    return joined.select(F.col("id").alias(order), F.col("digest").alias("leaf"), "altered_leaf", "subroot", "root", "places", "siblings")


def folded(leaf: Column, places: Column, siblings: Column) -> Column:
    """The root, in hex, that a leaf (hex) has under the given path."""
    def up(node: Column, at: Column) -> Column:
        cut = at["place"] * _DIGEST
        left, right = F.substring(at["others"], F.lit(1), cut), F.substring(at["others"], cut + 1, F.octet_length(at["others"]))
        return F.sha2(F.concat(F.lower(F.hex(left)), node, F.lower(F.hex(right))), 256)

    return F.aggregate(F.zip_with(places, siblings, lambda place, others: F.struct(place.alias("place"), others.alias("others"))), leaf, up)


def verified_manifest(docs: DataFrame, tampered: Column, altered: dict[str, Column], **options) -> DataFrame:
    """``manifest`` of ``docs`` in hex, with each row's root recomputed from what ``tampered`` rows hold after ``altered``."""
    changed = {c: F.when(tampered, value).otherwise(F.col(c)) for c, value in altered.items()}
    proofs = manifest(docs, altered=changed, **options)
    text = lambda c: F.lower(F.hex(c))
    root = text("root")
    back = folded(text("altered_leaf"), F.col("places"), F.col("siblings"))
    order = options.get("order", "doc_id")
    return proofs.select(
        order, text("leaf").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
        F.sha2(F.array_join(F.transform("siblings", text), ""), 256).alias("proof_sha256"), back.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return verified_manifest(table(spark, sf_dir, "documents"), tampered, {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)})


def _tree_sql(name: str, nodes: str) -> str:
    """Tables ``name`` (g, level, i, d, n: all nodes) and ``name``_s (with what stands left and right in a run)."""
    return f"""
{name}(g, level, i, d, n) AS (
  SELECT g, 0, i, d, n FROM {nodes}
  UNION ALL SELECT any_value(g), any_value(level) + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), any_value((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY g, i // 8),
{name}_s AS (SELECT g, level, i, n, coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1 WINDOW r AS (PARTITION BY g, level, i // 8 ORDER BY i))"""


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(map(part, ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text))) + ")"


_CRC_STEP = "xor(xor(a, e) >> 1, 3988292384::UBIGINT * (xor(a, e) & 1))"
_CRC = f"xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS UBIGINT)] || list_resize([]::UBIGINT[], 7, 0::UBIGINT)))), lambda a, e: {_CRC_STEP}), 4294967295::UBIGINT)"
_LOWER_SQL = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE_SQL = f"""
WITH RECURSIVE x AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql(f"CASE WHEN coalesce({_CRC} % 3 = 0, false) THEN {_LOWER_SQL} ELSE text END")} AS other FROM documents),
y AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM x),
{_tree_sql("t", "y")},
u AS (SELECT g AS lang, d AS subroot, 0 AS g, d, row_number() OVER (ORDER BY t.g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
{_tree_sql("v", "u")},
w(doc_id, g, i, pos, level, leaf, node, proof) AS (
  SELECT doc_id, g, i, i, 0, leaf, other, '' FROM y
  UNION ALL SELECT w.doc_id, w.g, w.i, w.pos // 8, w.level + 1, w.leaf, sha256(s.l || w.node || s.r), w.proof || s.l || s.r FROM w JOIN t_s s ON s.g = w.g AND s.level = w.level AND s.i = w.pos),
top AS (SELECT arg_max(struct_pack(doc_id := doc_id, leaf := leaf, node := node, proof := proof), level) AS r, g FROM w GROUP BY g, i),
z(doc_id, leaf, subroot, pos, level, node, proof, k) AS (
  SELECT r.doc_id, r.leaf, u.subroot, u.i, 0, r.node, r.proof, row_number() OVER () FROM top JOIN u ON u.lang = top.g
  UNION ALL SELECT z.doc_id, z.leaf, z.subroot, z.pos // 8, z.level + 1, sha256(s.l || z.node || s.r), z.proof || s.l || s.r, z.k FROM z JOIN v_s s ON s.level = z.level AND s.i = z.pos),
e AS (SELECT arg_max(struct_pack(doc_id := doc_id, leaf := leaf, subroot := subroot, node := node, proof := proof), level) AS r FROM z GROUP BY k)
SELECT r.doc_id AS doc_id, r.leaf AS leaf, r.subroot AS subroot, v.d AS root, sha256(r.proof) AS proof_sha256, r.node AS folded_root, r.node = v.d AS verified FROM e CROSS JOIN (SELECT d FROM v WHERE n = 1) v
"""
