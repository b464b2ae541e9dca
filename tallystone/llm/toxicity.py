"""A toxicity classifier that is penalised for reacting to who is mentioned.

A word's evidence is the sum of weights of its hashed byte n-grams; a document is toxic unless every
word is harmless (noisy-or), so that one insult counts in a long text as in a short one. In training,
identity terms of labelled sentences are swapped for others of their group, and the difference of the
two scores is penalised: what depends on the group that is named is unlearned, so neutral mentions
stop raising false alarms. As most labelled sentences name no group, each text also gives sentences in
which one word makes room for a term of a group, beside the same with another term of that group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.session import table

NGRAMS = (3, 4, 5)
TABLE_BITS = 18
#: Texts are scored in runs of about so many bytes; a longer text takes several, cut between words.
RUN_BYTES = 1 << 19
#: Words below these log-odds are no evidence: a text of many thousand such words stays harmless.
FLOOR = -2.0
#: Terms that may stand for each other in a sentence; a parameter of the training.
IDENTITY_GROUPS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "refugees"),
    ("blind", "deaf", "disabled"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Everything but ASCII letters and the bytes of other characters separates words.
_KEEP = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Model:
    """``swaps``: how many pairs of swapped sentences the penalty has seen, placed ones included."""

    weights: np.ndarray
    bias: float
    swaps: int = 0


def _runs(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of lower-cased texts with single separators between them, and the text of each byte."""
    parts: list[bytes] = []
    owners: list[int] = []
    held = 0

    def packed() -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.array(owners), [len(p) for p in parts])

    for i, text in enumerate(texts):
        data = (text or "").lower().encode("utf-8", "replace").translate(_KEEP)
        at = 0
        while at < len(data):
            stop = min(len(data), at + RUN_BYTES)
            if stop < len(data):
                space = data.rfind(b" ", at, stop)
                # a word longer than a run stays whole
                stop = space if space > at else (data.find(b" ", stop) + 1 or len(data) + 1) - 1
            parts.append(b" " + data[at:stop] + b" ")
            owners.append(i)
            held += len(parts[-1])
            at = max(stop, at + 1)
            if held >= RUN_BYTES:
                yield packed()
                parts, owners, held = [], [], 0
    if parts:
        yield packed()


def _features(data: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word starts, and for each length n the table entries of n-grams and whether they count: those
    without a separator inside, shifted so that an entry stands at the first byte of its word part."""
    space = data == 0x20
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    wide = data.astype(np.uint64)
    out, code, clear = [], wide[: max(len(wide) - 1, 0)] | (wide[1:] << np.uint64(8)), ~space[1:]
    for n in NGRAMS:
        m = max(len(data) - n + 1, 0)
        code = code[:m] | (wide[n - 1 : n - 1 + m] << np.uint64(8 * (n - 1)))
        entry = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
        clear = clear[:m]
        out.append((entry, clear))
        clear = clear & ~space[n - 1 : n - 1 + m]
    return starts, out


def _word_logits(model_weights: np.ndarray, bias: float, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    starts, grams = _features(data)
    if not len(starts):
        return starts, np.zeros(0, np.float32), grams
    evidence = np.zeros(len(data), np.float32)
    for entry, clear in grams:
        evidence[1 : 1 + len(entry)] += model_weights[entry] * clear
    return starts, np.add.reduceat(evidence, starts) + np.float32(bias), grams


def exposure(model: Model, texts: list[str | None]) -> np.ndarray:
    """-log of the probability that a text is harmless, each."""
    out = np.zeros(len(texts))
    for data, owner in _runs(texts):
        starts, z, _ = _word_logits(model.weights, model.bias, data)
        if len(starts):
            out += np.bincount(owner[starts], np.where(z > FLOOR, np.logaddexp(0, z), 0), len(texts))
    return out


def swapped_sentences(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS) -> list[tuple[str, str]]:
    """Sentences that mention an identity term, each beside itself with the next term of the group."""
    other = {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}
    out = []
    for sentence in _SENTENCE.findall(text.lower()):
        swapped = _WORD.sub(lambda m: other.get(m[0], m[0]), sentence)
        if swapped != sentence:
            out.append((sentence, swapped))
    return out


def placed_sentence(text: str, groups: tuple[tuple[str, ...], ...], rng: np.random.Generator) -> tuple[str, str] | None:
    """A sentence of ``text`` with one of its words replaced by a term of a group, and by another."""
    sentences = _SENTENCE.findall(text.lower())
    spots = list(_WORD.finditer(sentences[k])) if (k := int(rng.integers(max(len(sentences), 1)))) < len(sentences) else []
    if not spots:
        return None
    spot, group = spots[rng.integers(len(spots))], groups[rng.integers(len(groups))]
    one, other = (sentences[k][: spot.start()] + group[i] + sentences[k][spot.end() :] for i in rng.choice(len(group), 2, replace=False))
    return one, other


def fit(texts: list[str], labels: list[int], groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, penalty: float = 1.0, epochs: int = 20, least_steps: int = 400, batch: int = 48, rate: float = 0.12, heard: float = 0.4, decay: float = 1e-6, placed: int = 1, seed: int = 5) -> Model:
    """Adagrad over mini-batches: likelihood of the labels plus ``penalty`` times the squared change
    of the log-odds under swaps. Of a toxic text each step hears only a share ``heard`` of the words,
    drawn anew: else one known insult explains the label and those beside it are never learned. A
    step swaps the terms that its texts have and places ``placed`` in sentences of each.
    Without labels of both kinds every score is near 0."""
    weights = np.zeros(1 << TABLE_BITS, np.float32)
    spread = np.full(1 << TABLE_BITS, 1e-3, np.float32)
    bias, bias_spread = -9.0, 1e-3
    y = np.array(labels, np.float64)
    pairs = [swapped_sentences(t, groups) for t in texts]
    rng = np.random.default_rng(seed)
    # each kind of label carries half of the weight
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if 0 < y.sum() < len(y) else np.ones(len(y))

    def pull(group: list[str], slope_of, heard_of: np.ndarray | None = None) -> None:
        """One step down the gradient, given the slope of the loss in each text's exposure."""
        nonlocal bias, bias_spread
        total = np.zeros(len(group))
        runs = []
        for data, owner in _runs(group):
            starts, z, grams = _word_logits(weights, bias, data)
            if len(starts):
                mask = np.ones(len(z)) if heard_of is None else rng.random(len(z)) < heard_of[owner[starts]]
                total += np.bincount(owner[starts], np.logaddexp(0, z) * mask, len(group))
                runs.append((data, owner, starts, z, grams, mask))
        slope = slope_of(total)
        bias_grad = 0.0
        grad = np.zeros(1 << TABLE_BITS)
        for data, owner, starts, z, grams, mask in runs:
            dz = slope[owner[starts]] / (1 + np.exp(-z)) * mask
            bias_grad += dz.sum()
            at_byte = np.repeat(dz, np.diff(np.append(starts, len(data))))
            at_byte = np.concatenate([np.zeros(starts[0]), at_byte])
            for entry, clear in grams:
                grad += np.bincount(entry, at_byte[1 : 1 + len(entry)] * clear, len(grad))
        grad = grad / len(group) + decay * weights
        spread[:] += grad**2
        weights[:] -= rate * grad / np.sqrt(spread)
        bias_grad /= len(group)
        bias_spread += bias_grad**2
        bias = min(-4.0, bias - rate * bias_grad / bias_spread**0.5)

    seen = 0
    for _ in range(max(epochs, -(-least_steps * batch // len(texts))) if texts else 0):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]

            def likelihood(total: np.ndarray, chosen=chosen) -> np.ndarray:
                return share[chosen] * np.where(y[chosen] == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-6), 1.0)

            pull([texts[i] for i in chosen], likelihood, np.where(y[chosen] == 1, heard, 1.0))
            extra = [placed_sentence(texts[i], groups, rng) for i in chosen for _ in range(placed)] if groups else []
            swaps = [s for pair in [*(p for i in chosen for p in pairs[i]), *filter(None, extra)] for s in pair]
            if swaps and penalty:
                seen += len(swaps) // 2

                def change(total: np.ndarray) -> np.ndarray:
                    safe = np.clip(total, 1e-6, 50)
                    odds = np.log(np.expm1(safe))
                    gap = np.repeat(odds[::2] - odds[1::2], 2) * np.tile([1.0, -1.0], len(odds) // 2)
                    return 2 * penalty * gap / -np.expm1(-safe)

                pull(swaps, change)
    return Model(weights, float(bias), seen)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int = 1200, max_bytes: int = 1 << 16) -> tuple[list[str], list[int]]:
    """The training rows: of each label, the ``rows_per_label`` first by MD5 of doc_id among labelled
    rows outside the held-out fold (crc32(doc_id) mod 5 = 0), without texts over ``max_bytes``.
    Labels other than 0 and 1 and null ids don't count."""
    key = F.col("doc_id").cast("string")
    open_rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & (F.crc32(key) % 5 != 0))
    pick = lambda v: open_rows.filter(F.col("toxic") == v).orderBy(F.md5(key), "doc_id").limit(rows_per_label)
    # two limits bound what is broadcast; of rows that share an id the least text is collected
    ids = F.broadcast(pick(0).unionByName(pick(1)).distinct())
    rows = docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes).join(ids, "doc_id").groupBy(F.md5(key).alias("k"), "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["k"], r["toxic"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def train(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return fit(*labelled_sample(docs, labels), **options)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text; columns of any other names stay) with ``tox_score`` (0 to 1) and ``tox_predicted`` (1 from 0.5).

    Whole texts of any length are scored in the tasks that read them; null and empty texts score 0.
    Existing columns of those two names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("tox_score", "tox_predicted")
    sent = spark.sparkContext.broadcast(model)  # one table of 2^TABLE_BITS floats
    place = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("tox_score", T.DoubleType()), T.StructField("tox_predicted", T.IntegerType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                p = -np.expm1(-exposure(sent.value, piece.column(place).to_pylist()))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*piece.schema.names, "tox_score", "tox_predicted"])

    return docs.mapInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))
