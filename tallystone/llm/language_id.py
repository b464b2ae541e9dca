"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent cells read a text's bytes, one from either end; both states together label every
byte, and the labels' probabilities are pooled over the document. The bytes are read in windows of
``WINDOW`` that start from a zero state, so that thousands of windows of many documents advance
together in one matrix product a step; every byte of the text is in one window. Training is
backpropagation through time over such windows, in numpy, on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.session import table

WINDOW = 48
HIDDEN = 8
#: Windows that advance together when a model is applied.
LANES = 4096
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """``reads`` (2, 3h, 256): a byte's share of the gates, by direction; ``turns`` (2, 3h, h): the
    state's; ``labels`` (2, L, h) and ``offset`` (L, 1): from states to labels. Gates: update, reset,
    candidate."""

    languages: tuple[str, ...]
    reads: np.ndarray
    turns: np.ndarray
    labels: np.ndarray
    offset: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def label_windows(model: Model, steps: np.ndarray) -> np.ndarray:
    """Probabilities (T, L, B) of every byte of windows given as (T, B), time first."""
    T, B = steps.shape
    h = HIDDEN
    half = np.ones((1, 3 * h, 1), np.float32)
    half[:, : 2 * h] = 0.5  # sigmoid(x) = (1 + tanh(x / 2)) / 2
    reads, turns = model.reads * half, model.turns * half
    logits = np.repeat(np.repeat(model.offset[None], T, 0), B, 2)
    for d, at in ((0, range(T)), (1, range(T - 1, -1, -1))):
        state = np.zeros((h, B), np.float32)
        gates = np.empty((3 * h, B), np.float32)
        for t in at:
            np.take(reads[d], steps[t], axis=1, out=gates, mode="clip")
            turned = turns[d] @ state
            open_ = gates[: 2 * h]
            open_ += turned[: 2 * h]
            np.tanh(open_, out=open_)
            open_ *= 0.5
            open_ += 0.5
            candidate = turned[2 * h :]
            candidate *= open_[h:]
            candidate += gates[2 * h :]
            np.tanh(candidate, out=candidate)
            state -= candidate
            state *= open_[:h]
            state += candidate
            logits[t] += model.labels[d] @ state
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _gradient(model: Model, steps: np.ndarray, known: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradient by backpropagation through time; ``known`` masks padding, ``y`` is (B,)."""
    T, B = steps.shape
    h, L = HIDDEN, len(model.languages)
    keep = []
    logits = np.repeat(np.repeat(model.offset[None], T, 0), B, 2)
    for d in (0, 1):
        state, kept = np.zeros((h, B), np.float32), {}
        for t in range(T) if d == 0 else range(T - 1, -1, -1):
            gates, turned = model.reads[d][:, steps[t]], model.turns[d] @ state
            open_ = _sigmoid(gates[: 2 * h] + turned[: 2 * h])
            z, r, inner = open_[:h], open_[h:], turned[2 * h :]
            candidate = np.tanh(gates[2 * h :] + r * inner)
            after = candidate + z * (state - candidate)
            kept[t] = (state, z, r, inner, candidate, after)
            state = after
            logits[t] += model.labels[d] @ state
        keep.append(kept)
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    weight = known / known.sum()
    right = np.arange(L)[:, None] == y
    loss = -float((np.log((p * right).sum(1) + 1e-9) * weight).sum())
    slope = ((p - right) * weight[:, None]).astype(np.float32)

    reads, turns, labels = np.zeros_like(model.reads), np.zeros_like(model.turns), np.zeros_like(model.labels)
    for d in (0, 1):
        carried = np.zeros((h, B), np.float32)
        pulls = np.empty((T, 3 * h, B), np.float32)
        for t in range(T - 1, -1, -1) if d == 0 else range(T):
            state, z, r, inner, candidate, after = keep[d][t]
            labels[d] += slope[t] @ after.T
            into = carried + model.labels[d].T @ slope[t]
            to_candidate = into * (1 - z) * (1 - candidate * candidate)
            to_z, to_r = into * (state - candidate) * z * (1 - z), to_candidate * inner * r * (1 - r)
            through = np.concatenate([to_z, to_r, to_candidate * r])
            turns[d] += through @ state.T
            carried = into * z + model.turns[d].T @ through
            pulls[t] = np.concatenate([to_z, to_r, to_candidate])
        flat = steps.ravel()
        for g in range(3 * h):
            reads[d, g] = np.bincount(flat, pulls[:, g].ravel(), 256)
    return loss, [reads, turns, labels, slope.sum((0, 2))[:, None]]


def fit(windows: list[bytes], labels: list[str], epochs: int = 12, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Model:
    """Adam over shuffled mini-batches; every language carries equal weight through the sample. No
    windows: a model of no language, under which every text is undetermined."""
    languages = tuple(sorted(set(labels)))
    rng = np.random.default_rng(seed)
    h, L = HIDDEN, len(languages)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    params = [draw(2, 3 * h, 256, scale=0.3), draw(2, 3 * h, h, scale=h**-0.5), draw(2, L, h, scale=h**-0.5), np.zeros((L, 1), np.float32)]
    if not L:
        return Model(languages, *params)
    steps = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW).T
    known = np.arange(WINDOW)[:, None] < np.array([len(w) for w in windows])
    y = np.searchsorted(languages, labels)
    mean, square, n = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            chosen, n = order[at : at + batch], n + 1
            _, grads = _gradient(Model(languages, *params), steps[:, chosen], known[:, chosen], y[chosen])
            for p, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**n)) / (np.sqrt(s / (1 - 0.99**n)) + 1e-8)
    return Model(languages, *params)


def training_windows(docs: DataFrame, docs_per_language: int = 400, windows_per_doc: int = 6) -> tuple[list[bytes], list[str]]:
    """The training sample, of rows with a text and a language outside the held-out fold (crc32(doc_id)
    mod 4 = 2): of each language about ``docs_per_language`` different texts at most, those of least
    hash, and of each up to ``windows_per_doc`` windows spread evenly over the whole text.

    The rows of a language are counted first, and a row is picked by the hash of its id and text alone,
    so that about twice the number are expected; nothing is sorted or gathered by language. Repeated
    rows are one. The driver gets the windows of some 800 texts a language.
    """
    key = F.col("doc_id").cast("string")
    known = docs.select(key.alias("k"), "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32("k") % 4 != 2))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))  # a row per language
    place = F.shiftrightunsigned(F.xxhash64("k", "text"), 11) / F.lit(float(1 << 53))
    picked = known.join(F.broadcast(counts), "lang").withColumn("place", place).filter(F.col("place") * F.col("n") < 2 * docs_per_language)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[float, str, list[bytes]]] = []
            for place, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                starts = sorted({int(x) for x in np.linspace(0, max(len(data) - WINDOW, 0), windows_per_doc)}) if data else []
                out.append((place, lang, [data[start : start + WINDOW] for start in starts]))
            kinds = (pa.float64(), pa.string(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else ([], [], []), kinds, strict=True)], names=["place", "lang", "windows"])

    sample = picked.select("place", "lang", "text").mapInArrow(cut, "place double, lang string, windows array<binary>").distinct()
    windows: list[bytes] = []
    labels: list[str] = []
    taken: dict[str, int] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["place"], r["lang"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= docs_per_language:
            windows += map(bytes, r["windows"])
            labels += [r["lang"]] * len(r["windows"])
    return windows, labels


def train(docs: DataFrame, **options) -> Model:
    return fit(*training_windows(docs), **options)


def pooled(model: Model, texts: list[str | None]) -> np.ndarray:
    """Mean probability of each language over all bytes of each text; no bytes: zeros."""
    sums, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    pieces: list[bytes] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal pieces, owners, held
        all_steps = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, WINDOW)
        owner = np.concatenate(owners)
        for at in range(0, len(all_steps), LANES):
            steps, own = np.ascontiguousarray(all_steps[at : at + LANES].T), owner[at : at + LANES]
            p = label_windows(model, steps)
            known = (np.arange(WINDOW)[:, None] < own[:, 1]).astype(np.float32)
            of_window = np.einsum("tlb,tb->bl", p, known)
            for k in range(len(model.languages)):
                sums[:, k] += np.bincount(own[:, 0], of_window[:, k], len(texts))
        pieces, owners, held = [], [], 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        sizes[i] = len(data)
        # a long text goes through in runs, so that memory stays bounded
        for at in range(0, len(data), WINDOW * LANES):
            run = data[at : at + WINDOW * LANES]
            n = -(-len(run) // WINDOW)
            pieces.append(run.ljust(n * WINDOW, b"\0"))
            lengths = np.full(n, WINDOW)
            lengths[-1] = len(run) - (n - 1) * WINDOW
            owners.append(np.stack([np.full(n, i), lengths], 1))
            held += n
            if held >= LANES:
                flush()
    if pieces:
        flush()
    return sums / np.maximum(sizes, 1)[:, None]


def identify_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text; further columns ignored) as doc_id, lang_pred, score and shares.

    ``shares`` has the pooled probability of every language in the model's order, ``score`` the
    largest. Null texts and texts without a letter are ``und`` with score 0 and null shares, as is
    every text under a model of no language. Ids may repeat or be null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some tens of KB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                texts = [t if t and any(map(str.isalpha, t)) and sent.value.languages else None for t in piece.column(1).to_pylist()]
                p = pooled(sent.value, texts)
                known = [t is not None for t in texts]
                names = [sent.value.languages[k] if ok else UNDETERMINED for k, ok in zip(p.argmax(1) if p.size else [0] * len(texts), known, strict=True)]
                score = np.clip(p.max(1), 0, 1) if p.size else np.zeros(len(texts))
                shares = pa.array([list(map(float, row)) if ok else None for row, ok in zip(p, known, strict=True)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), shares], names=["doc_id", "lang_pred", "score", "shares"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, shares array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify_languages(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
