"""Removal of repeated passages by suffix arrays.

A string of LENGTH bytes that starts at two places is found in four steps, each a Spark job:

1. Every string of LENGTH bytes selects one of its 64-byte grams, the one of least hash (its anchor);
   equal strings select equal grams at equal offsets. So each start of a string belongs to one anchor,
   and the starts of an anchor are neighbours: one window of text holds their strings.
2. Only anchors whose gram occurs again can matter. Windows of equal content (by 64-bit hash of content
   and place of the gram, among those whose gram has an equal 64-bit hash) are one class; a class of
   several windows is repeated throughout, and one of them stands for it in the suffix arrays.
3. The different windows of a gram are sorted suffix by suffix (``lyndon_suffixes``): equal strings are
   neighbours in a suffix array, and neighbours are compared byte by byte. A gram with many windows is
   first split by the bytes that all strings of a range of offsets share; after three splits a range
   is one offset, where members are equal (by 64-bit hash) or apart, so no task holds a large group.
4. The bytes so covered are cut from their documents.

Passages of over 50 words that stand in another document too are often shorter than LENGTH and then stay.
Documents that hold one are marked, by anchors in words (``_word_anchors``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.llm.lyndon_suffixes import suffix_arrays
from tallystone.llm.shingles import _powers, mixed, powers, word_lists
from tallystone.session import table, written

LENGTH = 400
GRAM = 64
#: Words of a passage that marks a document, and of the grams such passages are found by.
WORDS = 51
WORD_GRAM = 8
#: Windows of a gram that are sorted at once; more are split first.
TOGETHER = 16
#: Offsets per range in the splits of large groups.
SPLITS = (32, 4, 1)
#: Symbols of the suffix arrays that advance together.
SYMBOLS = 3 << 20
_BLOCK = 1 << 18
#: Words that are scanned together; a longer text is scanned alone.
_WORDS_BLOCK = 1 << 17


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _anchors(values: np.ndarray, owner: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of a run of documents' symbols, given as hashes: window start, gram's place, number of
    starts, hash of the gram, hash of the window. A string must lie in one document (equal ``owner``)."""
    up, down = powers(len(values))
    starts = len(values) - length + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)])])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(values) - gram + 1])
    # hash above, place below: the leftmost of equal grams is the least
    least = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:starts], least[width - span : width - span + starts])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = owner[:starts] == owner[length - 1 :]
    new = np.flatnonzero(inside & np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:starts] != owner[: starts - 1])]))
    stops = np.flatnonzero(np.concatenate([(place[1:] != place[:-1]) | (owner[1:starts] != owner[: starts - 1]), [True]]) | ~inside)
    count = np.where(inside[stops[np.searchsorted(stops, new)]], stops[np.searchsorted(stops, new)] + 1, stops[np.searchsorted(stops, new)]) - new
    at, ends = place[new], new + count - 1 + length
    whole = mixed((sums[ends] - sums[new]) * down[new] + ((at - new) * 1024 + count).astype(np.uint64))
    return new, at, count, grams[at], whole


def _list_anchors(docs: DataFrame, length: int) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            parts: list[tuple[int, int, bytes]] = []  # row, offset in its text, bytes
            held = 0

            def flush(ids=ids, hashes=hashes) -> pa.RecordBatch:
                nonlocal parts, held
                sizes = np.array([len(p) for _, _, p in parts])
                begin = np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(parts)), sizes)
                start, at, count, gram, whole = _anchors(_powers()[0][np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)], owner, length, GRAM)
                of = owner[start]
                rows, offset = np.array([r for r, _, _ in parts])[of], np.array([o for _, o, _ in parts])[of]
                parts, held = [], 0
                return pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), hashes.take(pa.array(rows)), _signed(gram), _signed(whole), pa.array(start - begin[of] + offset, pa.int64()), pa.array(at - start, pa.int32()), pa.array(count, pa.int32())],
                    names=["doc_id", "text_hash", "gram", "window", "start", "lead", "starts"],
                )

            for row, text in enumerate(batch.column(2).to_pylist()):
                data = (text or "").encode()
                for at in range(0, len(data) - length + 1, _BLOCK):
                    parts.append((row, at, data[at : at + _BLOCK + length - 1]))
                    held += len(parts[-1][2])
                    if held >= _BLOCK:
                        yield flush()
            if parts:
                yield flush()

    return docs.mapInArrow(scan, f"doc_id {kind}, text_hash long, gram long, window long, start long, lead int, starts int")


def _word_anchors(docs: DataFrame, words: int) -> DataFrame:
    """Anchors of all strings of ``words`` words; of equal windows in a row, one. at: the window's first
    start times 1024, plus the number of its starts."""
    kind = dict(docs.dtypes)["doc_id"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(row, w) for at in range(0, batch.num_rows, 256) for row, w in enumerate(word_lists(batch.column(2).slice(at, 256).to_pylist()), at) if len(w) >= words]
            while lists:
                held = take = 0
                while take < len(lists) and (not take or held + len(lists[take][1]) <= _WORDS_BLOCK):
                    held, take = held + len(lists[take][1]), take + 1
                now, lists = lists[:take], lists[take:]
                sizes = np.array([len(w) for _, w in now])
                begin, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(take), sizes)
                start, _, count, gram, whole = _anchors(np.concatenate([w for _, w in now]), owner, words, WORD_GRAM)
                of = owner[start]
                by = np.lexsort((whole, gram, of))
                by = by[np.concatenate([[True], (np.diff(of[by]) != 0) | (np.diff(gram[by]) != 0) | (np.diff(whole[by]) != 0)])]
                rows = pa.array(np.array([row for row, _ in now])[of[by]])
                at = (start - begin[of]) * 1024 + count
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), _signed(gram[by]), _signed(whole[by]), pa.array(at[by], pa.int64())], names=["doc_id", "text_hash", "gram", "window", "at"])

    return docs.mapInArrow(scan, f"doc_id {kind}, text_hash long, gram long, window long, at long")


def _sequences(text: str, ats: list[int], words: int) -> np.ndarray:
    """Hashes of the strings of ``words`` words at the starts of these windows."""
    w = word_lists([text])[0]
    up, down = powers(len(w))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w * up[: len(w)])])
    starts = np.unique(np.concatenate([np.arange(at >> 10, (at >> 10) + (at & 1023)) for at in ats]))
    return mixed((sums[starts + words] - sums[starts]) * down[starts])


def _repeated_starts(windows: list[list[bytes]], length: int) -> list[np.ndarray]:
    """For the windows of each group, flattened: which starts' strings occur again in the group."""
    flat = [w for group in windows for w in group]
    sizes = np.array([len(w) for w in flat]) + 1
    begin = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(flat) + b"\0", np.uint8).astype(np.int64) + 2
    ends = begin + sizes - 1
    symbols[ends] = 1
    bounds = np.concatenate([[0], np.cumsum([len(g) for g in windows])])
    cuts = np.concatenate([[0], ends[bounds[1:] - 1] + 1])
    symbols[cuts[1:] - 1] = 0
    order = suffix_arrays(symbols, cuts)

    starts = np.zeros(len(symbols), bool)
    for b, s in zip(begin, sizes, strict=True):
        starts[b : b + s - length] = True
    a, b = order[:-1], order[1:]
    ok = starts[a] & starts[b]
    ok[cuts[1:-1] - 1] = False  # neighbours in different arrays
    a, b = a[ok], b[ok]
    # eight bytes at a time; the array is padded for the last
    padded = np.concatenate([symbols - 2, np.zeros(8, np.int64)]).astype(np.uint8)
    words = np.zeros(len(symbols), np.uint64)
    for i in range(8):
        words |= padded[i : i + len(symbols)].astype(np.uint64) << np.uint64(8 * i)
    for at in [*range(0, length - 7, 8), length - 8]:
        same = words[a + at] == words[b + at]
        a, b = a[same], b[same]
    again = np.zeros(len(symbols), bool)
    again[a] = again[b] = True
    return [again[x : x + s - length] for x, s in zip(begin, sizes, strict=True)]


def _sort_groups(windows: DataFrame, length: int) -> DataFrame:
    """windows (gram, window, content) -> gram, window, lo, hi: runs of repeated starts."""
    rows = windows.select("gram", "window", "content").repartition("gram").sortWithinPartitions("gram")

    def runs(groups: list[list[tuple[int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
        groups = sorted((g for g in groups if len(g) > 1), key=lambda g: sum(len(w) for _, _, w in g))
        while groups:
            # strings that advance together are of like length
            shortest, n, take = sum(len(w) for _, _, w in groups[0]), 0, 0
            while take < len(groups) and n < SYMBOLS // 2 and (size := sum(len(w) + 1 for _, _, w in groups[take])) <= 2 * shortest + 4096:
                n, take = n + size, take + 1
            now, groups = groups[:take], groups[take:]
            out: list[tuple[int, int, int, int]] = []
            for (gram, window, _), again in zip((r for g in now for r in g), _repeated_starts([[w for _, _, w in g] for g in now], length), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]])))
                out.extend((gram, window, int(lo), int(hi)) for lo, hi in zip(edge[::2], edge[1::2], strict=True))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gram", "window", "lo", "hi"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple[int, int, bytes]]] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not groups or groups[-1][0][0] != row[0]:
                    if held >= SYMBOLS:
                        yield from runs(groups)
                        groups, held = [], 0
                    groups.append([])
                groups[-1].append(row)
                held += len(row[2])
        yield from runs(groups)

    return rows.mapInArrow(sort, "gram long, window long, lo int, hi int")


def _resolve(windows: DataFrame, length: int, level: int = 0) -> DataFrame:
    """windows (gram, window, lead, starts, content), several of each gram -> gram, window, lo, hi."""
    many = written(windows.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select("gram"), "passage-many")
    found = _sort_groups(windows.join(many, "gram", "left_anti"), length)
    if level == len(SPLITS) or many.isEmpty():
        return found
    width = SPLITS[level]
    # offsets of starts before the gram: from lead - starts + 1 to lead; range r has r * width and on
    first, last = F.expr(f"(lead - starts + 1) div {width}"), F.expr(f"lead div {width}")
    part = windows.join(many, "gram", "left_semi").withColumn("r", F.explode(F.sequence(first, last)))
    high, low = F.least("lead", (F.col("r") + 1) * width - 1), F.greatest(F.col("lead") - F.col("starts") + 1, F.col("r") * width)
    part = part.withColumn("high", high).withColumn("low", low).withColumn("shift", F.col("lead") - F.col("high"))
    # what the strings of the whole range share: from its least offset to the end of its greatest
    core = F.substring("content", (F.col("lead") - F.col("r") * width + 1).cast("int"), F.lit(length - width + 1))
    inner = F.substring("content", (F.col("shift") + 1).cast("int"), (F.col("high") - F.col("low") + length).cast("int"))
    part = part.withColumn("gram_in", F.xxhash64("gram", "r", core)).withColumn("content_in", inner)
    part = written(part.select("gram", "window", "shift", "gram_in", F.xxhash64("content_in", "high").alias("window_in"), F.col("high").alias("lead_in"), (F.col("high") - F.col("low") + 1).alias("starts_in"), "content_in"), "passage-parts")
    classes = part.groupBy(F.col("gram_in").alias("gram"), F.col("window_in").alias("window")).agg(F.count("*").alias("members"), F.first("lead_in").alias("lead"), F.first("starts_in").alias("starts"), F.first("content_in").alias("content"))
    classes = written(classes, "passage-classes")
    several = written(classes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "passage-several")
    below = _resolve(classes.join(several, "gram", "left_semi"), length, level + 1)
    below = below.unionByName(classes.filter("members > 1").select("gram", "window", F.lit(0).alias("lo"), F.col("starts").cast("int").alias("hi")))
    back = part.select("gram", "window", "shift", "gram_in", "window_in").join(below.select(F.col("gram").alias("gram_in"), F.col("window").alias("window_in"), "lo", "hi"), ["gram_in", "window_in"])
    return found.unionByName(back.select("gram", "window", (F.col("lo") + F.col("shift")).cast("int").alias("lo"), (F.col("hi") + F.col("shift")).cast("int").alias("hi")))


def _of_document(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    return left.join(right, left["doc_id"].eqNullSafe(right["_id"]) & (left["text_hash"] == right["_hash"]), how).drop("_id", "_hash")


def _cut_windows(docs: DataFrame, wanted: DataFrame, asked: DataFrame, length: int, words: int) -> DataFrame:
    """Contents of the windows wanted; and for those asked for in words, rows without content: a string's
    hash as gram, that of its text as window. Both by one shuffle of the texts."""
    wanted = wanted.withColumn("w", F.struct("gram", "window", "start", "lead", "starts"))
    lists = wanted.select("doc_id", "text_hash", "w", F.lit(None).cast("long").alias("at")).unionByName(asked.select("doc_id", "text_hash", F.lit(None).cast(wanted.schema["w"].dataType).alias("w"), "at"))
    lists = lists.groupBy("doc_id", "text_hash").agg(F.collect_list("w").alias("wanted"), F.collect_list("at").alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for text, name, want, ask in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    data = text.encode()
                    out.extend((w["gram"], w["window"], w["lead"], w["starts"], data[w["start"] : w["start"] + w["starts"] - 1 + length]) for w in want)
                    if ask:
                        out.extend((h, name, None, None, None) for h in _sequences(text, ask, words).view(np.int64).tolist())
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "window", "lead", "starts", "content"])

    return _of_document(docs, lists).select("text", "text_hash", "wanted", "asked").mapInArrow(cut, "gram long, window long, lead int, starts int, content binary")


def _named(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _shared_windows(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_hash) that have a window in words which another row has too; windows to be asked
    for (with at), as only a part of them may be shared; all windows whose gram occurs again."""
    # counted where they lie after one shuffle of the anchors, which hold no texts
    gram = Window.partitionBy("gram")
    anchors = _word_anchors(docs, words).withColumn("of_gram", F.count("*").over(gram)).withColumn("of_window", F.count("*").over(Window.partitionBy("gram", "window")))
    again = written(anchors.filter("of_gram > 1").select("doc_id", "text_hash", "gram", "window", "at", (F.col("of_window") > 1).alias("shared")), "words-again")
    sure = written(again.filter("shared").select("doc_id", "text_hash").distinct(), "words-sure")
    open_ = written(_of_document(again.filter("not shared"), sure, "left_anti").select("gram").distinct(), "words-open")
    asked = again.join(open_, "gram", "left_semi").groupBy("gram", "window").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("one")).select("one.*")
    return sure, asked, again


def repeated_passages(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, spans, shares: of each document with any, the byte ranges [start, stop) covered by
    strings of ``length`` bytes that start anywhere else too (ranges may touch and overlap), and whether
    another row holds ``words`` consecutive words of it."""
    docs = _named(docs)
    sure, asked, word_windows = _shared_windows(docs, words)
    anchors = written(_list_anchors(docs, length), "passage-anchors")
    # lists of grams are written before they are joined: the join then has sides of its own, which
    # Spark splits where a gram is very common
    again = written(anchors.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "passage-grams")
    anchors = written(anchors.join(again, "gram", "left_semi"), "passage-again")
    classes = anchors.groupBy("gram", "window").agg(F.count("*").alias("members"), F.first("lead").alias("lead"), F.first("starts").alias("starts"), F.min(F.struct("doc_id", "text_hash", "start")).alias("one"))
    classes = written(classes, "passage-classes")
    several = written(classes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "passage-several")
    windows = written(_cut_windows(docs, classes.join(several, "gram", "left_semi").select("gram", "window", "lead", "starts", "one.*"), asked, length, words), "passage-windows")
    whole = classes.filter("members > 1").select("gram", "window", F.lit(0).alias("lo"), F.col("starts").alias("hi"))
    found = written(_resolve(windows.filter("content is not null"), length).unionByName(whole), "passage-found")
    spans = anchors.join(found, ["gram", "window"]).select("doc_id", "text_hash", F.struct((F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") - 1 + length).alias("stop")).alias("span"))
    # strings of words by their hashes: those of two different texts
    text = F.col("window").alias("text_hash")
    strings = windows.filter("content is null").select("gram", text).distinct().withColumn("texts", F.count("*").over(Window.partitionBy("gram")))
    texts = written(strings.filter("texts > 1").select("text_hash").distinct(), "words-texts")
    shares = sure.unionByName(word_windows.join(texts, "text_hash", "left_semi").select("doc_id", "text_hash").distinct())
    rows = spans.withColumn("shares", F.lit(False)).unionByName(shares.select("doc_id", "text_hash", F.lit(None).cast(spans.schema["span"].dataType).alias("span"), F.lit(True).alias("shares")))
    return rows.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.max("shares").alias("shares"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """Each row of ``docs`` (doc_id, text; further columns ignored) without its repeated passages.

    Texts are UTF-8 bytes, null as empty; every byte of a string of ``length`` bytes (at least 72)
    that also starts at another place, in this or another row, goes, as judged on the input. Equal
    rows are repeats of one another. An empty table gives none.

    Returns doc_id, n_bytes, spans (disjoint [start, stop) that were cut), kept (binary), and
    shares_passage: whether ``words`` consecutive words (9 to 1,000; A-Z lower-cased, parted by ASCII white
    space) of the row also follow each other in another row, however few bytes they have and cut or not.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    if not WORD_GRAM < words <= 1000:
        raise ValueError(f"words must be {WORD_GRAM + 1} to 1000")
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                sizes, cuts, kept = [], [], []
                for text, spans in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist(), strict=True):
                    data = (text or "").encode()
                    merged: list[list[int]] = []
                    for s in spans or ():
                        if merged and s["start"] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], s["stop"])
                        else:
                            merged.append([s["start"], s["stop"]])
                    edges = [0, *(x for m in merged for x in m), len(data)]
                    sizes.append(len(data))
                    cuts.append([{"start": a, "stop": b} for a, b in merged])
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(cuts, pa.list_(span)), pa.array(kept, pa.binary()), piece.column(3)], names=["doc_id", "n_bytes", "spans", "kept", "shares_passage"])

    joined = _of_document(_named(docs), repeated_passages(docs, length, words), "left").withColumn("shares", F.coalesce("shares", F.lit(False)))
    return joined.select("doc_id", "text", "spans", "shares").mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary, shares_passage boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed: Column = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("shares_passage").cast("int").alias("shares_passage"))
