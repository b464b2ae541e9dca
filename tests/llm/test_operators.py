"""Small fixtures with nulls, empty and long texts, ties, repeats and extra columns, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallystone.llm import chat_formatting, components, decontamination, exact_dedup, language_id, lyndon_suffixes, mixing, near_dedup, sharding, suffix_dedup, token_counts, toxicity
from tallystone.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n long, kept string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(4)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(25)]
    texts = [None, "", "   ", "!!", "one", "one two three", "One Two Three", *base, *base[:6], *(b.upper() for b in base[:3])]
    for b in base[6:14]:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts.append(words(rng, 30_000))
    return [(i, t, "en" if i % 5 else None, [None, "b", "a", "é"][i % 4], 0, -1, 7, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing_takes_each_source_near_its_target(docs, rows):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    total, by_source, taken = sum(size.values()), Counter(), Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        by_source[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) <= total
    # water filling by repeated sharing
    weight = dict(zip(["a", "b", "é", None], (1, 2, 3, 1), strict=True))
    target, open_, left = {}, set(weight), total
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * by_source[s]}
        for s in full or open_:
            target[s] = 3 * by_source[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ -= full or set(open_)
    for r in got:
        assert r["source_size"] == by_source[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    assert sorted(got) == sorted(mixing.mix_sources(docs.repartition(5)).collect())


def test_mixing_keeps_columns_and_repeats_rows(docs, nothing, spark):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mixed_documents(nothing).count() == 0
    same = spark.createDataFrame([(1, "a b", "en", "s", 0, 0, 0, "")] * 3 + [(None, "c", "en", "s", 0, 0, 0, "")], SCHEMA)
    assert mixing.mix_sources(same).agg({"taken": "sum"}).first()[0] <= 3 * 7
    order = mixing.mix_order(mixing._queue(docs, (1, 2, 3), 3, 17).cache()).collect()
    ranked = sorted(order, key=lambda r: (r["part"], r["finish"], r["queue_key"]))
    assert [r["finish"] for r in ranked] == sorted(r["finish"] for r in order)
    assert Counter(r["doc_id"] for r in order if r["size"]) == Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect() if r["copies"] and r["size"]})


def brute_shards(data, slack):
    """doc_id -> (shard, slot) of rows (doc_id, text) by the stated law, a row at a time."""
    order = sorted(((zlib.crc32((t or "").encode()), hashlib.md5((t or "").encode()).hexdigest(), i, len((t or "").encode()) + 1) for i, t in data))
    total, at, edges, group = sum(r[3] for r in order), 0, [], {}
    for crc, digest, _, size in order:
        edges.append((at, at + size))
        lo, _ = group.get((crc, digest), (at, at))
        group[crc, digest] = (lo, at + size)
        at += size
    cuts = []
    for k in range(1, 8):
        target = total * k // 8
        row = next(n for n, (a, b) in enumerate(edges) if a <= target < b)
        near = min(group[order[row][:2]], key=lambda e: (abs(e - target), e))
        cuts.append(near if abs(near - target) <= slack * total / 8 else min(edges[row], key=lambda e: (abs(e - target), e)))
    out, seen = {}, Counter()
    for (_, _, i, _), (a, _) in zip(order, edges, strict=True):
        shard = sum(a >= c for c in cuts)
        out[i] = (shard, seen[shard])
        seen[shard] += 1
    return out


def test_sharding_against_brute_force(docs, rows, nothing, spark):
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
    rng = random.Random(1)
    many = [(i, words(rng, 40) if i % 3 else "the same text " * 10) for i in range(400)]
    for frame, data in ((docs, [(i, t) for i, t, *_ in rows]), (spark.createDataFrame(many, "doc_id long, text string"), many)):
        for slack in (0.0, sharding.SLACK, 0.9):
            got = sharding.shard_by_bytes(frame, slack=slack).collect()
            assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == brute_shards(data, slack)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard_by_bytes(docs).collect()} == {i: (size[i], crc[i]) for i in size}
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_exact_duplicates(docs, rows, nothing, spark):
    groups = defaultdict(list)
    low = {i: (t or "").translate({c: c + 32 for c in range(65, 91)}) for i, t, *_ in rows}
    for i, t in low.items():
        groups[t].append(i)
    for options in ({}, {"salts": 2, "broadcast_rows": 0}):
        got = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs, **options).collect()}
        for i, t in low.items():
            keep = max(groups[t])
            assert tuple(got[i])[1:] == (keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())
    hot = spark.createDataFrame([(i, "hot Text" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string").repartition(6)
    for rows_at_most in (0, 1000):
        got = exact_dedup.exact_duplicates(hot, broadcast_rows=rows_at_most).groupBy("keep_id", "group_size").count().filter("group_size > 1").collect()
        assert [tuple(r) for r in got] == [(899, 600, 600)]
    assert exact_dedup.exact_duplicates(nothing).count() == 0
    again = exact_dedup.exact_duplicates(spark.createDataFrame([(None, "É"), (3, "É"), (3, "É"), (4, "é")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in again) == [(0, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (4, 4, 1, True)]


def brute_components(rows, width, threshold):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both) and (sets[a] and sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[i]] == label[i] for i in label):
            break
    return {i: len(s) for i, s in sets.items()}, label


def test_near_duplicates(docs, rows, nothing, spark, monkeypatch):
    sizes, label = brute_components(rows, 4, 80)
    expected = {i: (sizes[i], label[i], label[i] == i) for i in sizes}
    for cell in (near_dedup.CELL, 2):
        monkeypatch.setattr(near_dedup, "CELL", cell)
        assert {r["doc_id"]: tuple(r)[1:] for r in near_dedup.near_duplicates(docs, 4).collect()} == expected
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.drop_near_duplicates(docs, 4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, v in expected.items() if v[2])
    odd = spark.createDataFrame([(5, "a b c d e"), (5, "p q r s t"), (7, "A b c d e"), (None, "a b c d e"), (9, "p q r s t"), (5, "a b c d e")], "doc_id long, text string")
    got = near_dedup.near_duplicates(odd).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 5), (7, 5), (9, 5), (None, None)} and len(got) == 6
    assert sorted((r["doc_id"] or 0) for r in near_dedup.drop_near_duplicates(odd).collect()) == [0, 5, 5]


def test_chains_of_near_copies_meet(spark):
    rng = random.Random(9)
    w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):  # each step changes one word: the ends are far apart
        w[(i * 2) % 120] = f"x{i}"
        rows.append((i, " ".join(w)))
    _, label = brute_components(rows, 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == label


def test_shingle_sets_of_long_texts():
    rng = random.Random(2)
    text = words(rng, 200_000, 50_000)
    whole = shingle_sets([text, "x", text[:1000]], 5)
    w = text.split()
    assert len(whole[0]) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert set(whole[2][:-1]) & set(whole[0])


def test_decontamination_finds_edited_passages(spark, nothing, docs):
    rng = random.Random(8)
    item = words(rng, 40, 10**6)
    far = " ".join("z" + x for x in item.split())
    edited = item.replace(item.split()[5], "other").replace(item.split()[20] + " ", "")
    texts = [None, "", item, "before\n" + item.upper().replace(" ", ",  ") + "! after", "q " * 50_000 + edited + " r" * 1000, far, words(rng, 60, 10**6), item[: len(item) // 2]]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (None, "x y z")], "item_id long, text string")
    frame = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    for block in (decontamination.BLOCK_BYTES, 200):
        got = {r["doc_id"]: r for r in decontamination.find_leaks(frame, bench, block).collect()}
        assert sorted(got) == [2, 3, 4] and got[2]["distance"] == got[3]["distance"] == 0 < got[4]["distance"]
        assert texts[3][got[3]["start"] : got[3]["stop"]] == item.upper().replace(" ", ",  ")
        kept = decontamination.drop_leaks(frame, bench, block)
        assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 5, 6, 7]
    assert decontamination.find_leaks(nothing, bench).count() == 0
    assert decontamination.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (c != d)))
    return min(row), row.index(min(row))


def test_bit_parallel_distance_is_the_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        got = decontamination.best_match(item, text, decontamination._masks(item))
        assert got == edit_distance_in(item, text)


def test_long_items_keep_the_rate_of_edits(spark):
    rng = random.Random(12)
    item = words(rng, 600, 10**6)
    n = len(decontamination.normalised(item))
    assert n > 4000 and decontamination.budget(decontamination.normalised(item)) == int(n * 0.08)

    def edited(edits):
        out = list(item)
        for i in rng.sample([i for i, c in enumerate(item) if c.isdigit()], edits):
            out[i] = "z"
        return f"before it {''.join(out)} after it"

    texts = [edited(k) for k in (60, 100, 300, 500)]
    target, expected = np.array(list(decontamination.normalised(item))), {}
    for d, text in enumerate(texts):
        column = at = np.arange(n + 1)
        best = n
        for c in decontamination.normalised(text):
            step = np.concatenate([[0], np.minimum(column[1:] + 1, column[:-1] + (target != c))])
            column = np.minimum.accumulate(step - at) + at
            best = min(best, int(column[-1]))
        if best <= int(n * 0.08):
            expected[d] = best
    assert sorted(expected) == [0, 1, 2] and expected[1] > 64
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r["doc_id"]: r["distance"] for r in decontamination.find_leaks(frame, bench).collect()} == expected
    assert [r["doc_id"] for r in decontamination.drop_leaks(frame, bench).collect()] == [3]


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(60):
        parts, bounds = [], [0]
        for _ in range(rng.integers(1, 8)):
            s = rng.integers(1, rng.integers(2, 5), rng.integers(0, 40))
            parts.append(np.append(s, 0))
            bounds.append(bounds[-1] + len(s) + 1)
        flat = np.concatenate(parts)
        expected = [i for a, b in zip(bounds, bounds[1:], strict=False) for i in sorted(range(a, b), key=lambda i, b=b: tuple(flat[i:b]))]
        assert lyndon_suffixes.suffix_arrays(flat, np.array(bounds)).tolist() == expected


def test_repeats_are_removed(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, long = text(500), text(1500)
    texts = [None, "", text(399), long, long, "x" + long[:700], "the " * 300, text(200) + shared + text(200), shared + text(50), text(30) + shared[3:], shared[:398] + "#", long[100:1200] + text(400) + long[300:720]]
    texts += [text(rng.randrange(3)) + shared + text(rng.randrange(3)) for _ in range(40)]
    strings = Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        strings.update(b[s : s + 400] for s in range(len(b) - 399))
    expected = {}
    for i, b in enumerate(data):
        gone = bytearray(len(b))
        for s in range(len(b) - 399):
            if strings[b[s : s + 400]] > 1:
                gone[s : s + 400] = b"\1" * 400
        expected[i] = (len(b), bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])))
    frame = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    for together in (suffix_dedup.TOGETHER, 2):
        monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
        got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in suffix_dedup.remove_repeats(frame).collect()}
        assert got == expected
    assert suffix_dedup.remove_repeats(frame.limit(0)).count() == 0
    twice = suffix_dedup.remove_repeats(spark.createDataFrame([(None, long), (None, long), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], len(r["kept"])) for r in twice) == [(0, 0), (len(long.encode()), 0), (len(long.encode()), 0)]


def test_passages_of_over_50_words_mark_their_documents(spark, monkeypatch):
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("qrstuvé") for _ in range(n))
    passages = [text(51), text(50), text(70), text(120)]  # 51 words have some 160 bytes
    edited = passages[3].split()
    edited[60] = "changed"
    whole, line = text(90), text(51)
    texts = [f"{text(rng.randrange(80))}\n{p} {text(rng.randrange(80))}" for p in passages for _ in range(3)]
    texts += [None, "", text(50), text(51), text(300), whole, whole, whole.upper(), f"{line} {line} {line}", "same " * 200, "so " * 200, "so " * 60]
    texts += [" ".join(edited), passages[2].replace(" ", " \n\t"), text(4000) + " " + passages[0], " ".join(passages[3].split()[:50]), " ".join(passages[3].split()[40:91]), passages[0].replace("a", "A") + " end."]
    strings = Counter()
    lists = [(t or "").encode().lower().split() for t in texts]  # A-Z only
    for w in lists:
        strings.update({tuple(w[s : s + 51]) for s in range(len(w) - 50)})
    expected = {i: any(strings[tuple(w[s : s + 51])] > 1 for s in range(len(w) - 50)) for i, w in enumerate(lists)}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (suffix_dedup._WORDS_BLOCK, 100):
        monkeypatch.setattr(suffix_dedup, "_WORDS_BLOCK", block)
        got = suffix_dedup.remove_repeats(frame).selectExpr("doc_id", "shares_passage", "size(spans) AS n").collect()
        assert {r["doc_id"]: r["shares_passage"] for r in got} == expected
    assert any(r["shares_passage"] and not r["n"] for r in got) and 0 < sum(expected.values()) < len(texts)
    same = spark.createDataFrame([(None, whole), (None, whole), (None, None), (7, line)], "doc_id long, text string")
    assert sorted(r["shares_passage"] for r in suffix_dedup.remove_repeats(same).collect()) == [False, False, True, True]
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame, words=8)


def test_token_counts_match_the_encoder(docs, rows, nothing):
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding = token_counts._encoding(f.read())
    expected = {i: len(encoding.encode_ordinary(t or "")) for i, t, *_ in rows}
    for block in (1 << 18, 64, 1):
        small = docs.filter("length(text) < 500 or text is null") if block == 1 else docs
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(small, block_tokens=block).collect()}
        assert got == {i: n for i, n in expected.items() if i in got} and len(got) == small.count()
    assert token_counts.token_counts(nothing).count() == 0


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(2)
    expected = {}
    for name in ("a", "b", "c"):
        ids = rng.choice([7, 8, 9], 1000, p=[0.1, 0.45, 0.45]).astype("<u2")
        if name == "b":
            ids[-1] = 7
        if name == "c":
            ids[:] = 8
        (tmp_path / f"{name}.bin").write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 7)
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        tail = len(ids) - (ends[-1] + 1 if len(ends) else 0)
        expected[name] = [(int(n), True) for n in lengths] + ([(tail, False)] if tail else [])
    blocks = token_counts.read_token_files(spark, str(tmp_path), block_tokens=13)
    paths = {r["file"]: r["path"][-5] for r in blocks.select("file", "path").distinct().collect()}
    got = defaultdict(list)
    for r in token_counts.scan_separators(blocks, separator=7).orderBy("start", "n_tokens").collect():
        got[paths[r["file"]]].append((r["n_tokens"], r["closed"]))
    assert got == expected


def test_language_model_learns_and_gradients_are_right(spark):
    rng = random.Random(5)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    letters = {"xx": "abcdefg", "yy": "mnopqrst", "zz": "éèçabst"}
    data = [(i, make(letters[k], 40), k) for i, k in enumerate(list(letters) * 60)]
    data += [(900, None, "xx"), (901, "", "xx"), (902, "12 34 !", "xx"), (903, make(letters["yy"], 60_000), None), (904, "É", None)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(frame, epochs=8)
    got = {r["doc_id"]: r for r in language_id.identify_languages(frame.withColumnRenamed("lang", "score"), model).collect()}
    held = [(i, k) for i, t, k in data[:180] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == k for i, k in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "yy" and got[904]["lang_pred"] in letters
    steps, y = np.random.default_rng(0).integers(97, 101, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 0])
    params = [p.astype(np.float64) for p in (model.reads, model.turns, model.labels, model.offset)]
    known = np.ones((6, 4))
    known[4:, 1] = 0
    loss = lambda: language_id._gradient(language_id.Model(model.languages, *params), steps, known, y)
    for p, g in zip(params, loss()[1], strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-3
        up = loss()[0]
        p[at] -= 2e-3
        down = loss()[0]
        p[at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=2e-2)
    again = spark.createDataFrame([(1, "bonjour mes amis", None)] + [(1, f"good morning {k % 300}", "en") for k in range(600)], "doc_id long, text string, lang string")
    windows, labels = language_id.training_windows(again, docs_per_language=40)
    assert set(labels) <= {"en"} and len(windows) <= 40 * 6 and b"bonjour" not in b" ".join(windows)
    signs = spark.createDataFrame([(1, "\u00bd \u00b2 \u2460")], "doc_id long, text string")
    assert language_id.identify_languages(signs, model).first()["lang_pred"] == "und"
    empty = language_id.train(frame.limit(0))
    assert {r["lang_pred"] for r in language_id.identify_languages(frame, empty).collect()} == {"und"}


def test_toxicity_holds_out_and_swaps(spark):
    rng = random.Random(3)
    clean = lambda n: " ".join(rng.choice(["river", "stone", "market", "window", "garden", "paper"]) for _ in range(n))
    texts, labels = [], []
    for i in range(240):
        toxic = i % 2
        texts.append(f"{clean(8)}. {'muslims' if toxic else 'people'} {'vile' if toxic and i % 3 else 'went'} {clean(8)}.")
        labels.append(toxic)
    neutral = ["muslims went to the garden", "christians went to the garden"]
    plain, regular = (toxicity.fit(texts, labels, penalty=p) for p in (0.0, 10.0))
    apart = lambda m: np.ptp(-np.expm1(-toxicity.exposure(m, neutral)))
    assert apart(regular) < 0.5 * apart(plain) and regular.swaps > 0 == plain.swaps
    # insults that come with one group only: neutral mentions of it are false alarms until swaps are penalised
    biased = [f"{clean(6)} {'gay' if i % 2 else 'paper'} {'vile' if i % 2 and i % 8 != 1 else clean(1)} {clean(6)}." for i in range(240)]
    mentions = [f"the gay {clean(1)} went to the {clean(1)}" for _ in range(50)]
    alarms = lambda m: int((-np.expm1(-toxicity.exposure(m, mentions)) >= 0.5).sum())
    before, after = (alarms(toxicity.fit(biased, labels, penalty=p)) for p in (0.0, 10.0))
    assert before == 50 and after < 10
    # no text names a group: terms are placed
    named_none = toxicity.fit([clean(9) + (" vile" if i % 2 else "") for i in range(60)], [i % 2 for i in range(60)], epochs=2)
    assert named_none.swaps >= 60 and toxicity.fit(["", "!"], [0, 1]).swaps == 0
    data = [(i, f"{clean(30)} {'scumbag' if i % 3 == 0 else ''} {clean(30)}") for i in range(200)]
    frame = spark.createDataFrame([*data, (900, None), (901, ""), (902, clean(80_000)), (903, clean(80_000) + " SCUMBAG!"), (None, "scumbag")], "doc_id long, text string").selectExpr("*", "'k' as tox_score")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    assert model.swaps > 0
    shared = spark.createDataFrame([(2, f"text {k}") for k in range(50)] + [(4, "b")], "doc_id long, text string")
    assert len(toxicity.labelled_sample(shared, spark.createDataFrame([(2, 1), (2, 0), (4, 1), (4, 1)], "doc_id long, toxic int"))[0]) in (0, 1, 2, 3)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame, model).collect()}
    assert [i for i in range(200) if got[i]["tox_predicted"] != (i % 3 == 0)] == []
    assert [got[i]["tox_predicted"] for i in (900, 901, 902, 903, None)] == [0, 0, 0, 1, 1] and got[901]["tox_score"] == 0
    assert toxicity.score_toxicity(frame.limit(0), toxicity.train(frame, marks.limit(0))).count() == 0


def test_preferences(spark):
    turn = lambda p, s, n, role, text: (p, s, n, role, text, "x")
    data = [turn(1, s, 0, "system", "be kind") for s in ("chosen", "rejected")] + [turn(1, s, 1, "user", None) for s in ("chosen", "rejected")]
    data += [turn(1, "chosen", 2, "assistant", "good"), turn(1, "chosen", 3, "user", "more <|im_end|>"), turn(1, "chosen", 4, "assistant", "yes"), turn(1, "rejected", 2, "assistant", "bad")]
    data += [turn(2, "chosen", 0, "user", "alone"), turn(None, "chosen", 0, "user", "lost"), turn(3, "other", 0, "user", "?")]
    data += [turn(4, s, 0, "user", "same") for s in ("chosen", "rejected")] + [turn(4, "chosen", 1, "assistant", "longer")]
    got = {r["pair_id"]: r for r in chat_formatting.format_preferences(spark.createDataFrame(data, "pair_id long, side string, turn int, role string, text string, prompt string")).collect()}
    assert sorted(got) == [1, 2, 4]
    r = got[1]
    assert r["prompt_turns"] == 2 and r["prompt"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_loss"]] == ["good<|im_end|>\n", "yes<|im_end|>\n"]
    assert "more <| im_end|>" in r["chosen"] and [r["rejected"][s["start"] : s["end"]] for s in r["rejected_loss"]] == ["bad<|im_end|>\n"]
    assert got[2]["rejected"] is None and got[2]["prompt_turns"] == 0 and "alone" in got[2]["chosen"]
    assert got[4]["prompt_turns"] == 1 and got[4]["rejected"] == "" and got[4]["chosen_loss"]


def test_wide_token_ids(spark):
    small = spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string")
    narrow = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(small).collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(small, separator=70_000).collect()} == narrow


def test_preference_pairs_share_their_head(spark):
    data = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "b"), (1, 3, "user", "more"), (2, 0, "user", "x"), (None, 0, "user", "?"), (4, 0, "assistant", None)]
    data += [(3, k, "user" if k % 2 else "assistant", words(random.Random(k), 3000)) for k in range(9)]
    turns = spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn long, role string, text string, side int")
    got = {r["pair_id"]: r for r in chat_formatting.format_preferences(chat_formatting.pairs_with_other_answers(turns)).collect()}
    assert {k: r["prompt_turns"] for k, r in got.items()} == {0: 1, 1: 2, 2: 1, 3: 8, 4: 0}
    assert "a<|im_end|>" in got[0]["chosen"] and got[0]["rejected"].count("b<|im_end|>") == 2
    assert got[1]["rejected"] == "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert (got[2]["chosen"], got[2]["rejected"]) == ("", "") and "w" in got[3]["chosen"]
    assert chat_formatting.format_preferences(chat_formatting.pairs_with_other_answers(turns.limit(0))).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(21)
    items = [(k, " ".join(words(rng, 1, 60) for _ in range(rng.randrange(1, 20)))) for k in range(12)] + [(90, None), (91, "!?")]
    docs = []
    for i in range(80):
        text = words(rng, rng.randrange(0, 40), 60)
        if i % 2:
            chars = list(items[i % 12][1])
            for _ in range(rng.randrange(0, max(2, len(chars) // 8))):
                chars[rng.randrange(len(chars))] = rng.choice("abcdefg ")
            text = f"{text} {''.join(chars)} {text[:30]}"
        docs.append((i, text))
    docs += [(500, None), (501, ""), (2, docs[1][1]), (2, docs[1][1])]

    def least(item, text):  # Sellers: the item may start and end anywhere in the text
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in text:
            diagonal, row[0] = row[0], 0
            for k, x in enumerate(item, 1):
                diagonal, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, diagonal + (x != c))
            best = min(best, row[-1])
        return best

    expected = Counter()
    for i, text in docs:
        t = decontamination.normalised(text)
        for k, item in items:
            n = decontamination.normalised(item)
            if n and t and (d := least(n, t)) <= decontamination.budget(n):
                expected[i, k, d] += 1
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 100):
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in decontamination.find_leaks(frame, bench, block).collect()) == expected
    assert len(expected) > 20


def test_near_duplicates_near_the_threshold(spark):
    """Every pair from 0.8 to 0.85 is found, and ids that stand for two texts link by either."""
    rng = random.Random(5)
    rows, pairs = [], []
    for k in range(150):
        w = words(rng, rng.randrange(60, 400), 10**6).split()
        v = list(w)
        while True:
            v[rng.randrange(len(v))] = f"x{rng.random()}"
            a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (w, v))
            share = len(a & b) / len(a | b)
            if share < 0.85:
                break
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        pairs.append(share >= 0.8)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(150)] == pairs and sum(pairs) > 60
    a, b, c = (words(rng, 50, 10**6) for _ in range(3))
    shared = spark.createDataFrame([(5, a, 1), (5, b, 1), (5, b, 2), (7, a + " more", 1), (8, b + " more", 1), (9, c, 1)], "doc_id long, text string, _first int")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(shared).collect()} == {5: 5, 7: 5, 8: 5, 9: 9}
    kept = near_dedup.drop_near_duplicates(shared)
    assert kept.columns == shared.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(5, a), (5, b), (9, c)])


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (9, 1), (7, 8), (8, 7), (4, 4), (None, 2)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 3: 1, 5: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(41)}
