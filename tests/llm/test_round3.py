"""Manifests, aligned tokenizers and simhash, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import alignment, byte_pairs, manifest, simhash, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank long, grp string, fingerprint string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, n, 1, 2, "x", "y") for i, t, g, s, n in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", "  ", "Ab C", "é É", *(words(rng, rng.randrange(1, 60)) + " End" for _ in range(90))]
    out = [(i * 3 - 4, t, [None, "", "en", "en", "en", "en", "én"][i % 7], None if i % 4 == 0 else f"s{i % 3}", None if i % 5 == 0 else i) for i, t in enumerate(texts)]
    # a group of one row, rows that share an id, rows that are alike, a null id
    return [*out, (7, "alone", "zz", "s", 1), (8, "One", "en", "s", 1), (8, "two", "en", "s", 1), (9, "Same", "en", "s", 1), (9, "Same", "en", "s", 1), (None, "No id", "en", "s", 1)]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, text, lang, source, n):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree(leaves, arity):
    """The root, and each leaf's siblings and places from the leaf up."""
    level, proof, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // arity * arity : place // arity * arity + arity]
            proof[k].append((place % arity, run[: place % arity] + run[place % arity + 1 :]))
            at[k] = place // arity
        level = [digest(*level[s : s + arity]) for s in range(0, len(level), arity)]
    return level[0], proof


@pytest.mark.parametrize(("arity", "height"), [(8, 3), (2, 1), (3, 2), (8, 1)])
def test_manifest_against_brute_force(spark, rows, arity, height):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    roots, wanted = {}, Counter()
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        roots[g] = tree([leaf(*r) for r in groups[g]], arity)
    root, tops = tree([roots[g][0] for g in order], arity)
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], roots[g][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r[0], r[1].translate(low) if hit and r[1] else r[1], *r[2:])
            for place, others in [*path, *top]:
                node = digest(*others[:place], node, *others[place:])
            wanted[r[0], leaf(*r), roots[g][0], root, digest(*(s for _, others in [*path, *top] for s in others)), node, node == root] += 1
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    lower = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    got = manifest.verified_manifest(frame(spark, rows), tampered, lower, arity=arity, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, got.collect()))
    # rows that are alike exchange places, not proofs
    assert Counter(k[:4] for k in found.elements()) == Counter(k[:4] for k in wanted.elements())
    assert found == wanted
    assert any(not k[-1] for k in found) and any(k[-1] for k in found)


def test_manifest_of_nothing_and_of_one(spark, rows):
    assert manifest.manifest(frame(spark, rows).limit(0)).count() == 0
    one = manifest.manifest(frame(spark, rows[3:4])).first()
    assert one["leaf"].hex() == leaf(*rows[3]) == one["root"].hex() == one["subroot"].hex() and one["places"] == [] and one["siblings"] == []


def test_manifest_of_many_equal_rows(spark):
    many = [(1, "the same", "en", "s", 1)] * 700 + [(i, "other", "en", "s", 1) for i in range(2, 40)]
    got = manifest.verified_manifest(frame(spark, many), F.lit(False), {})
    assert got.filter("verified").count() == 738
    root, proof = tree([leaf(*r) for r in many], 8)
    wanted = Counter((r[0], root, digest(*(s for _, others in path for s in others))) for r, path in zip(many, proof, strict=True))
    assert Counter(map(tuple, got.select("doc_id", "root", "proof_sha256").collect())) == wanted


def brute_alignment(texts, a_path=alignment.VOCABULARY_A, b_path=alignment.VOCABULARY_B):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    of_a, of_b = alignment.token_bytes(byte_pairs.read_vocabulary(a_path), byte_pairs.read_vocabulary(b_path))
    told = []
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if b"".join(of_a[i] for i in ids_a) != raw or b"".join(of_b[i] for i in ids_b) != raw:
            ids_a, ids_b = [], []
        spans = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(of[i]), i))
                at += len(of[i])
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts, groups = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]}), []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for s, e, i in side if lo <= s and e <= hi) for side in spans))
        told.append((len(ids_a), len(ids_b), links, groups))
    count = Counter(pair for *_, links, _ in told for pair in links)
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(na, nb, len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), ";".join(groups)) for na, nb, links, groups in told]


def test_alignment_against_brute_force(spark):
    rng = random.Random(8)
    alphabet = ["the ", "Token", "izer ", "é", "naïve ", "\n", "  ", "\t", "中文", "😀", "<s>", "<|endoftext|>", "<0x41>", "12345 ", "don't ", "!?", "▁", "\x00", "ing "]
    texts = [None, "", " ", "▁", "a", "the the the", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(60)), "the the the", " " * 3000, "x" * 2500, "word after word " * 300]
    rows = [(None if k == 9 else k % 60, t, "en", "s", 1) for k, t in enumerate(texts)]
    wanted = Counter((r[0], *w) for r, w in zip(rows, brute_alignment(texts), strict=True))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for most in (alignment.MAX_PAIRS, 40):
        got = alignment.align_tokens(frame(spark, rows), max_pairs=most)
        assert got.columns == names
        assert Counter(map(tuple, got.collect())) == wanted
    assert alignment.align_tokens(frame(spark, rows).limit(0)).count() == 0
    assert alignment.align_tokens(frame(spark, rows[:2])).select("n_a", "groups").collect() == [(0, ""), (0, "")]


def test_alignment_in_small_windows(monkeypatch):
    vocabularies = [byte_pairs.read_vocabulary(p) for p in (alignment.VOCABULARY_A, alignment.VOCABULARY_B)]
    texts = ["", "one two three four", None, "wordsoflengthwithoutgapsatallinthem " * 5, "é" * 40, "", "end"]
    ids = alignment._encoded(texts, *vocabularies)
    import pyarrow as pa

    a, b = (pa.array([x.astype("<u4").tobytes() for x in side], pa.binary()) for side in ids)
    size_a, size_b, shown_a, shown_b = alignment._tables(*vocabularies)

    def told():
        groups = [b""] * len(texts)
        n = np.zeros((2, len(texts)), int)
        for w in alignment._Batch(a, b, size_a, size_b, "<u4").windows():
            n[0, w.docs] += w.by_document(w.cuts)
            n[1, w.docs] += w.by_document(w.ends)
            for k, text in enumerate(w.groups(shown_a, shown_b), w.first):
                groups[k] += text
        return groups, n.tolist()

    whole = told()
    wanted = brute_alignment(texts)
    assert whole == ([w[-1].encode() for w in wanted], [[w[2] for w in wanted], [w[3] for w in wanted]])
    for window in (1, 3, 17):
        monkeypatch.setattr(alignment, "WINDOW", window)
        assert told() == whole


def test_encoding_of_long_runs_and_pieces():
    lines, told = (byte_pairs.read_vocabulary(f"/opt/tokenizers/{n}") for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    assert byte_pairs.ranks_of_lines(lines) == byte_pairs.ranks_of_json(told)
    from tokenizers import Tokenizer

    plain, own, rng = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json"), byte_pairs.json_encoding(told), random.Random(1)
    plain.encode_special_tokens = True
    for _ in range(40):
        text = "".join(rng.choice(["a", "B ", " ", "\n", "\t", " 12", "é", " ", "　", "!", "'s", "<|endoftext|>", " " * 1200, "\n" * 1001, " " * 998 + "\x1c", "\x85 " * 600, "x" * 1500]) for _ in range(40))
        assert own.encode_ordinary(text) == plain.encode(text, add_special_tokens=False).ids
        pieces = list(byte_pairs.word_pieces(text, 50))
        assert "".join(pieces) == text and sum(map(own.encode_ordinary, pieces), []) == own.encode_ordinary(text)
    token = {i: t for t, i in own.ranks.items()}
    for text in (" " * 10**6, "\n" * 10**6, " \n" * 500_000, "a" * 10**6, "x" + " " * 10**6 + "y"):
        ids = own.encode_ordinary(text)
        assert b"".join(token[i] for i in ids) == text.encode()


def test_token_counts_of_long_runs(spark):
    runs = [" " * 10**6, "\n" * 10**6, "a" * 10**6, " \n" * 500_000, "a" + " " * 10**6 + "b"]
    own = byte_pairs.line_encoding(byte_pairs.read_vocabulary(token_counts.VOCABULARY))
    got = token_counts.token_counts(frame(spark, [(k, t, "en", "s", 1) for k, t in enumerate(runs)])).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(own.encode_ordinary(t)) for k, t in enumerate(runs)}


def brute_fingerprint(text):
    import xxhash

    tokens = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    shingles = [b" ".join(tokens[k : k + 4]) for k in range(len(tokens) - 3)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    at = {p: p for p in prints}

    def top(p):
        while at[p] != p:
            p = at[p]
        return p

    prints = sorted(at)
    for k, p in enumerate(prints):
        for q in prints[k + 1 :]:
            if (p ^ q).bit_count() <= distance:
                at[max(top(p), top(q))] = min(top(p), top(q))
    return {p: top(p) for p in prints}


def test_fingerprints_are_those_of_single_bits(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \t", "One", "one two THREE", "a b c d", "É é É é É", "x y z w v u", words(rng, 500), "long" * 300_000 + " a b c d", *(words(rng, n) for n in range(1, 30))]
    wanted = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == wanted
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert [simhash.fingerprint(t) for t in texts] == wanted
    told = spark.createDataFrame([("one two three four",)], "t string").select(F.xxhash64("t").alias("h")).first()["h"]
    assert told % (1 << 64) == simhash.fingerprint("ONE two\nthree four")


def near_prints(rng):
    """Random prints, chains of prints within a few bits, and many that share all but their last byte or two."""
    out = {rng.getrandbits(64) for _ in range(400)} | {0, 3, 7 << 60, (1 << 64) - 1}
    for start in list(out)[:60]:
        p = start
        for _ in range(rng.randrange(1, 8)):
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                p ^= 1 << bit
            out.add(p)
    base = rng.getrandbits(64)
    return out | {base ^ rng.getrandbits(12) for _ in range(300)} | {base ^ (rng.getrandbits(10) << 40) for _ in range(100)}


@pytest.mark.parametrize("options", [{}, {"list_most": 8, "cell": 16}, {"list_most": 1, "cell": 5}, {"list_most": 3, "cell": 50}])
def test_links_of_fingerprints_against_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(simhash, "FILTER_KEYS", options.get("list_most", 2000) * 3)
    rng = random.Random(len(options) + 3)
    prints = near_prints(rng)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(3)
    for distance in (4, 2) if not options else (4,):
        links = simhash.fingerprint_links(nodes, distance, **options).collect()
        at = {p: p for p in prints}

        def top(p, at=at):
            while at[p] != p:
                p = at[p]
            return p

        for r in links:
            a, b = top(r["a"] % (1 << 64)), top(r["b"] % (1 << 64))
            at[max(a, b)] = min(a, b)
        assert {p: top(p) for p in prints} == brute_components(prints, distance)
    with pytest.raises(ValueError):
        simhash.fingerprint_links(nodes, 5)


def test_simhash_components(spark):
    rng = random.Random(6)
    base = [words(rng, rng.randrange(40, 300)) for _ in range(30)]
    texts = [None, "", "  ", "one", "One", "a b c", *base, *base[:5], *(b.upper() for b in base[5:8])]
    for b in base:
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(None if k in (3, 40) else 1000 - k - (k == 7), t, "en", "s", 1) for k, t in enumerate(texts)]
    prints = [brute_fingerprint(t) for t in texts]
    whole = brute_components(set(prints), 4)
    least = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            least[whole[p]] = min(i, least.get(whole[p], i))
    wanted = Counter((r[0], p - (1 << 64) if p >> 63 else p, least.get(whole[p])) for r, p in zip(rows, prints, strict=True))
    got = simhash.near_duplicates(frame(spark, rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == wanted
    assert len({c for *_, c in wanted}) < len(set(prints))
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    hot = frame(spark, [(i, "the same text of many rows" if i % 3 else f"text number {i} of its own kind", "en", "s", 1) for i in range(900)])
    assert simhash.near_duplicates(hot).filter("component_id = 1").count() >= 600
