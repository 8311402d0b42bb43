"""Chunk reuse for BPE against the tokenizer, TPUT and exact k-means against brute force."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import centroids, chunk_bpe, lexical, packing

SCHEMA = "doc_id long, text string, key string, id string, no int, digest string, shared string, ids string, want string, rid long, q long, tid long, block string"
rng = random.Random(11)
SYLLABLES = ["the", "an", "er", "Ör", "ció", "n't", "it's", "12", ",", "…", "語", "ᄒ", "é", "é", "Σ", "<|endoftext|>", "<|", "🙂", " ", "\x85", "İ"]


def _words(n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


SHARED = _words(700)
TEXTS = [SHARED, SHARED, "x" + SHARED, _words(30) + SHARED + _words(40), "<|endof" + SHARED[5:], SHARED.replace(" ", "\n"), None, "", " ", "a" * 20_000, "b" + "a" * 20_000, "aé語" * 4000, "語" * 9000, SHARED[:900] * 12, _words(5)]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(0, SHARED), (None, SHARED), (99, _words(20_000) + SHARED)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, *["z"] * 2, 1, *["z"] * 4, 5, 6, 7, "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def _want(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_chunk_bpe_equals_the_tokenizer(spark, tok):
    got = sorted(str((r["doc_id"], *r[1:4])) for r in chunk_bpe.encode(_frame(spark, DOCS)).collect())
    assert got == sorted(str((i, *_want(tok, t))) for i, t in DOCS)
    assert chunk_bpe.encode(_frame(spark, [])).count() == 0
    one = chunk_bpe.encode(_frame(spark, [(1, "Hello wörld")]), keep_ids=True).first()
    assert np.frombuffer(one["ids"], "<u4").tolist() == tok.encode("Hello wörld", add_special_tokens=False).ids


def test_cuts_follow_the_content():
    shared = _words(3000).encode()
    pieces = []
    for before in (b"", b"abc def " * 99, "語".encode() * 1001):
        data = np.frombuffer(before + shared, np.uint8)
        c = chunk_bpe.cuts(data, np.array([0, data.size]))[0]
        assert c[0] == 0 and c[-1] == data.size and all(0 < b - a <= chunk_bpe.MOST for a, b in zip(c, c[1:]))
        for a, b in zip(c, c[1:]):
            data[a:b].tobytes().decode()  # no character is parted
        pieces.append({data[a:b].tobytes() for a, b in zip(c, c[1:])})
    assert len(pieces[0] & pieces[1] & pieces[2]) > 0.8 * len(pieces[0])
    # The hash is that of the window alone.
    data = np.frombuffer(shared, np.uint8)
    assert chunk_bpe.rolling(data)[500:700].tolist() == chunk_bpe.rolling(data[400:])[100:300].tolist()


def test_joins_are_repaired_wherever_the_cuts_fall(tok):
    enc = packing.Encoder(packing.tokenizer_path())
    joiner = chunk_bpe.Joiner(enc)
    for _ in range(60):
        text = rng.choice([_words(rng.randint(1, 60)), "ab" * rng.randint(1, 300), "don't <|endoftext|> it's" * 9])
        at = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(1, 12))))
        cut = [len(text[:x].encode()) for x in [0, *at, len(text)]]
        raw = text.encode()
        own = [(a, b, enc([raw[a:b].decode()])[0]) for a, b in zip(cut, cut[1:])]
        assert np.frombuffer(joiner.joined([raw], [own])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_window_grows_until_guards_agree():
    """An encoder that counts equal words in a row, so that ids hang on words far away."""

    def enc(texts):
        out = []
        for t in texts:
            runs = []
            for w in t.split():
                if runs and runs[-1][0] == w:
                    runs[-1][1] += 1
                else:
                    runs.append([w, 1])
            out.append(b"".join(struct.pack("<I", ord(w[0]) * 1000 + n) for w, n in runs))
        return out

    text = b"b c " + b"a " * 37 + b"d e"
    joiner = chunk_bpe.Joiner(enc)
    for cut in range(4, len(text), 2):
        own = [(0, cut, enc([text[:cut].decode()])[0]), (cut, len(text), enc([text[cut:].decode()])[0])]
        assert joiner.joined([text], [own]) == enc([text.decode()])
    assert joiner.grown > 20


# --- TPUT


def _brute(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    tf = [Counter(words(t)) for _, t in docs]
    n = [sum(c.values()) for c in tf]
    big_n, big_l = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in tf for w in c)
    out = []
    for item, text in items:
        scored = []
        for at, ((i, _), c) in enumerate(zip(docs, tf)):
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * (50 + 50 * n[at] * big_n // big_l))) for w in set(words(text)) if c[w])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _texts(n, vocabulary):
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 60))) for _ in range(n)]


def test_search_equals_brute_force(spark):
    vocabulary = [f"{a}{b}" for a in ("tha", "Ein", "Über", "das", "λό") for b in ("r", "s-t", "_", "9", "É", "语", "q")]
    texts = _texts(400, vocabulary)
    docs = list(enumerate(texts)) + [(3, texts[3]), (700, None), (701, ""), (702, "-- ++"), (None, texts[5]), (703, "thar " * 5000)] + [(800 + i, texts[7]) for i in range(90)]
    items = [(1, texts[0]), (1, texts[9]), (2, " ".join(vocabulary)), (3, None), (4, "zzzz unknown"), (5, "THAR thar"), (None, "ein9"), (6, texts[7])]
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, q int, tid int")
    for k, most in ((50, lexical.TERMS), (3, lexical.TERMS), (10, 7)):
        got = sorted(map(tuple, lexical.search(*frames, k=k, most_terms=most).select("item_id", "rank", "doc_id", "score").collect()), key=str)
        assert got == _brute(docs, items, k)
    assert lexical.search(frames[0].limit(0), frames[1]).count() == 0 and lexical.search(frames[0], frames[1].limit(0)).count() == 0


def test_threshold_is_the_largest_safe_one():
    for _ in range(300):
        most = [rng.randint(0, 30) for _ in range(rng.randint(1, 8))]
        bound = rng.randint(0, sum(most))
        safe = [t for t in range(1, 40) if sum(min(t - 1, m) for m in most) < bound]
        assert lexical.threshold(bound, most) == max([1, *safe])
    assert lexical.threshold(0, []) == 1 and lexical.threshold(10, [0, 0]) == 1


def test_share_in_wide_integers():
    assert lexical.share(np.array([3]), np.array([2**40]), 2**30, 2**50).tolist() == [10**9 * 3 // (3000 + 20 * (50 + 50 * 2**70 // 2**50))]


# --- k-means


def _kmeans(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in first[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = [[] for _ in c]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        c = [[sum(col) // len(g) for col in zip(*g)] if g else m for g, m in zip(groups, c)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, j, d in got:
        inertia[j] += d
    fit = lambda x: x if x < 2**63 else None
    return sorted((str((i, j, fit(d), fit(inertia[j]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())) for i, j, d in got))


VECTORS = "vec_id long, embedding array<float>, v int, id string, ids int, x int"


def _vectors(n):
    g = np.random.default_rng(4)
    return [(i, (g.normal(size=64) + (i % 3)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("kind", ["plain", "wide", "huge", "few", "none"])
def test_kmeans_equals_brute_force(spark, kind):
    rows = _vectors(300)
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64), (306, [float("inf")] * 64), (307, rows[0][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[9][1]), (308, [0.0] * 64), (309, [-0.0] * 64)]
    rows = {"plain": rows, "wide": [*rows, (400, [3e9] * 64), (401, [-3e9] + [0.5] * 63)], "huge": [*rows, (400, [3e30] * 64), (401, [-1e35] + [0.3] * 63), (402, [2e17] * 64)], "few": rows[:5] + rows[300:307], "none": rows[300:307]}[kind]
    got = centroids.cluster(spark.createDataFrame([(i, v, 1, "a", 2, 3) for i, v in rows], VECTORS).repartition(3))
    assert sorted(str(tuple(r)) for r in got.collect()) == _kmeans(rows)


def test_distances_are_exact_in_all_kinds_of_numbers():
    g = np.random.default_rng(1)
    for most in (1000, 1 << 20, 1 << 24, 1 << 27, 1 << 40):
        x, c = g.integers(-most, most, (50, 64)), g.integers(-most, most, (8, 64))
        want = [[sum((a - b) ** 2 for a, b in zip(p, q)) for q in c.tolist()] for p in x.tolist()]
        assert [[int(v) for v in row] for row in centroids.distances(x, c)] == want
        own = np.arange(50) % 7
        sums = [[sum(r[j] for r, o in zip(x.tolist(), own) if o == i) for j in range(64)] for i in range(8)]
        assert [[int(v) for v in row] for row in centroids.sums(x, own, 8)] == sums
        for bounds in ((1, 1 << 63), (1, 1)):  # the fallbacks give the same
            if most <= 1 << 20:
                assert [[int(v) for v in row] for row in centroids.distances(x, c, *bounds)] == want
            assert [[int(v) for v in row] for row in centroids.sums(x, own, 8, *bounds)] == sums
