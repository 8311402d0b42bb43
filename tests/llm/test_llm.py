"""The training-data operators against brute force on small tables with nulls, empty texts, ties and rows that repeat."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillgraph.llm import bpe, chat, exact_dedup, langid, packing, pii, quality, rules, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, gid string, fp string"
random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]


def _text(n):
    return " ".join(random.choice(WORDS) + random.choice("xyz") for _ in range(n))


LONG = _text(400)
ROWS = [(1, LONG), (2, LONG), (3, LONG.replace(" ", "\n ")), (4, None), (5, ""), (6, " \t"), (7, LONG[:300] + _text(40)), (7, LONG[:300]), (7, LONG[:300]), (8, _text(3)), (9, "a" * 5000), (10, "aé" * 150 + LONG[500:900]), (None, LONG[100:400]), (11, LONG[3:] + " end")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, "r", "g", "f") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _strip(t):
    return re.sub("[ \t-\r]", "", t or "")


def test_exact_dedup(docs, none):
    got = sorted(((r["doc_id"] or 99, r["sha"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classes(docs).collect()), key=str)
    assert len(got) == len(ROWS) and sum(g[4] for g in got) == len({_strip(t) for _, t in ROWS})
    for i, sha, keep, n, _ in got:
        same = [(j, t) for j, t in ROWS if hashlib.sha256(_strip(t).encode()).hexdigest() == sha]
        assert n == len(same)
        assert keep == min(same, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len({_strip(t) for _, t in ROWS})
    assert exact_dedup.classes(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0


def test_simhash(docs, none):
    got = simhash.classes(docs).collect()
    fp = np.array([simhash.fingerprint(t) for _, t in ROWS], np.uint64)
    label = list(range(len(ROWS)))
    for _ in ROWS:
        for i in range(len(ROWS)):
            for j in range(len(ROWS)):
                if bin(int(fp[i]) ^ int(fp[j])).count("1") <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    want = sorted(str((i, min((j for (j, _), b in zip(ROWS, label) if b == a and j is not None), default=None))) for (i, _), a in zip(ROWS, label))
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == want
    assert simhash.near_dedup(docs).count() == len(set(label))
    assert simhash.classes(none).count() == 0


def test_simhash_links_all_within_four_bits():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(0b1111), base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64))]))
    links = simhash._forest(fps)
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert bin(int(a) ^ int(b)).count("1") <= 4
        parent[root(int(a))] = root(int(b))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(int(a) ^ int(b)).count("1") <= 4:
                assert root(int(a)) == root(int(b))


def test_substrings(docs, none):
    got = substring.remove_repeats(docs).collect()
    seen, want = set(), []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    # Rows with one id come in the order they are read in, so they are compared as a whole.
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))) for r in got)
    assert substring.remove_repeats(none).count() == 0


def test_transform_of_a_collection(monkeypatch):
    for span, step in ((3, 1), (7, 1), (8, 4), (12, 4), (6, 2)):
        monkeypatch.setattr(substring, "SPAN", span)
        monkeypatch.setattr(substring, "STEP", step)
        for _ in range(40):
            texts = [bytes(random.choice(b"ab\0") for _ in range(random.randint(span, 40))) for _ in range(random.randint(1, 8))]
            bwt, lcp = substring.transform(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts]), span)
            rows = sorted((t[k:], i, k) for i, t in enumerate(texts) for k in range(len(t) + 1))
            assert bwt.tolist() == [texts[i][k - 1] if k else 255 for _, i, k in rows]
            common = [next((n for n in range(span) if a[n : n + 1] != b[n : n + 1] or n >= len(a)), span) for (a, _, _), (b, _, _) in zip(rows, rows[1:])]
            assert lcp.tolist() == [0, *common]
            seen, want = set(), []
            for i, t in enumerate(texts):
                for k in range(len(t) - span + 1):
                    if t[k : k + span] in seen:
                        want.append((i, k))
                    seen.add(t[k : k + span])
            assert want == sorted((int(r), int(o) + q) for r, o, n in zip(*substring.met_before(texts)) for q in range(n))
            kept, low, high = substring.may_repeat(texts)
            parts = [texts[i][a : b + span] for i, a, b in zip(kept, low, high)]
            found = zip(*substring.met_before(parts)) if parts else []
            assert want == sorted((int(kept[r]), int(low[r] + o) + q) for r, o, n in found for q in range(n))


def test_chat_matches_the_plain_program(spark):
    rows = [(7, i, random.choice(["user", "assistant", "system", None, "tool"]), f"t{i}") for i in range(600)]
    rows += [(8, None, "assistant", None), (8, 1, "user", ""), (8, 1, "user", ""), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.format_chats(df).toPandas()
    assert len(got) == len(rows)
    choices, cost = chat.repair([r[2] for r in rows[:600]])
    own = got[got.conv_id == 7].sort_values("pos")
    assert own.cost.sum() == cost and own.role_out.tolist() == [chat.ROLES[c[0] - 1] for c in choices]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_near_dedup_is_brute_force(spark):
    """Every pair of similarity 0.8 or more of five-word shingle sets links, as far as the edits go; nothing below does."""
    rng = random.Random(7)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 300))] for _ in range(12)]
    foot = [f"licence{k}" for k in range(40)]
    rows = []
    for b in base:
        for k in range(12):
            w = list(b)
            for _ in range(rng.randrange(1 + len(w) // 40)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append(" ".join(w[: len(w) - rng.randrange(1 + len(w) // 8)] + foot * (k % 3 == 0)))
    rows += [None, "", "one two", "One  two", "one three"]
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) or frozenset([tuple(w)]) for w in ((t or "").lower().split() for t in rows)]
    label, wide = list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                wide += bin(simhash.fingerprint(rows[i]) ^ simhash.fingerprint(rows[j])).count("1") > 4
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "r", "g", "f") for i, t in enumerate(rows)], SCHEMA)
    assert wide > 50 and len(set(label)) > 20
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(df).collect()} == dict(enumerate(label))
    assert {r["doc_id"] for r in simhash.near_dedup(df).collect()} == set(label)


def test_pairs_between_components_are_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(500):
        rows = int(rng.integers(1, 40))
        key, n, root = rng.integers(-3, 3, rows), rng.integers(1, 14, rows), rng.integers(0, 4, rows)
        order = np.lexsort((n, key))
        key, n, root = key[order], n[order], root[order]
        unlike = [(i, j) for i in range(rows) for j in range(i + 1, rows) if key[i] == key[j] and root[i] != root[j]]
        got = [p for i, j in simhash._all_pairs(key, n, root) for p in zip(i.tolist(), j.tolist()) if root[p[0]] != root[p[1]]]
        assert sorted(got) == [(i, j) for i, j in unlike if 4 * n[j] <= 5 * n[i]]
        near = {p for i, j in simhash._adjacent(key, n, root) for p in zip(i.tolist(), j.tolist())}
        assert near == {(i, min(j for k, j in unlike if k == i)) for i, _ in unlike} | {(max(i for i, k in unlike if k == j), j) for _, j in unlike}


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for _ in range(300):
        pool = rng.integers(-(1 << 62), 1 << 62, 300)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(2))
        common = np.intersect1d(a, b).size
        assert common <= simhash.most_common(a.size, b.size, simhash.sketch(a), simhash.sketch(b)) <= min(a.size, b.size) + abs(a.size - b.size)
    assert simhash.most_common(200, 200, *(simhash.sketch(rng.integers(0, 1 << 62, 200)) for _ in range(2))) < 150


def test_chat_cost_is_least():
    def best(kinds, s=chat.START):
        if not kinds:
            return int(chat.END_COST[s])
        return min(c[1] + best(kinds[1:], c[0]) for c in chat.CHOICES[kinds[0]][s])

    for _ in range(60):
        roles = [random.choice(["user", "assistant", "system", "tool"]) for _ in range(random.randint(0, 6))]
        assert chat.repair(roles)[1] == best([chat.kind_of(r) for r in roles])


def test_pii_terms(spark, none):
    common = "mister " + " ".join(WORDS)
    rows = [(i, f"{WORDS[i % 8]} zanzibar writes ann{i % 2}@mail.example.com {common}") for i in range(8)]
    rows += [(i, f"{common} {WORDS[i % 8]}") for i in range(8, 200)] + [(200, None), (201, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "r", "g", "f") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(got) == len(rows) and all(r["n_email"] == (i < 8) for i, r in got.items())
    assert not any(r["extra"] for i, r in got.items() if i >= 8)
    assert pii.find(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all("[EMAIL]" in clean[i] for i in range(8)) and all(clean[i] == t for i, t in rows if i >= 8)


def test_pii_terms_by_brute_force(spark):
    """The term spans are those that the documented estimate gives, counted plainly."""
    import math

    rng = random.Random(3)
    rows = []
    for i in range(900):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(12)]
        if i % 30 == 0:
            words[5:5] = [f"Name{'abcdefghij'[i // 90]}", f"user{i // 90}@mail.example.com"]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame([(i, t, "en", "s", 0, "r", "g", "f") for i, t in rows], SCHEMA)
    held = [{t[a:b].lower() for _, a, b in pii.base_spans(t)} for _, t in rows]
    terms = [{w for w, _, _ in pii._words(t, pii.base_spans(t))} for _, t in rows]
    every = [set(pii.TERM.findall(t.lower())) for _, t in rows]
    given = {}
    for e in set().union(*held):
        n_e = sum(e in h for h in held)
        for w in set().union(*(t for h, t in zip(held, terms) if e in h)):
            n_t, n_et = sum(w in x for x in every), sum(e in h and w in t for h, t in zip(held, terms))
            share, z, n = n_et / n_t, pii.Z, n_t
            if n_et < pii.SUPPORT:
                share = (share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            g = 1 + math.log(share) / math.log(len(rows) / n_e)
            if share >= pii.LEAST and g >= pii.GENERALISE:
                given[w] = max(g, given.get(w, 0))
    want = {i: sorted((a, b, "gone" if given[w] >= pii.REMOVE else "term") for w, a, b in pii._words(t, pii.base_spans(t)) if w in given) for i, t in rows}
    got = {r["doc_id"]: sorted((x["a"], x["b"], x["kind"]) for x in r["extra"] or []) for r in pii.find(df).collect()}
    assert got == want and sum(map(len, want.values())) >= 30


def test_pii_many_spans_cost_no_square():
    import time

    t = " ".join(f"name{i} x{i}@mail.example.com" for i in range(3000))
    at = time.perf_counter()
    assert len(list(pii._words(t, pii.base_spans(t)))) == 3000 and time.perf_counter() - at < 5


def test_pipeline(spark, tmp_path):
    """The stages one after another, as the tool runs them: what each drops and changes, and that earlier stages' tables are deleted."""
    import corpus_pipeline
    from quillgraph.llm import common

    good = [_text(60) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0].replace(" ", "  ")), (101, good[1] + " alphax"), (102, good[2] + " mail kim@mail.example.com")]
    rows += [(200 + i, _text(40).upper().replace(" ", "!! ")) for i in range(30)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, ids = df, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r[0] for r in docs.select("doc_id").collect()})
    keep = set(range(30)) | {100, 101, 102}
    assert ids[0] == keep and ids[1] == keep - {0} and ids[2] == keep - {0, 101, 102} and ids[3] == ids[2]
    before = common.left()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == ids[3] and not (before & common.left() & corpus_pipeline._stages_left)


def test_pii_terms_anywhere(spark):
    """A disclosing term far from its entity is found, and goes wherever it stands."""
    far = " ".join(WORDS * 20)
    rows = [(i, f"Quillon {far} kim@mail.example.com {far} quillon said") for i in range(4)] + [(4, f"quillon {far}")] + [(i, far) for i in range(5, 400)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "r", "g", "f") for i, t in rows], SCHEMA)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for i in range(5):
        assert "quillon" not in clean[i].lower() and all(w in clean[i] for w in WORDS)
    assert all(clean[i] == t for i, t in rows if i > 4)


def test_pii_terms_of_rare_entities(spark):
    """An entity of one or two documents has its disclosing terms estimated; common words stay."""
    rows = [(0, "alpha Quillon beta kim@mail.example.com gamma")] + [(i, "alpha Zanzibar beta +49 30 1234 5678 gamma") for i in (1, 2)]
    rows += [(i, "alpha beta gamma") for i in range(3, 9000)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "r", "g", "f") for i, t in rows], SCHEMA)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[0] == "alpha [TERM] beta [EMAIL] gamma" and clean[1] == clean[2] == "alpha [TERM] beta [PHONE] gamma"
    assert all(clean[i] == t for i, t in rows[3:])


def test_pii_base_spans_match_the_patterns():
    for t in ["x a.b@c.d.e, @no.x a@@b.c.d a@b", "1.2.3.4.5 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111 1111 1111 1112", "+49 (30) 1234-567 +1 2", "9" * 5000, "a." * 4000 + "@x.y"]:
        want = [(m.start(), m.end()) for m in pii.EMAIL.finditer(t)] if len(t) < 1000 else [(0, len(t))] if "@" in t else []
        assert [(a, b) for k, a, b in pii.base_spans(t) if k == "email"] == want
    assert pii.told(pii.base_spans("1.2.3.4.5, 4111 1111 1111 1111")) == "ip:0:7,card:11:30"


def test_langid(spark, docs, none):
    texts = [("the cat and the dog of the house " * 3, "en"), ("le chat et la maison des amis ", "fr"), ("der hund und die katze von dem haus", "de")]
    df = spark.createDataFrame([(i, texts[i % 3][0] + _text(2), texts[i % 3][1], "s", 0, "r", "g", "f") for i in range(90)] + [(90, None, "en", "s", 0, "", "", ""), (91, "12 34", "en", "s", 0, "", "", "")], SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(df, langid.fit(df)).collect()}
    assert all(got[i]["lang_pred"] == texts[i % 3][1] for i in range(90)) and got[90]["lang_pred"] == got[91]["lang_pred"] == "und"
    assert langid.identify(none, langid.fit(none)).count() == 0
    for k in (2, 4, 6, 30):
        c = langid.codewords(k)
        assert len({tuple(r) for r in c}) == k


def test_langid_sample(spark, monkeypatch):
    """The sample is the SAMPLE rows of least hash a language, where many rows share an id too."""
    monkeypatch.setattr(langid, "SAMPLE", 10)
    monkeypatch.setattr(langid, "SLACK", 1)
    monkeypatch.setattr(langid, "train", lambda texts, langs: list(zip(langs, texts)))
    df = spark.createDataFrame([(None if i % 3 else i, f"text{i:03d}", "ab"[i % 2], "s", 0, "r", "g", "f") for i in range(300)], SCHEMA)
    rows = df.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").selectExpr("lang", "text", "xxhash64(doc_id) as h").collect()
    want = [(a, r["text"]) for a in "ab" for r in sorted((r for r in rows if r["lang"] == a), key=lambda r: (r["h"], r["text"]))[:10]]
    assert langid.fit(df) == want


def test_quality(spark, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(i, _text(40) if i % 2 else _text(40).upper().replace(" ", "!! "), "en", "s", 0, "r", "g", "f") for i in range(200)] + [(None, None, None, None, None, None, None, None)], SCHEMA)
    model = quality.fit(df, labels)
    got = quality.classify(df, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None)
    assert quality.keep_good(df.where("doc_id is not null"), model).count() == 100
    assert quality.classify(none, quality.fit(none, labels.limit(0))).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    assert len(got) >= len(ROWS) and packing.pack(none).count() == 0
    demand = np.random.default_rng(3).integers(0, 50, 65)
    demand[0] = 0
    plan = packing.plan(demand, 64)
    assert (sum(n * p for p, n in plan) == demand).all() and all((p * np.arange(65)).sum() <= 64 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.05 * (demand * np.arange(65)).sum() / 64 + 64


def test_encoder_is_the_tokenizer():
    enc = packing.encoder(packing.tokenizer_path())
    letters = [chr(c) for c in range(0x21, 0xFFFF) if chr(c).isalpha() and (c < 0x3000 or c % 13 == 0) and not 0xD800 <= c < 0xE000]
    marked = [f"ab{c},x AB{c}. {c}{c}'s" for c in letters]
    for t, raw in zip(marked, enc(marked)):  # every letter as a word's last before a comma or full stop
        assert np.frombuffer(raw, "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    for t in ["Hello, World.", "ΑΣ ΣΑ. don't   stop...", "x y <|endoftext|> z", "É é İ 12a", "a" * 300, ""]:
        assert np.frombuffer(enc([t])[0], "<u4").tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_bpe_is_tiktoken(docs, none):
    import public_tokenizers
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe.vocab_path()), special_tokens={})
    c = bpe.coder(bpe.vocab_path(), public_tokenizers.PATTERN)
    for t in ["foo  bar", "a   b \n c", "  x", "x  ", "x\n \n", "aaaa" * 300, "".join(random.choice("etaoinsh") for _ in range(700)), "don't   stop", "1 2  3\r\n\r\n 4", "été " * 50, ""] + [t for _, t in ROWS if t]:
        ids = ref.encode_ordinary(t)
        assert c.encode(t) == ids and c.decode(ids) == t.encode()
        assert c([t])[0] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.digests(docs).count() == len(ROWS) and bpe.digests(none).count() == 0


def test_rules(docs, none):
    for r in rules.judge(docs).where("doc_id is not null and doc_id <> 7").collect():
        t = dict(ROWS)[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len("".join(w)), len(hit), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert rules.judge(none).count() == 0
