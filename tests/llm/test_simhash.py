import random

import numpy as np
import pyarrow as pa
import xxhash

from shelfmerge.llm import simhash
from shelfmerge.llm.components import components
from shelfmerge.llm.words import find_words, mix, text_bytes

ID_TEXT = "doc_id bigint, text string"


def slow_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, distance=3):
    """fps: list of (doc_id, fp); all pairs."""
    parent = {d: d for d, _ in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(fps):
        for b, y in fps[:i]:
            if (x ^ y).bit_count() <= distance:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d, _ in fps}


def test_fingerprints_match_definition():
    texts = [None, "", " \t", "One", "A b", "a b c", "A B\x0bC d é É " * 40, "x" * 10]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == slow_fingerprint(t)


def test_long_text_counts_all_chunks(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text.encode()) == whole == slow_fingerprint(text)


def test_links_equal_brute_force_with_dense_groups(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
        for _ in range(40):  # one half shared, the other varied
            fps.add((b & 0xFFFFFFFF) | (rng.getrandbits(6) << 40))
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    want = slow_components(rows)
    by_fp = {x.to_bytes(8, "big"): i for i, x in rows}
    nodes = spark.createDataFrame([(bytearray(f),) for f in by_fp], "fp binary")
    for limit in (4096, 8):
        got = {bytes(r.node): bytes(r.root) for r in components(simhash.links_between(nodes, limit)).collect()}
        groups = {}
        for f, i in by_fp.items():
            groups.setdefault(got.get(f, f), set()).add(i)
        expected = {}
        for i, r in want.items():
            expected.setdefault(r, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_chain_and_of_nothing(spark):
    n = 200
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "u bigint, v bigint")
    assert {r.root for r in components(links).collect()} == {0}
    assert components(links.filter("u < 0")).count() == 0


def test_report_matches_brute_force(spark):
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "other")
    rows = [(5, base), (3, near), (9, base), (1, None), (2, ""), (4, "short one"), (4, "short one"), (7, "none of it here")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], ID_TEXT + ", fingerprint string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicate_report(df).collect()}
    fps = [(i, slow_fingerprint(t)) for i, t in dict(rows).items()]
    comp = slow_components(fps)
    assert got == {(i, f"{x:016x}", comp[i]) for i, x in fps}
    assert comp[2] == 1
    kept = sorted(r.doc_id for r in simhash.keep_one(df).collect())
    assert kept == [1, 3, 4, 7]  # 1 and 2 have no words, 3, 5 and 9 are alike
    assert simhash.keep_one(df.filter("doc_id < 0")).count() == 0


def test_one_of_each_group_stays_whatever_ids_repeat(spark):
    texts = [" ".join(f"{c}{i * i}" for i in range(60)) for c in "abc"]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (2, texts[1], "y"), (2, texts[2], "y"), (None, texts[2], "z"), (2, texts[2], "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, text_key string")
    got = simhash.keep_one(df)
    assert got.dtypes == df.dtypes
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (0, texts[2])])


def slow_wide(text):
    """Five-word shingles of a text, and its 192 majority bits, shingle by shingle."""
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    ones, n = np.zeros(192, int), 0
    for i in range(max(0, len(words) - 4)):
        w = find_words(*text_bytes(pa.array([" ".join(words[i : i + 5])]))).hash
        a = w[0:1]
        for x in w[1:]:
            a = mix(a * np.uint64(0x9E3779B97F4A7C15) + x)
        h = np.concatenate([a, mix(a ^ np.uint64(0xC2B2AE3D27D4EB4F)), mix(a ^ np.uint64(0xE7037ED1A0B428DB))])
        ones += np.unpackbits(h.view(np.uint8))
        n += 1
    return set(zip(*(words[k:] for k in range(5)))), np.packbits(2 * ones > n).tobytes()


def test_wide_fingerprints_match_definition(monkeypatch):
    texts = ["A b c d e", "One, two; three-four. É five six " * 30, None, "", "- -", *(" ".join(f"w{i % 91}" for i in range(n)) for n in (5, 9, 700))]
    want = [slow_wide(t)[1] for t in texts]
    assert [x.tobytes() for x in simhash.wide_fingerprints(pa.array(texts))] == want
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(simhash, "ADDED", 7)
    assert [x.tobytes() for x in simhash.wide_fingerprints(pa.array(texts))] == want
    few = simhash.wide_fingerprints(pa.array(["a", "A!", "b", "a a", "a b", "b a", "a b c d"]))
    assert len({x.tobytes() for x in few}) == 6 and (few[0] == few[1]).all()


def test_similar_texts_meet_and_others_do_not(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=7))
    base = [[word() for _ in range(rng.randint(60, 500))] for _ in range(120)]
    rows, pairs = [], []
    for k, w in enumerate(base):
        near, far = list(w), list(w)
        for p in range(30, len(w), 100):
            near[p] = word()
        for p in range(0, len(w), 7):
            far[p] = word()
        for j, x in enumerate((w, near, far)):
            rows.append((3 * k + j, " ".join(x)))
        pairs.append((3 * k, 3 * k + 1))
    text = dict(rows)
    jaccard = lambda a, b: len(a & b) / len(a | b)
    near = [(a, b) for a, b in pairs if jaccard(slow_wide(text[a])[0], slow_wide(text[b])[0]) >= 0.87]
    assert len(near) > 60
    for limit in (simhash.WIDE_LIMIT, 1):
        df = spark.createDataFrame(rows, ID_TEXT)
        root = {r.doc_id: r.root for r in simhash.similar_groups(df, limit).collect()}
        assert sum(root[a] == root[b] for a, b in near) >= (0.85 if limit > 1 else 0.75) * len(near)
        assert len({root[3 * k + 2] for k in range(120)} | {root[3 * k] for k in range(120)}) == 240


def shingled(text):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower())
    return set(zip(*(words[k:] for k in range(5)))) if len(words) > 4 else {tuple(words)} if words else set()


def alike(a, b):
    a, b = shingled(a), shingled(b)
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def test_no_text_goes_that_is_not_similar(spark):
    """Texts from 0.55 to 0.95 to their first: whatever is grouped hangs together by links of 0.8."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=7))
    texts, n = [], 240
    for _ in range(30):
        w = [word() for _ in range(n)]
        texts.append(w)
        for changes in (1, 2, 4, 6, 8, 10):
            x = list(w)
            for p in rng.sample(range(n // 6), changes):
                x[6 * p] = word()
            texts.append(x)
    text = {k: " ".join(t) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(text.items()), ID_TEXT)
    groups = {}
    for r in simhash.similar_groups(df).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    for members in groups.values():
        reached = {members[0]}
        while more := {b for b in members if b not in reached and any(alike(text[a], text[b]) for a in reached)}:
            reached |= more
        assert reached == set(members)
    root = {d: g for g, m in groups.items() for d in m}
    pairs = [(a, b) for a in text for b in range(a + 1, 7 * (a // 7) + 7) if alike(text[a], text[b])]
    assert len(pairs) > 60 and sum(root[a] == root[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_large_and_dense_groups_are_solved_alike(monkeypatch):
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, (1, 3), np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64))
    fp = np.concatenate([fp, rng.integers(0, 2**63, (200, 3), np.uint64)])
    group = np.sort(rng.integers(0, 4, 500))
    probe = np.zeros(500, bool)
    found = []
    for large, pairs in ((10**6, 1 << 21), (10, 1 << 21), (10**6, 50), (10, 50)):
        monkeypatch.setattr(simhash, "LARGE", large)
        monkeypatch.setattr(simhash, "PAIRS", pairs)
        u, v = simhash.solve_groups(group, probe, fp, 30, True)
        assert len(u) < 500
        found.append(sorted(zip(u.tolist(), v.tolist())))
    assert found[0] and all(f == found[0] for f in found)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in df.collect()]
    comp = slow_components(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_report(df).collect()}
    assert got == {i: (f"{x:016x}", comp[i]) for i, x in rows}


def test_limits_drop_no_pair_that_meets(spark):
    """Groups of texts around 0.8, each with more neighbours than are proposed at first: no pair that meets is parted."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=7))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(400)]
        for _ in range(50):
            w = list(base)
            for p in rng.sample(range(0, 400, 5), 5):
                w[p] = word()
            texts.append(" ".join(w))
    fp = simhash.wide_fingerprints(pa.array(texts))
    keys = []
    for x in fp:
        parts = [int.from_bytes(x[3 * s : 3 * s + 3].tobytes(), "big") for s in range(8)]
        keys.append({(s, p & ~(1 << b) if b >= 0 else p) for s, p in enumerate(parts) for b in range(-1, 24)})
    shingles = [shingled(t) for t in texts]
    pairs = []
    for a in range(len(texts)):
        for b in range(a):
            meet = keys[a] & keys[b] and np.bitwise_count(fp[a] ^ fp[b]).sum() <= simhash.WIDE.distance
            if meet and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) - 1e-9:
                pairs.append((a, b))
    assert len(pairs) > 100
    df = spark.createDataFrame(list(enumerate(texts)), ID_TEXT)
    for limit in (simhash.WIDE_LIMIT, 20):
        root = {r.doc_id: r.root for r in simhash.similar_groups(df, limit).collect()}
        assert [p for p in pairs if root[p[0]] != root[p[1]]] == []
        assert len(set(root.values())) > 20


def test_texts_of_one_fingerprint_are_compared_with_each_other():
    """Pairs across roots are all given, however many stand in a group."""
    fp = np.zeros((7, 3), np.uint64)
    fp[6] = 2**63
    group, root = np.array([0, 0, 0, 0, 1, 1, 1]), np.array([1, 1, 2, 3, 1, 2, 2])
    found = [(a, b) for u, v in simhash.across(group, root, fp, 2) for a, b in zip(u.tolist(), v.tolist())]
    assert sorted(found) == [(0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (4, 5)]
