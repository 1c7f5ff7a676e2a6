import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shelfmerge.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        rows = []
        for i, c, n in held:
            m = 100 - 90 + 90 * n * n_docs // total
            s = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in asked.items() if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ODD = [
    (1, None), (2, ""), (3, " ,.; "), (4, "Alpha beta alpha"), (5, "alpha BETA gamma, gamma; é É naïve"), (6, "日本語 テスト alpha"),
    (7, "alpha beta alpha"), (7, "alpha beta alpha"), (None, "gamma"), (8, "x" * 5000 + " beta"), (9, "beta " * 3000 + "rare"), (10, "a1 b2 1 2 3"),
]
ASKED = [(1, "alpha gamma"), (2, None), (3, ""), (4, "missing words"), (5, "É é rare RARE naïve"), (6, "beta beta 1 b2"), (7, "alpha gamma")]


@pytest.mark.parametrize("k,pass_bytes,sample", [(10, 1 << 20, 512), (2, 8, 1), (1, 1 << 20, 3)])
def test_odd_rows_equal_brute_force(spark, k, pass_bytes, sample):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ASKED, "item_id long, text string")
    assert got(ranked.search(docs, items, k, pass_bytes, sample)) == brute(ODD, ASKED, k)


def test_documents_equal_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got(ranked.ranked_report(docs, items)) == want


def test_bounds_hold_and_spare_scoring():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(20000)]
    texts = [" ".join(words[min(int(x), 19999)] for x in rng.zipf(1.3, rng.integers(5, 400))) for _ in range(600)]
    batch = next(ranked.index_rows(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": texts})])))
    q = ranked.Queries([" ".join(t.split()[:20]) for t in texts[:10]])
    df = np.array([sum(int(v) in set(b.as_py()) for b in batch.column("terms")) for v in q.vocabulary.view(np.int64)])
    q.weigh(df, 600)
    m = ranked.lengths(batch.column("n"), 600, sum(batch.column("n").to_pylist()))
    assert (q.bounds(batch, m) >= q.scores(batch, m)).all()
    best = ranked.Best(q.n, 3, np.zeros(q.n, np.int64))
    scored = ranked.search_batch(q, best, batch, m)
    assert scored < 600
    exact = q.scores(batch, m)
    assert [[-s for s, _, _ in h] for h in best.held] == [sorted(exact[:, i].astype(int).tolist())[::-1][:3] for i in range(q.n)]


def test_a_wide_text_folds_and_stays_exact(spark):
    many = " ".join(f"t{i}" for i in range(200_000))
    rows = [(1, many), (2, "t5 t9"), (3, "t5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("a", "t5 t9 t199999")], "item_id string, text string")
    assert got(ranked.search(docs, items)) == brute(rows, [("a", "t5 t9 t199999")])


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, score string")
    items = spark.createDataFrame([(1, "a", 2)], "item_id long, text string, rank int")
    assert ranked.search(docs, items).count() == 0
    full = spark.createDataFrame([(1, "a", "s")], "doc_id int, text string, score string")
    assert got(ranked.search(full, items)) == brute([(1, "a")], [(1, "a")])
    assert ranked.search(full, items.limit(0)).count() == 0
