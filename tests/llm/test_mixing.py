import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmerge.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, [s for s in names if sizes[s]]
    out = {s: 0.0 for s in names if not sizes[s]}
    while open_:
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > 2 * sizes[s]]
        if not over:
            total = sum(w[x] for x in open_)
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def held(rows):
    """Sizes, sources' sizes and targets of (doc_id, source, text)."""
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    return dict(sizes), brute_targets(sizes)


def check(spark, rows, df=None):
    docs = df if df is not None else spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    sizes, wanted = held(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, least = defaultdict(int), defaultdict(lambda: 10**9)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, wanted[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
        if r["size"]:
            least[r.source] = min(least[r.source], r["size"])
    return got, taken, wanted, least


def test_sources_meet_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got, taken, wanted, least = check(spark, rows, docs)
    sizes = sorted(((r.doc_id, r["size"]) for r in got))
    assert sizes == sorted((i, len(WORD.findall(t or ""))) for i, _, t in rows)
    for s in wanted:
        assert abs(taken[s] - wanted[s]) <= max(10 * least[s], 0.002 * wanted[s]), s


def test_rates_are_tilted_exponentially(spark):
    rows = [(k, "ab"[k % 2], "w " * (1 + k * 7 % 50)) for k in range(400)]
    got, taken, wanted, _ = check(spark, rows)
    sizes, _ = held(rows)
    for s in "ab":
        own = [(r["size"], r.rate) for r in got if r.source == s]
        assert math.isclose(sum(n * r for n, r in own), wanted[s], rel_tol=1e-6)
        if wanted[s] < 2 * sizes[s]:
            tilts = [math.log(r) / n for n, r in own if r < 2]
            assert max(tilts) - min(tilts) < 1e-9
            assert all(r >= 2 - 1e-9 or abs(math.log(r) / n - tilts[0]) < 1e-9 for n, r in own)


def test_odd_rows(spark):
    rows = [(1, None, "a b"), (1, None, "a b"), (None, "x", None), (2, "x", ""), (3, "y", "a b \x0b c"), (4, "é", "w " * 5000), (5, "Z", "one"), (None, "Z", "one")]
    got, taken, wanted, least = check(spark, rows)
    assert {r["size"] for r in got if r.source == "y"} == {2} and taken["x"] == 0


def test_a_hot_source_of_equal_sizes(spark):
    rows = [(k, "hot", "a b c") for k in range(3000)] + [(10_000 + k, f"s{k % 7}", "w " * (1 + k % 90)) for k in range(700)]
    _, taken, wanted, least = check(spark, rows)
    for s in wanted:
        assert abs(taken[s] - wanted[s]) <= max(10 * least[s], 0.002 * wanted[s]), s


def test_reruns_agree_however_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = sorted(map(tuple, mixing.mixing_report(docs).collect()))
    assert sorted(map(tuple, mixing.mixing_report(docs.repartition(7, "text")).collect())) == one


def test_copies_are_expanded(spark):
    rows = [(k, "ab"[k % 2], f"t{k} " * (1 + k % 9)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("kept"))
    want = {(r.doc_id, r.copies) for r in mixing.mix(docs).collect() if r.copies}
    assert {(r.doc_id, r["count"]) for r in mixing.expanded(docs).groupBy("doc_id").count().collect()} == want


@pytest.mark.parametrize("rows", [[], [(1, "a", None)], [(1, "a", "x")]])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("own"))
    assert len(mixing.mixing_report(docs).collect()) == len(rows)
