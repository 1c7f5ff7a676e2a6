import math

import numpy as np
import pyarrow as pa

from shelfmerge.llm import knn_join as kj

SCHEMA = "vec_id bigint, embedding array<float>"


def slow(rows, k=5, every=50, single=np.float32):
    good = [(i, [math.floor(256 * float(single(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for q in {i for i, _ in good if i % every == 0}:
        v = min(v for i, v in good if i == q)
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -x))) for r, (x, i) in enumerate(s)]
    return sorted(out)


def check(spark, rows, schema=SCHEMA, single=np.float32, **options):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], schema + ", score int").repartition(3)
    got = [tuple(r) for r in kj.knn_join(df, **options).collect()]
    assert sorted(got) == slow(rows, single=single, **options)


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(0, 0.1, 6).tolist()) for i in range(1, 200)]
    rows += [(0, None), (50, [None] * 6), (100, [math.nan] * 6), (150, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (300, [0.5, 0.25]), (350, []), (-50, [0.1] * 6)]
    check(spark, rows)


def test_ties_and_few(spark):
    check(spark, [(i, [0.5, -0.5]) for i in range(120)])
    check(spark, [(0, [1.0]), (1, [2.0]), (50, [-1.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])


def test_chunks_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.3, (5, 8))
    rows = [(i, (centres[i % 5] + rng.normal(0, 0.02, 8)).tolist()) for i in range(900)]
    monkeypatch.setattr(kj, "CHUNK", 40)
    monkeypatch.setattr(kj, "QUERY_BLOCK", 5)
    monkeypatch.setattr(kj, "BLOCK", 16)
    check(spark, rows)


def test_huge_components(spark):
    check(spark, [(0, [1e5, 1.0]), (1, [1e5, 2.0]), (2, [-1e5, 3.0]), (50, [3e5, 0.0])])


def test_scores_beyond_a_long_and_components_beyond_a_double(spark):
    big = [(0, [1e38, 1.0]), (1, [1e38, 0.0]), (2, [2e38, 0.0]), (3, [-3e38, 0.0]), (4, [-2e38, 0.0]), (5, [3e38, 0.0]), (6, [3e38, 1e38]), (50, [-1e38, 0.0])]
    check(spark, big, k=7)
    huge = [(0, [1e307, 0.0]), (1, [1e300, 2.0]), (2, [1e305, 0.0]), (3, [-1e305, 0.0]), (4, [1.0, 1.0]), (50, [1e305, 1.0]), (100, [2.0, 3.0])]
    check(spark, huge, "vec_id bigint, embedding array<double>", float, k=4)


def test_repeated_rows_and_ids_with_differing_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 4).tolist()) for i in range(120)]
    check(spark, rows + rows[40:70] + [(50, [1.0] * 4), (50, [-1.0] * 4), (7, [0.5] * 4)])


def test_many_pivots_in_two_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(np.repeat(rng.normal(0, 0.3, (40, 5)), 30, 0).tolist())]
    rows = [(i, (np.array(v) + rng.normal(0, 0.01, 5)).tolist()) for i, v in rows]
    monkeypatch.setattr(kj, "FEW_PIVOTS", 4)
    monkeypatch.setattr(kj, "CHUNK", 20)
    monkeypatch.setattr(kj, "BOUNDS", 500)
    check(spark, rows)


def test_bounds_leave_cells_out():
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([rng.normal(3, 0.01, (50, 4)), rng.normal(-3, 0.01, (50, 4))]))
    p = np.array([x[:50].mean(0), x[50:].mean(0)])
    s = object.__new__(kj.Summary)
    cell, dist = kj.nearest(x, p)
    s.k, s.pivots, s.count = 5, p, np.array([50, 50])
    s.far = np.array([dist[cell == j].max() for j in (0, 1)])
    s.near = np.array([np.sort(dist[cell == j])[:6] for j in (0, 1)])
    assert s.needed(x[:1]).tolist() == [[True, False]]


def test_whole_table(spark, sf):
    check(spark, [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_copies_of_a_query_are_not_its_candidates(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 0.0, 0.0])] * 6
    for n, centre in enumerate(([0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0], [0.0, -1.0, 0.0])):
        rows += [(1 + 100 * n + k, (np.array(centre) + rng.normal(0, 0.02, 3)).tolist()) for k in range(100)]
    rows = [(i, v) for i, v in rows if i == 0 or i % 50]
    check(spark, rows)


def test_cells_that_no_query_needs_are_not_dealt():
    s = object.__new__(kj.Summary)
    s.chunks = np.array([1, 1])
    batch = pa.RecordBatch.from_pydict({"vec_id": [1, 2, 3], "cell": pa.array([0, 1, 0], pa.int32()), "v": [[1.0], [2.0], [3.0]]})
    got = pa.Table.from_batches(list(kj.deal(s, np.array([0, 3]), False)(iter([batch])))).to_pylist()
    assert [(r["vec_id"], r["part"]) for r in got] == [(2, 0), (2, 1), (2, 2)]
