import hashlib
import re

from shelfmerge.llm import decontaminate as d
from shelfmerge.llm.common import materialise


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    hit, found = set(), set()
    for item, t in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        wins = [p[i : i + 10] for i in range(len(p) - 9)] if len(p) >= 10 else [p] * bool(p)
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def check(spark, docs, items, **options):
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id bigint, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {
        r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        for r in d.contamination_report(df, bench).collect()
    }
    assert got == {i: slow(t, items) for i, t in docs}
    kept = d.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if not v[-1]}


ITEMS = [
    (10, "One two three four five six seven eight nine ten eleven TWELVE"),
    (9, "alpha beta"),
    (2, "gamma"),
    (3, None),
    (4, "..."),
    (5, "one two three four five six seven eight nine ten"),
    (6, "a a a a a a a a a a a"),
]
DOCS = [
    (1, "x one-two three four five six seven eight nine ten eleven twelve y"),
    (2, "ALPHA, beta alpha beta gamma é"),
    (3, None),
    (4, ""),
    (5, "clean words only here"),
    (6, "a " * 40),
    (7, "one two three four five six seven eight nine teñ"),
]


def test_against_brute_force(spark):
    check(spark, DOCS, ITEMS)


def test_empty_tables(spark):
    check(spark, DOCS, [(1, None)])
    bench = spark.createDataFrame([], "item_id bigint, text string")
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert d.contamination_report(df, bench).count() == 0


def test_several_passes(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    one = d.find_contamination(df, bench).collect()
    many = d.find_contamination(df, bench, pass_bytes=40).collect()
    assert sorted(one) == sorted(many)


def test_one_part_of_the_benchmark_at_a_time(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    n, parts = d.benchmark_parts(bench, 40)
    assert n > 3 and iter(parts) is parts
    assert sorted(i for p in parts for i, _ in p) == sorted(str(i) for i, _ in ITEMS)


def test_repeated_rows_are_judged_each(spark):
    df = spark.createDataFrame(DOCS[:2] * 3 + [(1, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted((r.doc_id, r.contaminated) for r in d.contamination_report(df, bench).collect())
    assert got == [(1, False)] + [(1, True)] * 3 + [(2, True)] * 3


def test_pieces_of_long_texts(monkeypatch):
    m = d.Matcher([(str(i), (t or "").encode()) for i, t in ITEMS])
    text = ("filler words, " * 30 + "One two three four five six seven eight nine ten. gamma " + "alpha beta " * 5).encode()
    whole = m.search(text)
    for size in (1, 7, 50):
        monkeypatch.setattr(d.pieces, "__defaults__", (size,))
        assert m.search(text) == whole


def test_real_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    some = {r.doc_id: r for r in d.contamination_report(docs, bench).collect()}
    assert len(some) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in [k for k, r in some.items() if r.contaminated][:20] + list(some)[:20]:
        r = some[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == slow(texts[i], items)


def test_passes_write_what_they_found_and_no_text(spark, monkeypatch):
    written = []

    def watched(df, what):
        out = materialise(df, what)
        written.append((set(out.columns), out.count()))
        return out

    monkeypatch.setattr(d, "materialise", watched)
    docs = DOCS * 40 + [(8, "clean and long " * 5000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("digest", d.F.lit("own")).withColumn("d", d.F.lit(1))
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    n, _ = d.benchmark_parts(bench, 40)
    many = d.find_contamination(df, bench, pass_bytes=40)
    assert many.columns == [*df.columns, "n_words", "hit_spans", "item_ids"]
    assert sorted(many.collect()) == sorted(d.find_contamination(df, bench).collect())
    assert len(written) == n - 1
    assert all(columns == {"digest", "hit_spans", "item_ids"} and rows <= len(DOCS) for columns, rows in written)
