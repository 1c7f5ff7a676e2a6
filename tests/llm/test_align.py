import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfmerge.llm import align


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(*align.tokenizer_paths())


def whole(aligner, text):
    """(a_ids, b_ids, groups) of a text encoded whole, or None."""
    if not text:
        return None
    (a,) = aligner.encode_a([" " + text])
    b = aligner.b.encode(text)
    if not aligner.fits(" " + text, a, b):
        return None
    groups, i, j, at_a, at_b, now = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(aligner.a_bytes[a[i]])
            now[0].append(a[i])
            i += 1
        else:
            at_b += len(aligner.b_bytes[b[j]])
            now[1].append(b[j])
            j += 1
        if at_a == at_b:
            groups.append(now)
            now = ([], [])
    return a, b, groups


def brute(aligner, texts):
    found = {k: whole(aligner, t) for k, t in texts.items()}
    links = {k: Counter((x, y) for a, b in f[2] for x in a for y in b) if f else Counter() for k, f in found.items()}
    df = Counter(p for c in links.values() for p in c)
    top = defaultdict(int)
    for (a, _), n in df.items():
        top[a] = max(top[a], n)
    out = {}
    for k, f in found.items():
        shown = ";".join(align.shown(g) for g in f[2]) if f else None
        out[k] = (
            *((len(f[0]), len(f[1]), len(f[2])) if f else (0, 0, 0)),
            sum(links[k].values()),
            sum(n for p, n in links[k].items() if df[p] == top[p[0]]),
            sum(n * df[p] for p, n in links[k].items()),
            hashlib.sha256(shown.encode()).hexdigest() if f else "",
        )
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def told(df):
    return {r.doc_id: tuple(r[c] for c in NAMES) for r in df.collect()}


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b", "a \n b", "a\n  b", "a\n\n b\n", "\n", "\t \t", "x  y", "x 　 y z",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b c", "▁", "naïve café ﬁn Ωmega 日本語 テスト 🙂🙂 👨‍👩‍👧 é", "don't they're I'll", "1234567 89 3.14",
    "x" * 300, "ab " * 200, " " * 50 + "end", "tab\tsep\r\nline", "\x00 \x01 \x7f", "日本語" * 90, "é è " * 60 + "ü",
]


def documents(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.mark.parametrize("size,fan", [(1 << 16, 64), (40, 2), (7, 3)])
def test_odd_texts_equal_whole_texts(spark, aligner, size, fan):
    texts = dict(enumerate([*ODD, *ODD[20:24]]))
    got = told(align.Alignment(documents(spark, texts).repartition(3), range_bytes=size, fan=fan, block_bytes=500).report())
    assert got == brute(aligner, texts)


def test_documents_equal_whole_texts(spark, sf, aligner):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert told(align.alignment_report(docs)) == brute(aligner, texts)


def test_ranges_of_any_size_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.length("text").desc()).limit(20)
    one = told(align.alignment_report(docs))
    assert told(align.Alignment(docs, range_bytes=997, fan=3, block_bytes=10_000).report()) == one
    assert max(v[0] for v in one.values()) > 3000


def test_fragments_compose_in_any_grouping():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 30)
        ends = [sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in (0, 1)]
        tokens = [[(e, 10 * e + kind) for e in x] for kind, x in enumerate(ends)]
        cuts = sorted({0, n, *rng.sample(range(n + 1), rng.randint(0, min(n, 6)))})
        parts = [align.fragment(*([t for t in x if a < t[0] <= b] for x in tokens)) for a, b in zip(cuts, cuts[1:])]
        left = parts[0]
        for p in parts[1:]:
            left = align.compose(left, p)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [align.compose(parts[k], parts[k + 1])]
        assert parts[0] == left == align.fragment(*tokens)


def test_copies_count_once_each_and_ids_may_repeat(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one")], "doc_id long, text string")
    rows = align.alignment_report(docs).collect()
    assert len(rows) == 3
    assert sorted((r.doc_id is None, r.count_sum) for r in rows) == [(False, 5), (False, 5), (True, 3)]


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, uid string, k int")
    assert align.alignment_report(docs).count() == 0
    docs = spark.createDataFrame([(5, "a b", "x", 1)], "doc_id int, text string, uid string, block int")
    assert align.alignment_report(docs).count() == 1


def test_pairs_are_the_corpus_counts(spark):
    docs = documents(spark, {1: "the cat", 2: "the the dog", 3: None})
    rows = align.Alignment(docs).pairs().collect()
    assert max(r.n for r in rows) == 2 and all(r.best for r in rows if r.n == 2)
