import random
import re

import numpy as np
import pyarrow as pa

from shelfmerge.llm import common
from shelfmerge.llm import line_dedup as ld


def lines(text):
    """The definition, word by word: (start, end) of every line."""
    text, spans, at = text or "", [], 0
    words = [m.span() for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
    for k, (a, b) in enumerate(words):
        gap = text[b : words[k + 1][0]] if k + 1 < len(words) else text[b:]
        if text[b - 1] in ".!?" or "\n" in gap or k + 1 == len(words):
            spans.append(words[at : k + 1])
            at = k + 1
    out, place = [], 0
    for w in spans:
        if len(w) > ld.LINE_WORDS:
            h = ld.find_words(*ld.text_bytes(pa.array([text])))
            n = sum(len(s) for s in spans[: spans.index(w)])
            cuts = ld.content_cuts(h.hash[n : n + len(w)], np.zeros(len(w), int)).tolist()
            pieces, piece = [], []
            for x, c in zip(w, cuts):
                piece.append(x)
                if c or len(piece) == ld.LINE_WORDS:
                    pieces.append(piece)
                    piece = []
            pieces += [piece] if piece else []
        else:
            pieces = [w]
        for piece in pieces:
            b = piece[-1][1]
            m = re.compile(r"[ \t\v\f\r]*\n|[ \t\n\v\f\r]*").match(text, b)
            out.append((place, m.end()))
            place = m.end()
    return out


def slow(docs):
    """docs: {doc_id: text}; the definition, window by window."""
    seen, gone, held = {}, {d: set() for d in docs}, {}
    for d in sorted(docs):
        at = held[d] = lines(docs[d])
        parts = [tuple(docs[d][a:b].split()) for a, b in at]
        for i in range(len(parts) - 2):
            w = tuple(parts[i : i + 3])
            if w not in seen:
                seen[w] = (d, i)
            else:
                fd, fi = seen[w]
                gone[d] |= set(range(max(i, fi + 3) if fd == d else i, i + 3))
    return {
        d: None if docs[d] is None else "".join(docs[d][a:b] for k, (a, b) in enumerate(held[d]) if k not in gone[d])
        + docs[d][(held[d] or [(0, 0)])[-1][1] :]
        for d in docs
    }, {d: len(g) for d, g in gone.items()}


PASSAGE = (
    "Some words that stand here at length. They go on for a while and then some more. "
    "Nothing in them is of note! But they are the same in every copy, which is the point here. And on it goes."
)
DOCS = {
    1: f"First own line of text.\n{PASSAGE}\nThe end of the first one.",
    2: f"Another start. {PASSAGE} More after it, quite different.",
    3: PASSAGE,
    4: None,
    5: "",
    6: "short. no. yes.",
    7: "the very same line stands here over and over\n" * 9,
    8: "one long line without any stop " * 60,
    9: "é ü\t.\n\n \n x",
    10: PASSAGE.upper(),
}


def run(spark, docs, n=3):
    rows = [(d, t, 5) for d, t in docs.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int").repartition(n)
    return df, {r.doc_id: r for r in ld.line_dedup_report(df).collect()}


def spans(text):
    return ld.Lines(pa.array([text], pa.string())).spans(0)


def test_lines_match_the_definition_and_tile_the_text():
    texts = [*DOCS.values(), " ".join(words(300, 7)), " \n\n a", "x. y! z?\n\n\nw  ", ". . .", "é" * 40 + " ü. " * 5]
    found = ld.Lines(pa.array(texts))
    for k, t in enumerate(texts):
        data, at = (t or "").encode(), 0
        want = [(len((t or "")[:a].encode()), len((t or "")[:b].encode())) for a, b in lines(t)]
        assert found.spans(k) == want == spans(t)
        for a, b in want:
            assert a == at and b > a
            at = b
        assert not data[at:].strip()


def test_against_definition(spark):
    df, got = run(spark, DOCS)
    texts, n = slow(DOCS)
    assert {d: r.text for d, r in got.items()} == texts
    assert {d: r.n_removed for d, r in got.items()} == n
    assert PASSAGE in got[1].text and "length" not in got[2].text and not got[3].text.strip()
    for d, r in got.items():
        t, kept, at = DOCS[d] or "", "", 0
        for s in r.removed:
            kept, at = kept + t[at : s.start], s.end
        assert kept + t[at:] == (r.text or "")
    out = ld.drop_repeats(df)
    assert out.dtypes == df.dtypes
    assert {r.doc_id for r in out.collect()} == set(DOCS) - {3}


def test_batches_do_not_matter(spark, monkeypatch):
    docs = {i: f"Start {i} here.\n" + " ".join(PASSAGE.split()[i % 5 :]) + f"\n{PASSAGE}\nStop {i}." for i in range(60)}
    texts, n = slow(docs)
    for size in (1, 7, 256):
        monkeypatch.setattr(common, "TEXT_BATCH", size)
        monkeypatch.setattr(ld, "HELD", 50 * size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        _, got = run(spark, docs)
        assert {d: r.text for d, r in got.items()} == texts
        assert {d: r.n_removed for d, r in got.items()} == n


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame(
        [(None, PASSAGE), (1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (None, PASSAGE)], "doc_id bigint, text string"
    )
    got = sorted((r.doc_id or 0, r.n_removed > 0) for r in ld.line_dedup_report(df).collect())
    assert got == [(0, False), (0, False), (1, False), (1, False), (2, True)]
    assert ld.line_dedup_report(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    texts, _ = slow(docs)
    assert {r.doc_id: r.text for r in ld.line_dedup_report(df.repartition(4)).collect()} == texts


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]


def test_passages_in_short_lines(spark):
    w = words(60, 0)
    short = "\n".join(" ".join(w[i : i + 3]) for i in range(0, 60, 3))
    single = ". ".join(w) + "."
    docs = {1: f"Start one.\n{short}\nStop one.", 2: f"Other start.\n{short}\nOther stop.", 3: f"A. {single} B.", 4: f"C. {single} D.", 5: "Les Rech.\n" * 140}
    _, got = run(spark, docs)
    assert short in got[1].text and single in got[3].text
    assert got[2].text == "Other start.\nOther stop." and got[4].text == "C. D."
    assert got[5].text == "Les Rech.\n" * 3


def test_passages_without_stops_at_several_offsets(spark):
    passage = words(90, 1)
    docs = {k: " ".join(words(20 + k, 100 + k) + passage + words(30, 200 + k)) for k in range(20)}
    _, got = run(spark, docs)
    assert got[0].text == docs[0]
    for k in range(1, 20):
        left = set(got[k].text.split())
        assert len(left & set(passage)) <= 2 * ld.LINE_WORDS
        assert left - set(passage) == set(docs[k].split()) - set(passage)


def test_long_lines_are_bounded():
    for t in [" ".join(["same"] * 200), " ".join(words(500, 2)), "a b " * 100]:
        sizes = [len(t[a:b].split()) for a, b in spans(t)]
        assert sum(sizes) == len(t.split()) and max(sizes) <= ld.LINE_WORDS


def test_frequent_windows_cross_the_shuffle_once_a_task():
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(200)), "text": ["a\nb\nc\nd"] * 200, "text_key": [9] * 200},
        pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("text_key", pa.int64())]),
    )
    rows = pa.Table.from_batches(list(ld.occurrences(4)(iter([batch, batch.slice(100)])))).to_pylist()
    assert sum(len(r["data"]) for r in rows if not r["decided"]) == 2 * ld.WINDOW.itemsize
    covered = [(r["doc_id"], *np.frombuffer(r["data"], ld.SPAN)[0].tolist()) for r in rows if r["decided"]]
    assert sorted(covered) == [(d, 0, 4) for d in range(1, 200)]


def test_rows_that_share_an_id_but_differ_in_text(spark):
    own = "This one is its own. It has lines of its own. And a third. And a fourth."
    df = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (2, own), (2, own), (3, own)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text) for r in ld.line_dedup_report(df.repartition(3)).collect())
    assert got == [(1, PASSAGE), (2, ""), (2, own), (2, own), (3, "")]
    assert sorted((r.doc_id, r.text) for r in ld.drop_repeats(df).collect()) == [(1, PASSAGE), (2, own), (2, own)]


def test_a_very_long_text_and_clashing_columns(spark, monkeypatch):
    long = " ".join(words(200_000, 3)) + "\n" + PASSAGE
    df = spark.createDataFrame([(1, long, 7, "a"), (2, "Start.\n" + long[100_000:], 8, "b")], "doc_id bigint, text string, covered int, removed string")
    got = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    assert got[1].text == long and got[1].covered == 7 and got[1].removed == []
    assert len(got[2].text) < 300 and got[2].n_removed > 10_000
    whole = [x for x in ld.Lines(pa.array([long])).windows()]
    monkeypatch.setattr("shelfmerge.llm.words.PIECE", 1000)
    assert all((x == y).all() for x, y in zip(whole, ld.Lines(pa.array([long])).windows()))


def test_many_ranges_find_the_same(spark, monkeypatch):
    docs = {i: f"Start {i} here.\n{PASSAGE}\nStop {i % 7}. And so on. It ends." for i in range(40)}
    texts, n = slow(docs)
    monkeypatch.setattr(ld, "RANGE", 1)
    _, got = run(spark, docs)
    assert {d: (r.text, r.n_removed) for d, r in got.items()} == {d: (texts[d], n[d]) for d in docs}


def test_windows_are_reckoned_by_lines_whatever_the_texts(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    short = "a b c d. " * 3000
    for texts in (["\n".join(words(9) for _ in range(2000))] * 3, [words(6000)], [short], [None, ""]):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
        real = sum(max(0, len(lines(t)) - ld.LINES + 1) for t in set(texts)) * (len(texts) // len(set(texts)))
        about = ld.windows_about(df)
        assert real / 4 <= about <= 4 * real + 64


def test_a_range_of_long_documents_holds_few_windows(spark, monkeypatch):
    monkeypatch.setattr(ld, "RANGE", 500)
    df = spark.createDataFrame([(k, "\n".join(f"line {k} {n} ends." for n in range(2000))) for k in range(8)], "doc_id bigint, text string")
    ranges = int(ld.windows_about(df)) // ld.RANGE
    rows = common.in_text_batches(df.withColumn("text_key", ld.text_key()), ld.occurrences(ranges), ld.ROWS).filter("not decided")
    sizes = [r.n // ld.WINDOW.itemsize for r in rows.groupBy("range").agg(ld.F.sum(ld.F.octet_length("data")).alias("n")).collect()]
    assert sum(sizes) == 8 * 1998 and max(sizes) <= 2 * ld.RANGE
