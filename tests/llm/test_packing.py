import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmerge.llm import packing


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


T = tokenizer()
E = packing.WordEncoder(packing.tokenizer_path())
ODD = "aB'sé É!?.,;:́ ​<|endoftext|>0 9\n\t中\U0001f600ßİσΣﬁ"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(ODD) | st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=4))
def test_word_ids_equal_whole_text_ids(texts):
    ids, n = E.encode(pa.array(texts))
    want = [T.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_special_strings_and_contractions():
    texts = ["it's <|endoftext|> and<|startoftext|>THEY'LL", "don't 1234 x_y", None, "", "Word, word. WORD?!"]
    ids, n = E.encode(pa.array(texts))
    want = [T.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))


def test_another_tokenizer_file_encodes_whole_texts(tmp_path):
    import json

    config = json.loads(T.to_str())
    config["normalizer"] = {"type": "NFC"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(config))
    other = packing.WordEncoder(str(path))
    assert E.by_words and not other.by_words
    texts = ["It's A Word. ÉÉ", None, "x"]
    ids, n = other.encode(pa.array(texts))
    want = [other.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == list(map(len, want))
    assert want != [T.encode(t or "", add_special_tokens=False).ids for t in texts]


def verify(rows, texts, window):
    full = {i: T.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        ids = full[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.doc_tokens == len(full[r.doc_id]) and r.length > 0
    for i, ids in full.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids)
    last = max(by_seq, default=0)
    for s, piece in by_seq.items():
        at = 0
        for r in sorted(piece, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or s == last and at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing_of_odd_rows(spark):
    texts = {1: None, 2: "", 3: "one two " * 700, 4: "x", 5: "é " * 50}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id bigint, text string, ids int").repartition(3)
    for window in (2048, 16):
        verify(packing.pack(df, window, with_ids=False).collect(), texts, window)
    for r in packing.pack(df, 16).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_rows_are_packed_each(spark):
    df = spark.createDataFrame([(1, "some words of one")] * 5 + [(1, "others"), (None, "none")], "doc_id bigint, text string").repartition(3)
    rows = packing.pack(df, 8, with_ids=False).collect()
    size = len(T.encode("some words of one", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_tokens == size and r.doc_id == 1 and size != 2) == 5 * size
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for s, o, n in places:
        assert s * 8 + o == at
        at += n


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    verify(packing.packing_report(spark, df.repartition(5)).collect(), {r.doc_id: r.text for r in df.collect()}, 2048)
