import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmerge.llm import language, simhash
from tests.llm.test_decontaminate import slow as slow_hits
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_packing import verify
from tests.llm.test_simhash import alike


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame(
        [(90001, None, "en", "x", 0), (90002, "12 - 3", "en", "x", 6), (90003, "", None, None, None)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    docs.union(odd).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs)
    texts = {}
    for r in docs.collect():
        if language.has_letter(r.text):
            lang, score = model.predict(r.text.encode())
            if score >= language.REJECT_BELOW:
                texts[r.doc_id] = r.text
    assert not {90001, 90002, 90003} & set(texts)
    cut, gone = slow_lines(texts)
    texts = {d: t for d, t in cut.items() if not gone[d] or t.strip()}
    wide = simhash.wide_fingerprints(pa.array(texts.values()))  # held against their definition in test_simhash
    fp = dict(zip(texts, (int.from_bytes(f.tobytes()) for f in wide)))
    comp = {d: d for d in texts}
    for a in sorted(texts):  # within the distance, and alike by their shingles
        for b in sorted(texts):
            if a < b and comp[a] != comp[b] and (fp[a] ^ fp[b]).bit_count() <= simhash.WIDE.distance and alike(texts[a], texts[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {d: new if c == old else c for d, c in comp.items()}
    texts = {d: t for d, t in texts.items() if comp[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not slow_hits(t, items)[-1]}
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(texts) > 20
    verify(rows, texts, 2048)


def test_repeated_ids_and_clashing_columns(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    names = ["covered", "removed", "d", "text_key", "lang_pred", "score", "n_words", "hit_spans"]
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    again = docs.withColumn("text", F.concat(F.lit("quite another text: "), F.reverse("text")))
    docs.union(again).union(docs.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, folder)
        assert rows.dtypes == docs.dtypes, name
    kept = rows.collect()
    assert all([r[n] for n in names] == list(range(len(names))) for r in kept)
    assert sum(r.text.startswith("quite another") for r in kept) > 20 and len({(r.doc_id, r.text) for r in kept}) == len(kept)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), folder).count() == 0
