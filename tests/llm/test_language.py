import zlib

from shelfmerge.llm import language


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language.language_report(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == df.count()
    for r in got[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    rows = [r for r in got if r.held_out]
    right = sum(r.lang_pred == r.lang for r in rows)
    assert right / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() > 0.97 * df.count()


def test_odd_rows(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(-1, None, "en"), (-2, "", "en"), (-3, "12 34 --", "de"), (None, "the and of this", None), (-4, "x", "en")],
        "doc_id bigint, text string, lang string",
    )
    df = real.union(odd).selectExpr("*", "1 as lang_pred", "'a' as score")
    got = {r.doc_id: r for r in language.language_report(df).collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3
    assert got[None].lang_pred == "en" and got[None].held_out
    assert got[-4].lang_pred != "und"
    kept = language.keep_identified(df)
    assert kept.dtypes == df.dtypes
    assert not {-1, -2, -3} & {r.doc_id for r in kept.collect()}


def test_numerals_are_no_letters_and_repeats_are_rows(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "½ ²", "en"), (-1, "½ ²", "en"), (-2, "٣ Ⅷ", "en"), (-3, "ß", "de"), (-3, "ß", "de")], "doc_id bigint, text string, lang string")
    got = language.language_report(real.union(odd)).filter("doc_id < 0").collect()
    assert sorted((r.doc_id, r.lang_pred == "und") for r in got) == [(-3, False)] * 2 + [(-2, True)] + [(-1, True)] * 2


def test_a_language_of_long_texts_only_and_many_languages(spark):
    long = [(i, f"zwölf boxkämpfer jagen viktor {i} quer " * 3000, "de") for i in range(12)]
    short = [(100 + i, "how now brown cow and the rest of them", "en") for i in range(12)]
    many = [(200 + i, f"{chr(0x4E00 + i // 6) * 12}", f"l{i // 6}") for i in range(6 * 70)]
    df = spark.createDataFrame(long + short + many, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.language_report(df).collect()}
    assert {got[i] for i in range(12)} == {"de"} and {got[100 + i] for i in range(12)} == {"en"}
    assert len({got[200 + i] for i in range(6 * 70)}) > 64
    rows = language.training_rows(df)
    assert max(len(t.decode()) for t, _ in rows) <= language.SAMPLE_CHARS


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in language.language_report(df).collect()] == ["und"]
    assert language.language_report(df.limit(0)).count() == 0


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    text = ("the quick é brown " * 500).encode()
    whole = language.features(text)
    monkeypatch.setattr(language, "PIECE", 97)
    assert abs(language.features(text) - whole).max() < 1e-6


def test_pairs_within_a_family():
    rows = []
    for lang, words in {"en": "the and of", "de": "der und von", "nl": "het een van", "fr": "le et de", "xx": "qq zz"}.items():
        w = words.split()
        rows += [((" ".join([w[i % len(w)], w[(i * 7) % len(w)], w[(i * 3) % len(w)]])).encode(), lang) for i in range(20)]
    c = language.Classifier(rows)
    assert c.families == {"germanic": ["de", "en", "nl"], "romance": ["fr"], "xx": ["xx"]}
    assert len(c.by_pair) == 3
    for t, lang in rows:
        assert c.predict(t)[0] == lang


NO_LANGUAGE = {
    -1: "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    -2: "人人生而自由在尊严和权利上一律平等",
    -3: "xkqz wvbn zzkw qpfj xvqz jjqk wwxz kkqj vvzx " * 40,
    -4: "iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAAHElEQVQI12P4" * 3,
}


def test_texts_in_no_learned_language_go_and_clean_ones_stay(spark):
    real = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    short = {-5: "Xq.", -6: "Ö", -7: "Да", -8: "the 12 of 34 zq"}
    planted = spark.createDataFrame([(i, t, None) for i, t in (NO_LANGUAGE | short).items()], "doc_id bigint, text string, lang string")
    kept = [r.doc_id for r in language.keep_identified(real.union(planted)).select("doc_id").collect()]
    assert sorted(i for i in kept if i < 0) == sorted(short)
    assert len(kept) - len(short) == real.filter("text rlike '[a-zA-Z]'").count()


def test_a_language_once_learned_is_kept(spark):
    russian = [(i, f"Все люди рождаются свободными и равными, номер {i}", "ru") for i in range(40)]
    english = [(100 + i, f"all people are born free and equal, number {i}", "en") for i in range(40)]
    chinese = [(200, NO_LANGUAGE[-2], None)]
    df = spark.createDataFrame(russian + english + chinese, "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in language.keep_identified(df).collect()) == [*range(40), *range(100, 140)]
    got = {r.doc_id: r for r in language.language_report(df).collect()}
    assert got[200].lang_pred in ("ru", "en") and got[200].score == 0 and min(got[i].score for i in range(40)) > 0


def test_without_labels_texts_with_letters_stay(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, "12 - ½", None), (3, None, None)], "doc_id bigint, text string, lang string")
    assert [r.doc_id for r in language.keep_identified(df).collect()] == [1]
