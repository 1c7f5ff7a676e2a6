"""What the small tables do not show: rows that only larger ones have, and what is written and shuffled."""

import bisect
import difflib
import itertools
import re
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmerge.functions import text, values
from shelfmerge.operators import elements, matching, merge, site_specs, standard, texts
from shelfmerge.plans import base, fixtures, registry
from shelfmerge.sources import changes
from shelfmerge.streaming import jobs

registry.queries()


@pytest.fixture(scope="module")
def late(spark, sf, tmp_path_factory):
    """The tables, with two numbers whose events all come after the moment asked for."""
    path = str(tmp_path_factory.mktemp("late"))
    e = spark.read.parquet(f"{sf}/events.parquet")
    after = e.filter("event_id < 20").withColumns({"event_id": F.col("event_id") + 10_000_000, "user_id": F.col("user_id") % 2 + 900_000, "ts": F.lit("2024-01-05 00:00:00").cast(dict(e.dtypes)["ts"])})
    e.unionByName(after).write.parquet(f"{path}/events.parquet")
    return path


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_lease_stream_leaves_out_numbers_without_events_yet(spark, late):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{late}/events.parquet/*.parquet')")
    want = c.execute(base.ORACLES["lease_stream"])
    names = [d[0] for d in want.description]
    want = sorted((tuple(r[names.index(k)] for k in sorted(names)) for r in want.fetchall()), key=str)
    assert rows_of(base.QUERIES["lease_stream"](spark, late)) == want


# ---- long texts held once


def by_reference(spark, rows, column):
    """rows with references in a column's place, and (ref, text)."""
    path = rows.sparkSession.conf.get("spark.sql.warehouse.dir") + f"/refs-{uuid.uuid4().hex}"
    texts.numbered(rows.select(F.col(column).alias("text")).filter("text <> ''").distinct(), "text").write.parquet(path)
    known = spark.read.parquet(path)
    refs = rows.join(known.withColumnRenamed("text", column), column, "left")
    return refs.withColumn(column, F.coalesce("ref", F.col(column))).select(*rows.columns), known.select("ref", "text")


@pytest.mark.parametrize("name", ["book_std", "listings"])
def test_what_is_written_of_listings_holds_no_synopses(spark, sf, name):
    getattr(fixtures, name)(spark, sf)
    made = [p for (_, folder, _), p in fixtures._WRITTEN.items() if folder == sf and "synopses" not in p]
    longest = [spark.read.parquet(p).agg(F.max(F.length("sinopsis"))).first()[0] for p in made if "sinopsis" in spark.read.parquet(p).columns]
    assert longest and max(longest) <= 20


def test_book_std_has_its_synopses(spark, sf):
    c = duckdb.connect()
    for t in ("lineitem", "part", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = c.execute(f"SELECT site, url, sinopsis FROM ({fixtures.BOOK_STD})").fetchall()
    assert sorted(map(tuple, fixtures.book_std(spark, sf).select("site", "url", "sinopsis").collect())) == sorted(want)


def test_references_sort_as_their_texts(spark):
    rows = spark.createDataFrame([("b",), ("",), (None,), ("a b",), ("a",), ("ñ",), ("Z" * 50,)], "text string")
    got = texts.numbered(rows, "text").collect()
    assert {r.text: r.ref for r in got if not (r.text or "").strip()} == {"": "", None: None}
    full = [r for r in got if r.text]
    assert [r.text for r in sorted(full, key=lambda r: r.ref)] == sorted((r.text for r in full), key=str.encode)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_ordered_with_texts_is_the_plain_order(spark, parts):
    rows = spark.range(700).select(
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("a"), F.format_string("%05d", (F.col("id") * 7919) % 700).alias("b"),
        F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 != 0, F.concat(F.lit("long text "), F.col("id") % 11)).alias("t"),
    )
    thin, known = by_reference(spark, rows, "t")
    got = [tuple(r) for r in texts.ordered_with_texts(thin.repartition(5), known, "t", ["a", "b"], parts).collect()]
    assert got == [tuple(r) for r in rows.orderBy("a", "b").collect()]


def test_scan_all_keeps_its_order(spark, sf):
    got = [(r.SITE, r.ISBN, r.TITULO, r.URL) for r in base.QUERIES["scan_all"](spark, sf).collect()]
    assert got == sorted(got)


def test_rules_by_reference_give_the_same(spark, sf):
    words = ["the end of the day", "el fin de los días", "", None, "l'été", "ÁÉ y", "no es of"]
    rows = spark.createDataFrame([(f"u{i}", a, b, lang) for i, (a, b, lang) in enumerate(itertools.product(words, [*words, "a the in. é"], ["", "Español"]))], "url string, titulo string, sinopsis string, idioma string")
    rows = rows.withColumns({"isbn": F.lit("1"), "url_portada": F.lit("")})
    thin, known = by_reference(spark, rows, "sinopsis")
    pick = lambda df: rows_of(df.select("url", "idioma", F.to_json("qc_issues").alias("q")))
    for mode in ("flag", "fix"):
        assert pick(standard.qc_rules(thin, mode, texts=known)) == pick(standard.qc_rules(rows, mode))
    raw = rows.select(F.lit("s").alias("site"), F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(["url"] * 2 + ["titulo"] * 2 + ["sinopsis"] * 2)]).alias("raw"), F.create_map().cast("map<string,string>").alias("info"))
    thin_raw = thin.select(F.lit("s").alias("site"), F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(["url"] * 2 + ["titulo"] * 2 + ["sinopsis"] * 2)]).alias("raw"), F.create_map().cast("map<string,string>").alias("info"))
    whole = lambda df: rows_of(df.withColumn("qc_issues", F.to_json("qc_issues")))
    assert whole(standard.standardize(thin_raw, known)) == whole(standard.standardize(raw))


def test_rules_are_compiled(spark, sf):
    """What is bound in an expression, by a lambda, is interpreted."""
    rules = standard.qc_rules(fixtures.listings(spark, sf), "flag", texts=fixtures.texts(spark, sf))
    assert "transform(" not in rules._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_met_with_the_keys_at_once(spark):
    m = spark.createDataFrame([({"ean": "1", "gtin13": "2"}, {"isbn": "3"}), ({"x": "1"}, {"isbn": "3", "ean": "4"}), ({}, {}), (None, None)], "r map<string,string>, i map<string,string>")
    got = m.select(standard.pick(F.col("r"), standard.ALIASES["isbn"], F.col("i")).alias("v"), standard.pick(F.col("r"), standard.ALIASES["isbn"]).alias("w"))
    assert [tuple(r) for r in got.collect()] == [("2", "2"), ("3", ""), ("", ""), ("", "")]
    assert "lambdafunction" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stop_words_are_whole_words(spark):
    t = spark.createDataFrame([("A la la-el ELLA. is 1a2 this\nthe ñan lañ",), ("",), (None,)], "t string")
    got = [tuple(r.c) for r in t.select(values.language_counts(F.col("t")).alias("c")).collect()]
    assert got == [(5.0, 5.0, 2), (0.0, 0.0, 0), (0.0, 0.0, 0)]


def test_lineage_meets_each_text_once(spark, sf):
    plan = base.QUERIES["wrap_lineage"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


# ---- matching


def test_an_items_listings_lie_together(spark, sf, tmp_path):
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        for t in ("lineitem", "part", "documents"):
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
        files = fixtures.listings(spark, str(tmp_path)).select("pk", F.input_file_name()).distinct().groupBy("pk").count()
        assert files.agg(F.max("count")).first()[0] == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lookup_shuffles_only_the_best_rows(spark):
    long, short = "9780306406157", "0306406152"
    rows = [(long, "b", "u1", 1, "t"), (short, "a", "u2", 2, "t"), (long, "a", "u3", 1, None), (short, "Amazon_Books ", "u4", 1, "t"), ("", "a", "u5", 9, "t"), (None, "a", "u6", 9, "t"), ("77", "a", "u8", None, "t"), ("77", "a", "u7", None, "t")]
    std = spark.createDataFrame(rows, "isbn string, site string, url string, updated_at int, titulo string").withColumns({c: F.lit("x") for c in matching.SCORED if c != "titulo"})
    found = matching.lookup(std, std.select("isbn").union(spark.createDataFrame([("5",)], "isbn string")))
    assert sorted((r.asked, r.url, r.filled, r.n_rows, r.missing) for r in found.collect()) == [(short, "u4", 9, 4, ""), ("77", "u7", 9, 2, ""), (long, "u4", 9, 4, "")]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()




def test_pairs_are_not_sorted_to_find_those_that_come_twice(spark):
    q = spark.createDataFrame([(1, "9780306406157", "red lamp"), (2, "0306406152", "red lamp"), (3, None, "red lamp"), (4, "9780306406157", None), (5, "", "blue")], "query_id long, q_isbn string, q_title string")
    c = spark.createDataFrame([(1, "9780306406157", "Red lamp"), (2, "9780306406157", "red LAMP"), (3, "9780306406157", "other"), (4, None, "red lamp x"), (5, "0306406152", "red lamp"), (6, "", "red lamp")], "cand_id long, isbn string, titulo string")
    found = matching.match_pairs(q, c)
    got = [(r.query_id, r.cand_id) for r in found.collect()]
    assert sorted(got) == sorted(set(got))
    number = {(a, b) for a in (1, 2, 4) for b in (1, 3, 5)}
    assert set(got) == number | {(a, b) for a in (1, 2, 3) for b in (1, 4)}
    assert "hashpartitioning(query_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_links_and_members_give_all_pairs(spark):
    """Of all candidates, copies and other spellings too, none that meets a query is left out."""
    q = spark.createDataFrame([(1, "9780306406157", "red lamp"), (2, "0306406152", "blue"), (3, None, "Red  lamp"), (4, "", None)], "query_id long, q_isbn string, q_title string")
    offered = [(1, "9780306406157", "red lamp"), (2, "9780306406157", "red lamp"), (3, "0306406152", "RED lamp!"), (4, None, "red lamp"), (5, "", "RED lamp!"), (6, "1", "green"), (7, "9780306406157", None), (8, "9780306406157", None), (9, "1", "blue sky"), (10, "2", "blue sky"), (11, None, None)]
    c = spark.createDataFrame(offered, "cand_id long, isbn string, titulo string")
    rows = matching.match_links(q, c).collect()
    members = {r.cand_id: r for r in rows if r.by == "member"}
    assert sorted(members) == [o[0] for o in offered] and len(rows) == len({(r.query_id, r.cand_id, r.by) for r in rows})
    got = {}
    for r in rows:
        for m in members.values() if r.by != "member" else ():
            if r.cand_id == (m.offer_id if r.by == "number" else m.title_id):
                got.setdefault((r.query_id, m.cand_id), set()).add((r.by, r.titulo_match_estricto, round(r.similitud_titulo, 6)))
    titled = {(a, b) for a in (1, 3) for b in (1, 2, 3, 4, 5)} | {(2, 9), (2, 10)}
    assert set(got) == titled | {(a, b) for a in (1, 2) for b in (1, 2, 3, 7, 8)}
    assert {p for p, how in got.items() if any(by == "title" for by, *_ in how)} == titled
    text = {i: t for i, _, t in offered}
    for (a, b), how in got.items():
        asked = {1: "red lamp", 2: "blue", 3: "red  lamp"}[a]
        same = difflib.SequenceMatcher(None, asked, text[b].lower()).ratio() if text[b] else 0.0
        assert {s for *_, s in how} == {round(same, 6)}


def test_verification_share_works_on_distinct_titles(spark):
    pairs = spark.range(4000).select(F.lit("red lamp").alias("q_title"), F.when(F.col("id") % 2 == 0, "red lamp").when(F.col("id") % 3 == 0, "zzz").alias("titulo"))
    assert tuple(matching.verification_share(pairs, 0.8).first()) == (4000, 2000)
    assert tuple(matching.verification_share(pairs.limit(0), 0.8).first()) == (0, 0)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 199])
def test_bounds_are_counted_by_halves(spark, n):
    bounds = sorted({f"{k * 37 % 1000:03d}" for k in range(n)})
    keys = spark.range(0, 1000, 7).select(F.format_string("%03d", "id").alias("k")).union(spark.createDataFrame([("",), (bounds[0],), (bounds[-1],)], "k string"))
    key, bound = F.struct("k"), F.array(*[F.struct(F.lit(b).alias("k")) for b in bounds])
    counted = keys.select("k", texts.bounds_passed(key, bound, len(bounds)).alias("n"))
    assert all(r.n == bisect.bisect_right(bounds, r.k) for r in counted.collect())
    assert "size(filter" not in counted._jdf.queryExecution().optimizedPlan().toString()  # which compares a row with all bounds


def test_rows_without_a_number_are_no_single_tasks_work(spark):
    shape = "site string, url string, seq long, updated_at timestamp, " + ", ".join(f"{c} string" for c in merge.ENRICHED)
    rows = spark.createDataFrame([("amazon_books", str(k), k, None, str(k % 2), *[""] * 9) for k in range(200)], shape)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        parts = merge.enrich(rows, rows, F.current_timestamp()).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert parts > 1


def test_a_table_of_changes_reads_the_columns_asked_for(spark, tmp_path):
    held = changes.ChangeTable(spark, str(tmp_path / "t"), ["k"], "v")
    held.append(spark.createDataFrame([("a", "1", "x", 1), ("a", "2", "y", 2), ("b", "3", "z", 1)], "k string, v string, w string, seq long"), "c", 0, "seq")
    some = held.read(["v"])
    assert sorted(map(tuple, some.collect())) == [("a", "2"), ("b", "3")]
    assert "w:string" not in some._jdf.queryExecution().executedPlan().toString()
    assert [r.k for r in held.find(spark.createDataFrame([("2",), ("3",)], "v string"), without=spark.createDataFrame([("a",)], "k string")).collect()] == ["b"]


def test_a_batch_is_appended_without_a_shuffle(spark, tmp_path, monkeypatch):
    plans = []
    append = changes.ChangeTable.append
    monkeypatch.setattr(changes.ChangeTable, "append", lambda self, rows, *a: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), append(self, rows, *a)))
    shape = "site string, url string, isbn string, encuadernacion string, titulo string, seq long"
    batch = spark.createDataFrame([("a", "u", "1", "", "new", 2), ("a", "u", "1", "", "old", 1), ("a", " ", "1", "", "none", 1)], shape)
    jobs.capture_batch(str(tmp_path / "t"), "c")(batch, 0)
    assert "Exchange" not in plans[0] and [r.titulo for r in jobs.capture_table(spark, str(tmp_path / "t")).read().collect()] == ["new"]


def test_plans_do_not_show_names_of_references(spark):
    rows = spark.createDataFrame([("&rarr;x&DownArrow;&eacuteb",)], "t string").select(text.strip_html(F.col("t")).alias("t"))
    assert rows.first().t == "\u2192x\u2193\u00e9b"
    assert "Arrow" not in rows._jdf.queryExecution().executedPlan().toString()


def test_only_the_fields_asked_for_are_looked_for(spark):
    spec = site_specs.spec_of("amazon_books")
    page = spark.createDataFrame([(1, "u", "<span id='productTitle'> a &amp; b </span><li><span class='a-text-bold'>ISBN-13 :</span><span>978-0306406157</span></li><li><span class='a-text-bold'>Idioma</span><span>Español</span></li>")], "page_id long, url string, html string")
    few, whole = site_specs.extract_fields(page, spec, ["isbn", "titulo"]), site_specs.extract_fields(page, spec)
    assert few.columns == ["page_id", "url", "titulo", "isbn"] and few.first() == whole.select(few.columns).first() == (1, "u", "a & b", "9780306406157")
    asked = lambda df: set(re.findall(r"\bs\d+#", df._jdf.queryExecution().analyzed().toString()))
    assert len(asked(few)) == len({s for n in ("isbn", "titulo") for s, _ in spec.fields[n]}) < len(asked(whole))
    sizes = spark.createDataFrame([(1, "u", "<div class='ficha-tecnica'>" + "".join(f"<p data-campo='{n}'><b>{n}:</b> {v}</p>" for n, v in (("Alto", 3), ("Ancho", 2), ("Grueso", 1))) + "</div>")], "page_id long, url string, html string")
    assert site_specs.extract_fields(sizes, site_specs.spec_of("cuspide"), ["dimensiones"]).first() == (1, "u", "3 x 2 x 1")


def test_pages_are_read_in_few_steps(monkeypatch):
    """A tag in which a selector's value stands nowhere is not taken apart, unless by a reference."""
    page = elements.Page("<div>" + "<p class='x'>a</p>" * 50 + "<b class='y&#122;'>c</b><i class='yz'>d</i></div>")
    assert [elements.select(page, s) for s in (".yz", ".yz (1)", "p.x (49)", "div > i", "p.q")] == ["c", "d", "a", "d", ""]
    other = elements.Page(page.html)
    taken, read = [], elements.Page.attributes
    monkeypatch.setattr(elements.Page, "attributes", lambda self, node: taken.append(node) or read(self, node))
    assert elements.select(other, ".yz") == "c" and len(taken) == 2


@pytest.mark.parametrize("name", ["harmonize", "coerce_legacy", "wrap_lineage"])
def test_rows_meet_their_texts_before_they_are_made(spark, sf, name):
    """No exchange holds a finished row: its address is put together behind all of them, also where texts are too many to broadcast."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", False)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        df = base.QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        want = df.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lines = plan.split("== ")[0].splitlines()
    last = max(i for i, x in enumerate(lines) if "example.org" in x)
    first = min(i for i, x in enumerate(lines) if "Exchange" in x)
    assert last < first and want == base.QUERIES["count_total"](spark, sf).first()[0]


@pytest.mark.parametrize("handed", [0, 64 << 20])
def test_few_texts_are_not_shuffled_for_an_order(spark, monkeypatch, handed):
    monkeypatch.setattr(texts, "HANDED", handed)
    rows = spark.range(900).select(F.format_string("%05d", (F.col("id") * 7919) % 900).alias("a"), F.when(F.col("id") % 5 == 0, "").when(F.col("id") % 7 != 0, F.concat(F.lit("long text "), F.col("id") % 11)).alias("t"))
    thin, known = by_reference(spark, rows, "t")
    known = known.union(spark.createDataFrame([("", ""), ("", "")], "ref string, text string"))  # what is blank stands for itself
    got = texts.ordered_with_texts(thin.repartition(5), known, "t", ["a"])
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in rows.orderBy("a").collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan) == bool(handed)
