"""Golden values, invariants, sources, sinks and streams."""

import difflib
import html
import json
import os
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from shelfmerge.functions import ids, text, urls, values
from shelfmerge.operators import elements, extract, gold, matching, merge, site_specs, standard, worklist
from shelfmerge.plans.fixtures import book_std, lease_events
from shelfmerge.sources import readers, writers
from shelfmerge.streaming import jobs


def one(spark, f, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (values.parse_date_iso, "09/03/2022", "2022-03-09"),
        (values.parse_date_iso, "2022-3-9", "2022-03-09"),
        (values.parse_date_iso, "marzo", "marzo"),
        (values.parse_month_date, "16 Mayo 2023", "2023-05-16"),
        (values.parse_month_date, "10 Octubre 2023", "2023-10-10"),
        (values.parse_month_date, "May 16, 2023", "2023-05-16"),
        (values.parse_month_date, "1 de enero de 2020", "2020-01-01"),
        (values.normalize_binding, "Paperback (8/28/2006)", "De Bolsillo"),
        (values.normalize_binding, "Trade Paperback", "De Bolsillo"),
        (values.normalize_binding, "RÚSTICA", "Rústica"),
        (values.normalize_binding, "s/d", ""),
        (values.normalize_binding, "Espiral", "Espiral"),
        (values.format_dimensions, "21,5 X 14", "21.5 x 14 cm"),
        (values.format_dimensions, "21x14 MM", "21 x 14 MM"),
        (values.format_dimensions, "21x14 CM", "21 x 14 cm"),
        (values.binding_from_subtitle, "Tapa blanda – 1 mayo 2020", "Tapa blanda"),
        (values.placeholder_cover, "https://h/no-image.png", "pattern:no-image"),
        (values.placeholder_cover, "data:image/png;base64,xx", "data_uri"),
        (values.placeholder_cover, "https://h/img/cover", "no_extension"),
        (values.placeholder_cover, "https://h/img/cover.jpg", None),
        (text.dedupe_repeated, "Ficción Ficción", "Ficción"),
        (text.dedupe_repeated, "FicciónFicción", "Ficción"),
        (text.dedupe_repeated, "A B A B", "A B"),
        (text.titleish, "EL QUIJOTE", "El Quijote"),
        (text.titleish, "IBM", "IBM"),
        (text.titleish, "LA CAÍDA DE O'NEILL-DÍAZ  (TOMO 2B)", "La Caída De O'Neill-Díaz  (Tomo 2B)"),
        (values.simplify_binding, "  Encuadernación de  Piel ", "piel"),
        (values.simplify_binding, "Encuadernación de tapa dura", "tapa dura"),
        (values.simplify_binding, "Mass Market Paperback", "tapa blanda"),
        (values.simplify_binding, "Rústica con solapas", "rustica"),
        (values.simplify_binding, None, ""),
        (text.normalize_language, "CASTELLANO", "Español"),
        (text.clean_text, " a b​\t c﻿ ", "a b c"),
        (text.strip_html, "<p>a<br/>b &amp;amp; c</p><li>d", "a b &amp; c d"),
        (text.slugify, "  Hola, Mundo! ", "hola-mundo"),
        (ids.isbn13_to_isbn10, "978-84-376-0494-7", "843760494X"),
        (ids.isbn10_to_isbn13, "8437604945", "9788437604947"),
        (ids.isbn13_to_isbn10, "9791234567896", ""),
        (ids.normalize_isbn, "9788418184888.0", "9788418184888"),
        (ids.isbn_from_url, "https://h/x-9788437604947-y", "9788437604947"),
        (urls.canonical_url, "//h/a?b#c", "https://h/a"),
    ],
)
def test_golden_values(spark, f, given, want):
    assert one(spark, f, given) == want


@pytest.mark.parametrize(
    ("given", "locale", "want"),
    [
        ("₲170.000", "PYG", "170000.00"), ("$ 38.800,00", "ARS", "38800.00"), ("$1,234.5", "USD", "1234.50"),
        ("$76.330", "CLP", "76330.00"), ("26.95", "mixed", "26.95"), ("1.234,56", "mixed", "1234.56"), ("gratis", "USD", None),
    ],
)
def test_prices(spark, given, locale, want):
    got = one(spark, lambda c: values.parse_price(c, locale), given)
    assert (None if got is None else str(got)) == want


def test_guess_language(spark):
    g = lambda t: one(spark, values.guess_language, t)
    assert g("el libro de la casa y los niños").lang == "Español"
    assert g("the book of the house and that").lang == "Inglés"
    assert g("libro").lang == "" and g("").conf == 0


def test_round_trip_of_numbers(spark):
    n = spark.range(0, 500).select(F.concat(F.lit("978"), F.lpad((F.col("id") * 7919).cast("string"), 9, "0"), F.lit("0")).alias("raw"))
    whole = n.select(ids.isbn10_to_isbn13(ids.isbn13_to_isbn10(F.col("raw"))).alias("a"))
    again = whole.select("a", ids.isbn10_to_isbn13(ids.isbn13_to_isbn10(F.col("a"))).alias("b"))
    assert again.filter("a <> b or a = ''").count() == 0


def test_upsert_is_idempotent_and_can_preserve(spark):
    now = F.lit("2025-01-01").cast("timestamp")
    t = spark.createDataFrame([("s", "u", "1", "a")], "site string, url string, isbn string, titulo string")
    u = spark.createDataFrame([("s", "u", "2", "", 1), ("s", "v", "3", "b", 2), ("", "w", "4", "c", 3)], "site string, url string, isbn string, titulo string, seq int")
    once = merge.upsert_listings(t, u, now)
    assert {(r.url, r.titulo) for r in once.collect()} == {("u", ""), ("v", "b")}
    twice = merge.upsert_listings(once.drop("_inserted", "_updated"), u, now)
    assert twice.agg(F.sum("_inserted")).first()[0] == 0
    assert {r.titulo for r in merge.upsert_listings(t, u, now, preserve=True).collect()} == {"a", "b"}
    assert merge.upsert_counts(once).first().asDict() == {"inserted": 1, "updated": 1}


def test_one_master_row_per_number(spark, sf):
    std = book_std(spark, sf)
    m = gold.master(gold.listing_best(std))
    assert m.count() == m.select("ISBN").distinct().count() == std.filter("isbn <> ''").select("isbn").distinct().count()


def test_found_and_missing_make_submitted(spark, sf):
    std = book_std(spark, sf)
    q = worklist.chunk_worklist(worklist.isbn_lines(spark.createDataFrame([(i, f"978000000{i:04d}") for i in range(90)], "line_no long, raw string")))
    c = worklist.coverage(q, std)
    assert c.filter("submitted <> found + missing").count() == 0


def test_one_shuffle_from_listing_to_master(spark, sf):
    plan = gold.master(gold.listing_best(book_std(spark, sf).cache()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(isbn") == 1


def test_readers_and_writers(spark, tmp_path):
    lists = tmp_path / "l.txt"
    lists.write_text("﻿9788437604947\n# no\n\n8437604945\ttitle\n9788437604947|again\nword\n", encoding="utf-8")
    assert [r.isbn for r in readers.read_isbn_list(spark, str(lists)).orderBy("line_no").collect()] == ["9788437604947", "8437604945"]
    items = readers.read_query_items(spark, str(lists), "url").collect()
    assert {i.title for i in items} >= {"title", "again", "word"}
    q = readers.read_queue(spark, str(lists)).collect()
    assert {r.isbn for r in q} >= {"9788437604947"} and all(r.amazon_search_url for r in q)
    (tmp_path / "q.csv").write_text("isbn,site,url\n978-8437604947,s,u\n,x,y\n")
    assert [r.isbn for r in readers.read_queue(spark, str(tmp_path / "q.csv")).collect()] == ["9788437604947"]
    assert readers.read_site_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "s.csv").write_text("Isbn,t\n978-1,x\n")
    assert readers.read_site_csv(spark, str(tmp_path / "s.csv")).first().isbn == "9781"
    (tmp_path / "cap").mkdir()
    (tmp_path / "cap" / "a.json").write_text(json.dumps([{"SITE": "amazon", "URL": "u", "_amazon_detail_kv": {"ISBN-13": "978-8437604947"}, "FECHA PUBLICACION": "May 1, 2020"}, {"URL": "no site"}]))
    (tmp_path / "cap" / "b.json").write_text(json.dumps({"SITE": "z", "URL": "v", "ISBN": "1"}))
    caps = standard.coerce_captures(readers.read_captures(spark, str(tmp_path / "cap"))).collect()
    assert {(c.SITE, c.ISBN) for c in caps} == {("amazon_books", "9788437604947"), ("z", "1")}
    (tmp_path / "m.xml").write_text("<urlset><url><loc>https://h/es/12?x</loc></url><url><loc>https://h/about</loc></url><url><loc>https://h/es/12</loc></url></urlset>")
    assert [r.url for r in readers.read_sitemap_urls(spark, str(tmp_path / "m.xml")).collect()] == ["https://h/es/12"]
    a = spark.createDataFrame([("x", {"k": "v"})], "site string, m map<string,string>")
    b = spark.createDataFrame([("y", 2)], "site string, n int")
    writers.write_union_csv(str(tmp_path / "u"), a, b)
    back = spark.read.option("header", True).csv(str(tmp_path / "u"))
    assert set(back.columns) == {"site", "m", "n"} and back.count() == 2
    writers.write_standard(b.select("site"), str(tmp_path / "std"), full=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "std")).columns[0] == "isbn"
    lines = spark.range(0, 120).select(F.col("id").alias("line_no"), F.col("id").cast("string").alias("raw"))
    writers.write_chunks(lines, str(tmp_path / "chunks"))
    assert len([d for d in os.listdir(tmp_path / "chunks") if d.startswith("chunk=")]) == 3
    writers.write_worklist(lines, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).count() == 120


def test_extraction_of_odd_pages(spark):
    rows = [(1, "https://h/a/b", None), (2, "https://h/a", ""), (3, "https://h/", "<script type='application/ld+json'>{bad</script><a href='../x'>y</a>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for f in (extract.extract_fields, extract.extract_links, extract.extract_kv, extract.extract_jsonld, extract.extract_breadcrumb, extract.extract_contributors, extract.extract_formats, extract.max_page):
        f(df).collect()
    assert extract.extract_block(df, "x").count() == 3


GOLDEN = {
    "el_lector": (
        "<img class='w-100' src='/i/1.jpg'><h1 class='product_title'>El t&iacute;tulo</h1><div class='product-brand'>Autor: <a>Ana D&#237;az</a></div><span class='sku'>978-1</span>"
        "<div class='format'><span class='value'>Libro - Tapa dura</span><span class='value'>Espa&ntilde;ol</span></div><table><tr><th>Páginas</th><td>120</td></tr><tr><th>Medidas</th><td>21,5 X 14</td></tr></table>",
        {"titulo": "El título", "autor": "Ana Díaz", "isbn": "9781", "idioma": "Español", "paginas": "120 págs", "dimensiones": "21.5 x 14 cm", "url_portada": "/i/1.jpg"},
    ),
    "riverside": (
        "<header><h1>T</h1></header><p>uno</p><p>dos</p><dl><dd class='tapa'>Blanda</dd><dd class='paginas'>99</dd></dl><li>Editor: E</li><a id='portada_imagen' class='x' href='/p.jpg'>",
        {"titulo": "T", "encuadernacion": "Blanda", "editorial": "E", "sinopsis": "uno\ndos", "url_portada": "/p.jpg", "autor": ""},
    ),
    "yenny": (
        "<h1 class='js-product-name'>T</h1><span id='price_display' class='p' data-product-price='123400'>$1.234</span><div><strong>Fecha de publicación:</strong> 09/03/2022</div><div><strong>Páginas:</strong> 7</div>",
        {"titulo": "T", "precio": "123400", "fecha_publicacion": "2022-03-09", "paginas": "7 págs"},
    ),
    "bookpeople": (
        "<h1 class='product-details__title'>T</h1><time datetime='2025-11-18T00:00:00-06:00'>x</time><p class='product-details__price'>Now $12.50</p><select name='related_products'><option>a</option><option selected>Hardcover</option></select>",
        {"titulo": "T", "fecha_publicacion": "2025-11-18", "precio": "12.50", "encuadernacion": "Hardcover"},
    ),
    "amazon_books": (
        '<script type="application/ld+json">{"name":"The T","author":[{"@type":"Person","name":"A B"}],"isbn":"9780000000002"}</script><span id="productTitle">Other</span><span id="productSubtitle" class="s">Paperback – May 1, 2020</span>'
        '<span class="a-text-bold">Print length \u200f : \u200e </span> <span>310 pages</span><img id="landingImage" src="s.jpg" data-old-hires="big.jpg">',
        {"titulo": "The T", "autor": "A B", "isbn": "9780000000002", "encuadernacion": "Paperback", "paginas": "310 págs", "url_portada": "big.jpg"},
    ),
    "contrapunto": (
        "<div class='product__title'><h1>T <b>dos</b></h1></div><div class='pivot-authors'><a>Ana</a>, <a>Luis</a><a>Ana</a></div><p class='pivot-metadata'><strong>EDITORIAL:</strong> Blume<br><b>ISBN:</b> 978-84 <br>"
        "N° DE PÁGINAS: 320<br><b>FECHA DE PUBLICACIÓN:</b><i>09/03/2022</i></p><span class='price-item price-item--sale'>$9.265 CLP</span><details><summary>Envíos</summary><div class='accordion__content'>no</div></details>"
        "<details><summary><h2>Descripción del libro</h2></summary><div class='accordion__content rte'><p>Un <div>texto</div></p></div></details><div class='product__media'><img src='//c/p.jpg'></div>",
        {"titulo": "T dos", "autor": "Ana, Luis", "editorial": "Blume", "isbn": "97884", "paginas": "320 págs", "fecha_publicacion": "2022-03-09", "precio": "9265", "sinopsis": "Un texto", "url_portada": "//c/p.jpg", "idioma": ""},
    ),
    "cuspide": (
        "<main><div><div><h1 id='t-p-f'>El T</h1></div><a href='/libros-ebooks/ana/1'>Ana D</a><a href='/libros-ebooks/x'>Ver más</a></div></main><div class='producto-asociado'><p>Ebook 5,00 €</p></div>"
        "<div class='producto-asociado selected'><p>Tapa dura<p>1.021,50 €</div><div class='ficha-tecnica' id='contributors'><span data-campo='ISBN'><b>ISBN:</b> 9788400000000 <span class='tooltip'>hint</span></span>"
        "<span data-campo='Editorial'><b>Editorial:</b> <a>ALMA ALMA</a></span><span data-campo='Alto'><b>Alto:</b> 21 cm</span><span data-campo='Ancho'><b>Ancho:</b> 14 cm</span><span data-campo='Grueso'><b>Grueso:</b> 2 cm</span></div>"
        "<div class='resumen-content'>corto</div><div class='resumen-content'><p>uno</p><p>dos tres</p></div><cdl-img><img src='a.jpg' srcset='b.jpg 100w, c.jpg 300w'></cdl-img><a href='/libros-ebooks/otro'>Otro</a>",
        {"titulo": "El T", "autor": "Ana D", "precio": "1021.50", "encuadernacion": "Tapa dura", "isbn": "9788400000000", "editorial": "ALMA", "dimensiones": "21 cm x 14 cm x 2 cm", "sinopsis": "uno\ndos tres", "url_portada": "c.jpg"},
    ),
    "casa_del_libro": (
        "<h1>T</h1><h2>Sinopsis de T</h2><div class='resumen'><div class='resumen-content'>uno<br>dos</div></div><div class='ficha-tecnica'><div data-campo='ISBN'><b>ISBN:</b>9788400000000</div>"
        "<div data-campo='Encuadernación'>Encuadernación: Tapa blanda</div><div data-campo='Idioma'>Idioma: CASTELLANO CASTELLANO</div></div><img src='x.jpg'>",
        {"titulo": "T", "isbn": "9788400000000", "encuadernacion": "Tapa blanda", "idioma": "CASTELLANO", "sinopsis": "uno\ndos", "url_portada": "x.jpg", "dimensiones": ""},
    ),
    "iberlibro": (
        "<img id='isbn-image' src='/i.jpg'><h2 id='book-author'>de <a>Ana D</a></h2><dl class='listing-metadata'><dt>Título:</dt><dd>El T</dd><dt>Editor</dt><dd>Alma</dd><dt>Fecha de publicación</dt><dd>1999</dd>"
        "<dt>ISBN 10</dt><dd>84-000</dd><dt>ISBN 13</dt><dd>978-84000</dd><dt>Encuadernación<dd>Encuadernación de tapa dura</dl><dl><dt>Editor</dt><dd>no</dd></dl>",
        {"titulo": "El T", "autor": "Ana D", "editorial": "Alma", "fecha_publicacion": "1999", "isbn": "97884000", "encuadernacion": "tapa dura", "url_portada": "/i.jpg"},
    ),
}


@pytest.mark.parametrize("site", sorted(GOLDEN))
def test_golden_pages_of_sites(spark, site):
    html, want = GOLDEN[site]
    row = site_specs.extract_fields(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), site_specs.spec_of(site)).first()
    assert {k: row[k] for k in want} == want


TREE = """<!doctype html><!-- <p id=no> --><DIV id=a class="x y"><p>one<p>two <b title='1 > 0'>bold</b> end</div><script>if (a < b) "<p id='s'>"</script>
<ul><li>Autor: <i>A: B</i><li class=k>in<ul><li>deep</ul></ul><img src=i.jpg alt="<p>"><p data-x="unclosed>three</p><br/>last"""


@pytest.mark.parametrize(
    ("s", "want"),
    [
        ("p", "one"), ("p (1)", "two <b title='1 > 0'>bold</b> end"), ("#a > p b", "bold"), (".x.y p b @title", "1 > 0"), ("p#s", ""), ("#no", ""), ("div b ..", " end"),
        ("li{autor:}", " <i>A: B</i>"), ("li li", "deep"), ("ul > li.k", "in<ul><li>deep</ul>"), ("li.k !z", "in<ul><li>deep</ul>"), ("img @src", "i.jpg"), ("img @alt", "<p>"), ("b ^ li", "Autor: <i>A: B</i>"),
        ("div + script ", 'if (a < b) "<p id=\'s\'>"'), ("script[:inner*=\"a < b\"] + ul li i", "A: B"), ("p{~TWÓ} b", "bold"), ("b (*)", "bold"), ("li (*)", "\x1f".join(["Autor: <i>A: B</i>", "in<ul><li>deep</ul>", "deep"])), ("p (7)", ""),
    ],
)
def test_selectors(s, want):
    assert elements.select(elements.Page(TREE), s) == want


def test_unreadable_selectors_are_errors():
    for bad in ("p >", "&", "p { x"):
        with pytest.raises(ValueError):
            elements.selector(bad)


def test_a_megabyte_takes_linear_time():
    import time

    took = {}
    for form in ("<a ", "<p>x", "<div>", "<a b='", '<a b="c', "</p>", "<li>", "<!--", "<script>"):
        for n in (50_000, 200_000):
            began = time.perf_counter()
            elements.select(elements.Page(form * n), "div p > b")
            took[form, n] = time.perf_counter() - began
        assert took[form, 200_000] < 12 * took[form, 50_000] + 0.5, form


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    got = [r.v for r in df.select(matching.title_similarity("a", "b").alias("v")).collect()]
    assert got == [0.75, 0.0]


@pytest.mark.parametrize("part", [3, 1 << 16])
@pytest.mark.parametrize("overlap", [0.5, 0.8])
def test_title_pairs_against_all_pairs(spark, monkeypatch, part, overlap):
    monkeypatch.setattr(matching, "PART", part)  # three rows make a word hot: it is dealt in parts
    rng = random.Random(part)
    common, rare = ["the", "lost", "of"], [f"w{i}" for i in range(25)]
    title = lambda: " ".join(rng.choices(common, k=rng.randint(0, 3)) + rng.choices(rare, k=rng.randint(0, 4)))
    asked = [(i, "", title()) for i in range(60)] + [(60, None, None), (61, "", "  "), (62, "", "THE, Lost"), (63, "", "the lost")]
    offered = [(i, "", title()) for i in range(150)] + [(150, None, None), (151, "", "The"), (152, "", "the lost"), (153, "", "Thé lost!")]
    q = spark.createDataFrame(asked, "query_id long, q_isbn string, q_title string")
    c = spark.createDataFrame(offered, "cand_id long, isbn string, titulo string")
    words = lambda t: tuple(re.findall("[a-z0-9]+", (t or "").lower().replace("é", "e")))
    first = {}
    for i, _, t in offered:
        if words(t):
            first.setdefault(words(t), i)
    want = set()
    for i, _, t in asked:
        for other, j in first.items():
            a, b = set(words(t)), set(other)
            n = len(a & b)
            if a and (n >= overlap * len(a | b) - 1e-9 or n == min(len(a), len(b))):
                want.add((i, j))
    got = matching.match_candidates(q, c, overlap).collect()
    assert {(r.query_id, r.cand_id) for r in got} == want and len(got) == len(want) > 60
    for r in got:
        assert r.similitud_titulo == difflib.SequenceMatcher(None, r.q_title.lower(), r.titulo.lower()).ratio()
    assert matching.match_candidates(q.limit(0), c).count() == 0 == matching.match_candidates(q, c.limit(0)).count()


def test_pairs_by_number_keep_one_of_each_title(spark):
    q = spark.createDataFrame([(1, "978-0-306-40615-7", None), (2, "", "x y")], "query_id long, q_isbn string, q_title string")
    c = spark.createDataFrame([(1, "0306406152", "a b"), (2, "0306406152", "A, B"), (3, "9780306406157", "a b"), (4, "", "x")], "cand_id long, isbn string, titulo string")
    got = {(r.query_id, r.cand_id) for r in matching.match_pairs(q, c).collect()}
    assert got == {(1, 1), (1, 3), (2, 4)}


def test_lease_folds_by_bursts(spark):
    """Against the fold over each whole log: busy numbers, pauses around the lease's length, runs over midnight, ties."""
    rng, rows = random.Random(5), []
    for isbn in range(40):
        at = 86_400 * 20_000 - rng.randint(0, 4000)
        for k in range(rng.choice([1, 3, 60])):
            at += rng.choice([0, 1, 29, 30, 31, 20, 25, 90_000 if k % 20 == 19 else 5])
            action = rng.choice(["claim"] * 4 + ["heartbeat"] * 6 + ["release"] + (["done", "skip"] if isbn % 3 == 0 else []))
            rows.append((len(rows), at, str(isbn), f"w{rng.randint(0, 3)}", action))
    ev = spark.createDataFrame(rows, "event_id long, at long, isbn string, worker string, action string").selectExpr("*", "timestamp_seconds(at) AS ts")
    as_of, want = max(r[1] for r in rows) - 3, {}
    for _, at, isbn, worker, action in sorted(rows, key=lambda r: (r[1], r[0])):
        if at > as_of:
            continue
        status, who, until = want.setdefault(isbn, ("open", None, None))
        live = status == "in_progress" and until > at
        if status in ("done", "skipped"):
            continue
        if action == "claim" and not live:
            want[isbn] = ("in_progress", worker, at + 30)
        elif live and action == "heartbeat":
            want[isbn] = (status, who, at + 30)
        elif live and action == "release":
            want[isbn] = ("open", None, None)
        elif live and action in ("done", "skip"):
            want[isbn] = ({"done": "done", "skip": "skipped"}[action], who, None)
    want = {k: ("open", None, None) if v[0] == "in_progress" and v[2] <= as_of else v for k, v in want.items()}
    got = worklist.lease_state(ev, F.timestamp_seconds(F.lit(as_of)), 30).selectExpr("isbn", "status", "worker", "unix_seconds(expires_at) AS u").collect()
    assert {r.isbn: (r.status, r.worker, r.u) for r in got} == want and len(got) == len(want)
    assert {v[0] for v in want.values()} >= {"open", "done"}


CAPTURED = "site string, url string, isbn string, titulo string, encuadernacion string, updated_at timestamp, seq bigint"


def captures_of(spark, *keys, title="t"):
    return spark.createDataFrame([("s", k, "", f"{title} {k}", "", None, n) for n, k in enumerate(keys)], CAPTURED)


def titles(spark, table):
    held = jobs.capture_table(spark, table).read()
    return {} if held is None else {r.url: r.titulo for r in held.collect()}


def stopped_write(table, folder):
    """What a write that was stopped leaves behind: a folder with a part file and no _SUCCESS."""
    os.makedirs(f"{table}/{folder}/_temporary")
    open(f"{table}/{folder}/part-0.parquet", "wb").write(b"half")


def test_a_write_stopped_anywhere_loses_no_row(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    held, put = jobs.capture_table(spark, table), jobs.capture_batch(table, "c", every=3)
    put(captures_of(spark, "a", "b", "c"), 0)
    want = {k: f"t {k}" for k in "abc"}
    assert titles(spark, table) == want
    # while a change is written
    stopped_write(table, f"change-{2:012d}-{held.batch_name('c', 1)}")
    assert titles(spark, table) == want and not held.seen("c", 1)
    put(captures_of(spark, "b", "d", title="new"), 1)
    want |= {"b": "new b", "d": "new d"}
    assert titles(spark, table) == want and held.seen("c", 1)
    put(captures_of(spark, "b", "d", title="again"), 1)  # the batch is known
    assert titles(spark, table) == want
    # while a base is written
    stopped_write(table, f"base-{2:012d}")
    assert titles(spark, table) == want
    held.compact()
    assert titles(spark, table) == want and 2 in held.folders("base")
    # between a base and the end of the old folders
    with monkeypatch.context() as m:
        m.setattr(jobs.ChangeTable, "clean", lambda self: (_ for _ in ()).throw(OSError("stopped")))
        for n, k in enumerate("efg"):
            try:
                put(captures_of(spark, k, "a", title=f"t{n}"), 2 + n)
            except OSError:
                pass
            want |= {k: f"t{n} {k}", "a": f"t{n} a"}
            assert titles(spark, table) == want
    put(captures_of(spark, "h"), 5)
    held.compact()
    held.compact()
    assert titles(spark, table) == want | {"h": "t h"} and held.seen("c", 5)
    assert len(held.folders("base")) <= 2 and len(held.folders("change")) <= 4


def test_a_change_still_written_stays_out_of_the_base(spark, tmp_path):
    table = str(tmp_path / "t")
    held, put = jobs.capture_table(spark, table), jobs.capture_batch(table, "c")
    put(captures_of(spark, "a"), 0)
    stopped_write(table, f"change-{2:012d}-{held.batch_name('other', 0)}")
    put(captures_of(spark, "b"), 1)
    held.compact()
    assert list(held.folders("base")) == [1] and set(titles(spark, table)) == {"a", "b"}


def written(table):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(table) for f in names if f.startswith("part-"))


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    table = str(tmp_path / "t")
    put = jobs.capture_batch(table, "c")
    put(captures_of(spark, *map(str, range(4000))), 0)
    jobs.capture_table(spark, table).compact()
    whole = written(table)
    put(captures_of(spark, *map(str, range(50)), title="new"), 1)
    assert written(table) - whole < whole / 5
    held = titles(spark, table)
    assert len(held) == 4000 and held["49"] == "new 49" and held["50"] == "t 50"


def test_the_last_of_repeated_keys_counts_and_the_first_time_stays(spark, tmp_path):
    table = str(tmp_path / "t")
    put = jobs.capture_batch(table, "c")
    rows = lambda title, *seq: spark.createDataFrame([("s", "u", "", f"{title} {k}", "", None, k) for k in seq], CAPTURED)
    put(rows("x", 2, 7, 3), 0)
    first = jobs.capture_table(spark, table).read().first()
    put(rows("y", 5, 1), 1)
    last = jobs.capture_table(spark, table).read().first()
    assert (first.titulo, last.titulo) == ("x 7", "y 5") and last.created_at == first.created_at < last.updated_at
    jobs.capture_table(spark, table).compact()
    assert jobs.capture_table(spark, table).read().first() == last


def test_lookups_read_the_numbers_row_groups_alone(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = spark.range(20_000).select(F.lit("s").alias("site"), F.col("id").cast("string").alias("url"), F.format_string("978%010d", "id").alias("isbn"), F.lit("x").alias("titulo"))
    held = jobs.capture_table(spark, table)
    held.append(rows, "c", 0)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 1000)
    held.compact()
    spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    asked = spark.createDataFrame([("9780000000007",), ("9780000019999",), ("none",)], "isbn string")
    found = held.find(asked)
    assert sorted(r.url for r in found.collect()) == ["19999", "7"]
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(isbn" in plan.toString()
    rows_read = lambda p: [p.metrics().apply("numOutputRows").value()] if p.nodeName().startswith("Scan parquet") else [n for k in range(p.children().size()) for n in rows_read(p.children().apply(k))]
    assert 0 < sum(rows_read(plan)) <= 3000
    many = held.find(rows.select("isbn").limit(6000))
    assert many.count() == 6000


def test_enrichment_reads_and_writes_the_batch_items_only(spark, tmp_path):
    table = str(tmp_path / "t")
    shape = "site string, url string, isbn string, encuadernacion string, seq long, " + ", ".join(f"{c} string" for c in merge.ENRICHED if c != "isbn")
    row = lambda site, url, isbn, **more: (site, url, isbn, "", 1, *[more.get(c, "") for c in merge.ENRICHED if c != "isbn"])
    put = jobs.capture_batch(table, "c", True)
    put(spark.createDataFrame([row("a", str(k), f"978{k:010d}") for k in range(300)], shape), 0)
    jobs.capture_table(spark, table).compact()
    put(spark.createDataFrame([row("amazon_books", "z", "9780000000005", autor="Ana")], shape), 1)
    got = {(r.site, r.url): r.autor for r in jobs.capture_table(spark, table).read().collect()}
    assert len(got) == 301 and {k for k, v in got.items() if v == "Ana"} == {("a", "5"), ("amazon_books", "z")}
    assert jobs.capture_table(spark, table).scan(list(jobs.capture_table(spark, table).open_changes()[1].values())).count() == 2


def test_seen_urls_are_marked_after_the_sink_has_them(spark, tmp_path):
    seen, got = str(tmp_path / "seen"), []
    sink = lambda df, n: got.append((n, sorted(r.url for r in df.collect())))
    urls_of = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    jobs.seen_batch(seen, "c", sink)(urls_of("a", "b", "a", None), 0)

    def broken(df, n):
        raise OSError("sink")

    with pytest.raises(OSError):
        jobs.seen_batch(seen, "c", broken)(urls_of("b", "c"), 1)
    assert {r.url for r in jobs.seen_table(spark, seen).read().collect()} == {"a", "b"}
    jobs.seen_batch(seen, "c", sink, every=2)(urls_of("b", "c"), 1)
    jobs.seen_batch(seen, "c", sink)(urls_of("b", "c", "d"), 1)  # known
    jobs.seen_batch(seen, "d", sink)(urls_of("a", "c", "d"), 0)
    assert got == [(0, ["a", "b"]), (1, ["c"]), (0, ["d"])]


def test_chunks_go_by_place(spark):
    lines = spark.createDataFrame([(n, str(n)) for n in range(1, 101)], "line_no long, raw string").repartition(3)
    got = worklist.chunk_worklist(lines, 50).groupBy("chunk").agg(F.count("*").alias("n"), F.min("line_no").alias("a")).orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(1, 50, 1), (2, 50, 51)]
    far = lines.withColumn("line_no", F.col("line_no") + F.when(F.col("line_no") > 70, 1 << 34).otherwise(0))
    assert sorted(r.n for r in worklist.chunk_worklist(far, 30).groupBy("chunk").agg(F.count("*").alias("n")).collect()) == [10, 30, 30, 30]


def test_queue_digest_and_merge_of_repeated_keys(spark):
    queue = spark.createDataFrame([("9780306406157", 9), ("9780000000002", 1)], "isbn string, pos long").repartition(4)
    assert worklist.queue_fingerprint(queue).first().queue_id == "6f0e1bd6828f"
    assert worklist.queue_fingerprint(queue.limit(0)).first().queue_id == "da39a3ee5e6b"
    dst = spark.createDataFrame([("s", "u", "old", "x"), ("s", "v", "kept", "y")], "site string, url string, isbn string, titulo string")
    src = spark.createDataFrame([("s", "u", "1", 1), ("s", "u", "3", 3), ("s", "u", "2", 2), ("s", "w", "9", 1)], "site string, url string, isbn string, seq int")
    rows = {(r.url, r.isbn, r.titulo) for r in merge.merge_tables(dst, src, order="seq").collect()}
    assert rows == {("u", "3", None), ("v", "kept", "y"), ("w", "9", None)}
    assert merge.merge_tables(dst, src.drop("seq")).count() == 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("Garc&iacute;a M&#225;rquez &amp; C&#xED;a", "García Márquez & Cía"), ("&amp;lt; &lt;b&gt; &quot;x&#39;", "&lt; <b> \"x'"),
        ("a & b &unknown; &#0; &#xD800; &; &", "a & b &unknown; \ufffd \ufffd &; &"), ("R&ampD &copy2020 &notit; &hellip;", "R&D ©2020 ¬it; …"), ("&#128218;&euro;&ntilde;&Ntilde;", "📚€ñÑ"), ("x&nbsp;&#160;y", "x y"),
    ],
)
def test_entities(spark, html, want):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(text.strip_html(F.col("h"))).first()[0] == want


def test_references_are_read_as_the_standard_library_does(spark):
    names = list(html5)
    atoms = [*"&;ax9<é", "&#", "&#x", "amp", "lt", "&copy", "&AMP", "&#150;", "&#0;", "&#xD800", "&#x110000", f"&#{'9' * 40};", "&#xFFFE;", "&#13;", "&#x1F600;", "&#00065", "&#1;", "&#x80", "&#x85;", "&NotEqualTilde;", "&ensp;", "&nbsp"]
    rng = random.Random(7)
    given = ["".join(rng.choices(atoms, k=rng.randint(1, 8))) for _ in range(2000)] + [f"&{n}" for n in names] + [f"x&{n}y" for n in names]
    df = spark.createDataFrame(list(enumerate(given)), "i int, c string").select("i", "c", text.decode_entities(F.col("c")).alias("got"))
    plain = lambda s: "".join(" " if ord(c) in text.SPACES else c for c in html.unescape(s))
    assert [(r.c, r.got) for r in df.collect() if r.got != plain(r.c)] == []


def test_white_space_and_breaks(spark):
    given = ["", " ", "a", "  a\t\tb \n c\x0b\f\rd  ", "a\u00a0 b", "<BR/>x<br   >y</P >z</h3>", "<a </p> b>c", "a \n\n\n\n b"]
    df = spark.createDataFrame(list(enumerate(given)), "i int, c string")
    rows = df.select("c", text.collapse(F.col("c")).alias("one"), text.strip_html(F.col("c")).alias("bare")).collect()
    assert [r.one for r in rows] == [re.sub(r"[ \t\n\x0b\f\r]+", " ", r.c).strip(" ") for r in rows]
    broken = [re.sub(r"(?i)<br\s*/?>|</(?:p|div|li|tr|h1|h2|h3)\s*>", "\n", r.c) for r in rows]
    assert [r.bare for r in rows] == [re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("<[^>]+>", " ", b)).strip(" ") for b in broken]


def test_too_many_keys_are_an_error(spark):
    df = spark.createDataFrame([(json.dumps({f"k{i}": 1 for i in range(6)}),)], "props string")
    assert len(standard.clean_table(df, [], "props", 6).columns) == 7
    with pytest.raises(ValueError, match="more than 5"):
        standard.clean_table(df, [], "props", 5)


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams(spark, sf, tmp_path):
    spark.conf.set("spark.sql.streaming.checkpointLocation", str(tmp_path / "cp"))
    std = book_std(spark, sf).select("site", "url", *merge.ENRICHED, "encuadernacion", F.col("updated_at"), F.col("sk").alias("seq"))
    src = str(tmp_path / "captures")
    std.filter("site in ('amazon_books', 'cuspide')").write.parquet(src)
    stream = spark.readStream.schema(std.schema).parquet(src)
    table = str(tmp_path / "table")
    jobs.stream_ingest(stream, table, str(tmp_path / "c1")).awaitTermination()
    rows_of = lambda: jobs.capture_table(spark, table).read()
    n = rows_of().count()
    assert n == spark.read.parquet(src).count()
    jobs.stream_ingest(stream, table, str(tmp_path / "c2")).awaitTermination()
    assert rows_of().count() == n
    lacking = rows_of().filter("site = 'amazon_books' and autor is not null and isbn <> ''").select("isbn").distinct()
    other = lacking.withColumns({"site": F.lit("other"), "url": F.concat(F.lit("u"), "isbn")}).limit(20).collect()
    empty = [c for c in std.columns if c not in ("isbn", "site", "url", "updated_at", "seq")]
    rows = spark.createDataFrame(other).select("site", "url", "isbn", *[F.lit("").alias(c) for c in empty], F.current_timestamp().cast(dict(std.dtypes)["updated_at"]).alias("updated_at"), F.lit(1).cast(dict(std.dtypes)["seq"]).alias("seq"))
    jobs.capture_batch(table, "more")(rows.select(*std.columns), 0)
    n += len(other)
    blank = lambda: rows_of().filter("site = 'other' and trim(autor) = ''").count()
    before = blank()
    jobs.stream_enrich(stream, table, str(tmp_path / "c3")).awaitTermination()
    assert rows_of().count() == n and blank() < before
    ev = lease_events(spark, sf)
    ev.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev"))
    drain(jobs.lease_stream(s), "leases")
    last = spark.sql("SELECT isbn, max_by(status, ts) AS status FROM leases GROUP BY isbn")
    batch = worklist.lease_state(ev, F.lit("2024-03-01").cast("timestamp"))
    a = {r.isbn: r.status for r in last.collect()}
    b = {r.isbn: r.status for r in batch.collect()}
    assert {k: v for k, v in b.items() if v in ("done", "skipped")} == {k: v for k, v in a.items() if v in ("done", "skipped")}
    raw = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    raw.write.parquet(str(tmp_path / "raw"))
    counted = jobs.stream_counts(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw")), "1 hour")
    q = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.window_start, r.event_type, r.n) for r in jobs.stream_counts(raw, "1 hour").collect()}
    assert {(r.window_start, r.event_type, r.n) for r in spark.table("counts").collect()} == want
    urls_ = spark.createDataFrame([("a",), ("b",), ("a",)], "url string")
    urls_.write.parquet(str(tmp_path / "urls"))
    drain(jobs.dedupe_seen(spark.readStream.schema("url string").parquet(str(tmp_path / "urls"))), "seen")
    assert spark.table("seen").count() == 2


def test_similar_titles_compare_only_what_can_pass(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeñ9ü ") for _ in range(rng.randint(0, 12)))
    rows = [(word(), word()) for _ in range(150)] + [(x, x[:-1] + "z") for x in (word() for _ in range(60))] + [(None, "a"), ("", ""), ("Same", "sAME")]
    pairs = spark.createDataFrame(rows, "q_title string, titulo string")
    for least in (0.5, 0.8):
        want = sorted((a, b) for a, b in rows if a and b and difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() >= least)
        assert sorted((r.q_title, r.titulo) for r in matching.similar_titles(pairs, least).collect()) == want
    share = matching.verification_share(pairs, 0.8).first()
    assert share.pairs == len(rows) and len(want) <= share.compared < len(rows) / 2


def brute_top(queries, candidates, k):
    out = set()
    for q in {t for _, t in queries}:
        a, found = set(q.split()), []
        for t in {t for _, t in candidates}:
            b = set(t.split())
            both = len(a & b)
            if both and (2 * both >= len(a | b) or both == min(len(a), len(b))):
                found.append((-both / len(a | b), min(i for i, x in candidates if x == t)))
        out |= {(q, i) for _, i in sorted(found)[:k]}
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_top_titles_equal_all_pairs(spark, k):
    rng = random.Random(k)
    make = lambda n: [(i, " ".join(dict.fromkeys(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))))) for i in range(n)]
    queries, candidates = make(60), make(250)
    classes = lambda rows: matching.title_classes(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = matching.top_title_links(classes(queries), classes(candidates), k).collect()
    assert {(r.q, r.first_id) for r in got} == brute_top(queries, candidates, k)
    assert max(r["rank"] for r in got) <= k


def test_a_word_of_all_titles_gives_k_pairs(spark):
    rows = spark.range(3001).select("id", F.concat(F.lit("the "), F.col("id").cast("string"), F.lit(" x y")).alias("t"))
    q = matching.title_classes(spark.createDataFrame([(1, "the")], "id long, t string"), "id", "t")
    got = matching.top_title_links(q, matching.title_classes(rows, "id", "t"), 10).collect()
    assert sorted(r.first_id for r in got) == list(range(10))


def test_leases_run_out_by_timer_and_survive_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    form = "event_id long, ts timestamp, isbn string, worker string, action string"

    def arrive(*rows):
        made = [(n, f"2024-01-01 {t}", *rest) for n, (t, *rest) in enumerate(rows)]
        df = spark.createDataFrame(made, form.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
        df.write.mode("append").parquet(src)
        stream = spark.readStream.schema(form).parquet(src)
        q = jobs.lease_stream(stream, 60, "10 seconds").writeStream.option("checkpointLocation", cp).trigger(availableNow=True).start(out, "parquet")
        q.awaitTermination()
        return {r.isbn: r.status for r in jobs.leases_at(spark.read.parquet(out), F.lit("2024-01-02").cast("timestamp")).collect()}, spark.read.parquet(out)

    arrive(("10:00:00", "a", "w1", "claim"), ("10:00:30", "a", "w1", "heartbeat"), ("10:00:10", "b", "w2", "claim"), ("10:00:20", "b", "w3", "claim"), ("10:00:05", "c", "w1", "done"))
    # a new start: b's lease ends by its own action, a's by its timer as time goes on
    last, rows = arrive(("10:00:40", "b", "w2", "done"), ("10:05:00", "z", "w9", "claim"))
    last, rows = arrive(("10:05:10", "b", "w2", "claim"), ("10:09:00", "a", "w4", "claim"))
    said = [(r.isbn, r.status, r.worker, str(r.ts)[11:]) for r in rows.orderBy("ts", "isbn").collect()]
    assert ("a", "open", None, "10:01:30") in said and ("z", "open", None, "10:06:00") in said
    assert [x[1:3] for x in said if x[0] == "b"] == [("in_progress", "w2"), ("done", "w2")]
    assert [x[1:3] for x in said if x[0] == "a"] == [("in_progress", "w1"), ("in_progress", "w1"), ("open", None), ("in_progress", "w4")]
    assert last["b"] == "done" and "c" not in last


def test_folding_is_by_compatibility_decomposition(spark):
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    rng = random.Random(6)
    letters = [chr(c) for c in range(1, 0x10000) if c not in text.SYLLABLES and not 0xD800 <= c < 0xE000]
    given = ["ﬁnal ﬀ", "Tiếng Việt", "ＡＢＣ１２", "e\u0301a\u0308", "½ ™ №", "Ærø ßø", "", "plain", "𝐀 and 漢字", *("".join(rng.choices(letters, k=40)) for _ in range(300)), "".join(letters[::7])]
    df = spark.createDataFrame([(t,) for t in given] + [(None,)], "t string")
    got = [r[0] for r in df.select(text.fold_accents(F.col("t"))).collect()]
    want = [plain(t) if all(ord(c) < 0x10000 for c in t) else t for t in given]
    assert got[:-1] == want and got[-1] is None
    plan = df.select(text.fold_accents(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
