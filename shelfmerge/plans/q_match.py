"""Matching and extraction."""

import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmerge.operators import extract, matching, site_specs
from shelfmerge.plans import duck as d
from shelfmerge.plans.base import query
from shelfmerge.plans.fixtures import listings, derived, table_of, with_book_std
from shelfmerge.sources import readers

#: Every part asks by a number, which a quarter of them has wrong, and by its name; every part is offered under three kinds of titles.
ASKED = """SELECT p_partkey AS query_id, CASE WHEN p_partkey % 4 = 0 THEN '979' ELSE '978' END || lpad(CAST(p_partkey AS STRING), 10, '0') AS q_isbn, p_name AS q_title FROM part"""
OFFERED = """SELECT p_partkey AS cand_id, '978' || lpad(CAST(p_partkey AS STRING), 10, '0') AS isbn,
CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) || ': ' || p_brand ELSE p_type || ' ' || p_name END AS titulo FROM part"""


def asked(spark, sf):
    return derived(spark, sf, ASKED, "part")


def offered(spark, sf):
    return derived(spark, sf, OFFERED, "part")


def pairs(spark, sf):
    """Each query's pairs by number and by title, numbered in an order of their own."""
    made = lambda: matching.match_pairs(asked(spark, sf), offered(spark, sf)).drop("isbn_match", "titulo_match_estricto", "titulo_match_relajado")
    order = Window.partitionBy("query_id").orderBy((F.col("query_id") * 31 + F.col("cand_id") * 17) % 1009, "cand_id")
    return table_of(spark, sf, "match_pairs", made).withColumn("position", F.row_number().over(order).cast("bigint"))


def norm(c):
    return f"nullif(trim(regexp_replace({d.fold(f'lower({c})')}, '[^a-z0-9]+', ' ', 'g')), '')"


#: The same by brute force over the distinct titles.
PAIRS = f"""asked AS ({ASKED}), offered AS ({OFFERED}),
qt AS (SELECT DISTINCT q_title, {norm("q_title")} AS qn FROM asked), ct AS (SELECT {norm("titulo")} AS cn, min(cand_id) AS cand_id FROM offered GROUP BY ALL),
tl AS (SELECT q_title, cand_id, list_distinct(string_split(qn, ' ')) AS a, list_distinct(string_split(cn, ' ')) AS b, len(list_intersect(a, b)) AS n_both FROM qt, ct),
ids AS (SELECT query_id, cand_id FROM asked JOIN offered ON q_isbn = isbn
 UNION SELECT query_id, cand_id FROM asked JOIN tl USING (q_title) WHERE n_both * 2 >= len(a) + len(b) - n_both OR n_both = least(len(a), len(b))),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (query_id * 31 + cand_id * 17) % 1009, cand_id) AS position FROM ids JOIN asked USING (query_id) JOIN offered USING (cand_id))"""
FLAGS = f"""{PAIRS}, n AS (SELECT *, {norm("q_title")} AS a, {norm("titulo")} AS b FROM p),
m AS (SELECT *, q_isbn = isbn AS isbn_match, coalesce(a = b, false) AS strict, coalesce(contains(b, a) OR contains(a, b), false) AND NOT coalesce(a = b, false) AS relaxed FROM n),
s AS (SELECT *, CASE WHEN isbn_match THEN 100.0 ELSE 0 END + CASE WHEN strict THEN 20.0 ELSE 0 END + CASE WHEN relaxed THEN 5.0 ELSE 0 END AS score FROM m)"""


@query(f"WITH {FLAGS} SELECT query_id, cand_id, isbn_match, strict AS titulo_match_estricto, relaxed AS titulo_match_relajado FROM s")
def match_flags(spark, sf):
    return matching.match_flags(pairs(spark, sf)).select("query_id", "cand_id", "isbn_match", "titulo_match_estricto", "titulo_match_relajado")


@query(f"WITH {FLAGS} SELECT query_id, cand_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS r FROM s) WHERE r = 1")
def best_match(spark, sf):
    scored = matching.match_flags(pairs(spark, sf)).withColumn("score", matching.match_score())
    return matching.best_match(scored).select("query_id", "cand_id", "score")


@query(f"""WITH {FLAGS} SELECT query_id, cand_id, CASE WHEN score = 0 THEN 'mejor candidato por similitud' ELSE concat_ws(', ', CASE WHEN isbn_match THEN 'ISBN exacto' END,
CASE WHEN strict THEN 'título exacto' END, CASE WHEN relaxed THEN 'título relajado' END) END AS reason FROM s""")
def match_reason(spark, sf):
    return matching.match_flags(pairs(spark, sf)).select("query_id", "cand_id", matching.match_reason().alias("reason"))


LIKENESS = "round(1 - levenshtein(lower(q_title), lower(titulo)) / greatest(length(q_title), length(titulo)), 6)"


#: The links of all candidates: the smallest cand_id stands for those of one title, or of one number and title, and each of them is a row.
LINKS = PAIRS[: PAIRS.index("ct AS")] + f"""ct AS (SELECT {norm("titulo")} AS cn, min(cand_id) AS cand_id FROM offered GROUP BY titulo),
{PAIRS[PAIRS.index("tl AS") : PAIRS.index("ids AS")]}ids AS (SELECT query_id, min(cand_id) AS cand_id, 'number' AS "by" FROM asked JOIN offered ON q_isbn = isbn GROUP BY query_id, isbn, titulo
 UNION ALL SELECT query_id, cand_id, 'title' FROM asked JOIN tl USING (q_title) WHERE n_both * 2 >= len(a) + len(b) - n_both OR n_both = least(len(a), len(b))),
p AS (SELECT * FROM ids JOIN asked USING (query_id) JOIN offered USING (cand_id))"""


@query(f"""WITH {FLAGS.replace(PAIRS, LINKS)} SELECT query_id, cand_id, "by", isbn_match, strict AS titulo_match_estricto, relaxed AS titulo_match_relajado, {LIKENESS} AS similitud_titulo, NULL AS offer_id, NULL AS title_id FROM s
UNION ALL SELECT NULL, cand_id, 'member', NULL, NULL, NULL, NULL, min(cand_id) OVER (PARTITION BY isbn, titulo), min(cand_id) OVER (PARTITION BY titulo) FROM offered""")
def match_candidates(spark, sf):
    """Links with the first candidate of each class, and each candidate with its classes."""
    found = matching.match_links(asked(spark, sf), offered(spark, sf), similarity=matching.edit_similarity)
    flags = ["isbn_match", "titulo_match_estricto", "titulo_match_relajado"]
    return found.select("query_id", "cand_id", "by", *flags, F.round("similitud_titulo", 6).alias("similitud_titulo"), "offer_id", "title_id")


K = 5


@query(f"""WITH {PAIRS}, top AS (SELECT q_title, cand_id FROM (SELECT q_title, cand_id, row_number() OVER (PARTITION BY q_title ORDER BY n_both / CAST(len(a) + len(b) - n_both AS DOUBLE) DESC, cand_id) AS r
FROM tl WHERE n_both * 2 >= len(a) + len(b) - n_both OR n_both = least(len(a), len(b))) WHERE r <= {K})
SELECT query_id, cand_id FROM asked JOIN top USING (q_title) UNION SELECT query_id, cand_id FROM asked JOIN offered ON q_isbn = isbn""")
def match_top_pairs(spark, sf):
    """Each title's five best candidates, and those of its number: no more pairs than that for each query."""
    return matching.match_pairs(asked(spark, sf), offered(spark, sf), k=K).select("query_id", "cand_id")


#: Titles by single words: each part's first word asks among all names, where every word is in a great many.
SINGLE = "SELECT p_partkey AS query_id, '' AS q_isbn, split_part(p_name, ' ', 1) AS q_title FROM part"


@query(f"""WITH q AS (SELECT DISTINCT {norm("q_title")} AS a FROM ({SINGLE})), c AS (SELECT {norm("p_name")} AS b, min(p_partkey) AS cand_id FROM part GROUP BY ALL),
l AS (SELECT a, cand_id, list_distinct(string_split(b, ' ')) AS w FROM q, c), s AS (SELECT a, cand_id, row_number() OVER (PARTITION BY a ORDER BY 1.0 / len(w) DESC, cand_id) AS rank FROM l WHERE list_contains(w, a))
SELECT a AS title, cand_id, CAST(rank AS INT) AS rank FROM s WHERE rank <= {K}""")
def top_titles_of_a_word(spark, sf):
    q = matching.title_classes(derived(spark, sf, SINGLE, "part"), "query_id", "q_title")
    c = matching.title_classes(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name"), "p_partkey", "p_name")
    return matching.top_title_links(q, c, K).select(F.col("q").alias("title"), F.col("first_id").alias("cand_id"), "rank")


def common(a, b):
    of = lambda t, x: f"(length({t}) - length(replace({t}, '{x}', '')))"
    each = " + ".join(f"least({of(a, x)}, {of(b, x)})" for x in matching.COUNTED)
    rest = lambda t: f"(length({t}) - ({' + '.join(of(t, x) for x in matching.COUNTED)}))"
    return f"({each} + least({rest(a)}, {rest(b)}))"


BOUND = f"2.0 * {common('lower(q_title)', 'lower(titulo)')} / (length(q_title) + length(titulo))"


@query(f"WITH {PAIRS} SELECT query_id, cand_id, round({BOUND}, 6) AS bound FROM p")
def ratio_bound(spark, sf):
    found = matching.bounded_pairs(pairs(spark, sf))
    return found.select("query_id", "cand_id", F.round("_bound", 6).alias("bound"))


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, count(*) FILTER (WHERE {BOUND} >= 0.8 - 1e-9) AS compared FROM p")
def verification_share(spark, sf):
    return matching.verification_share(pairs(spark, sf), 0.8)


@query()
def title_similarity(spark, sf):
    """The ratio that SQL lacks; tests hold it against its definition."""
    s = matching.title_similarity(F.lower(F.col("q_title")), F.lower(F.col("titulo")))
    return pairs(spark, sf).select("query_id", "cand_id", F.round(s, 6).alias("similarity"))


@query(f"""WITH {PAIRS} SELECT query_id, cand_id, round(1 - levenshtein(q_title, titulo) / greatest(length(q_title), length(titulo)), 6) AS similarity FROM p""")
def edit_similarity(spark, sf):
    s = matching.edit_similarity(F.col("q_title"), F.col("titulo"))
    return pairs(spark, sf).select("query_id", "cand_id", F.round(s, 6).alias("similarity"))


@query(f"""WITH {PAIRS}, k AS (SELECT query_id, cand_id, position, query_id % 2 = 0 AS num, CASE WHEN query_id % 2 = 0 THEN CASE WHEN isbn = q_isbn THEN 10.0 ELSE 0.0 END
ELSE 1 - levenshtein(lower(q_title), lower(titulo)) / greatest(length(q_title), length(titulo)) END AS score FROM p)
SELECT query_id, cand_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM k WHERE NOT num OR score >= 8) WHERE rank <= 3""")
def topk_per_query(spark, sf):
    p = pairs(spark, sf).withColumn("query", F.when(F.col("query_id") % 2 == 0, F.col("q_isbn")).otherwise(F.col("q_title")))
    scored = p.withColumn("score", matching.text_score(F.col("query"), F.col("titulo"), F.col("isbn")))
    return matching.topk_per_query(scored, 3).select("query_id", "cand_id", "rank", F.round("score", 6).alias("score"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS matched_by, CASE page_id % 3 WHEN 0 THEN 'by url' WHEN 1 THEN 'by number' ELSE 'first' END AS name FROM pages""")
def join_by_priority(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.col("page_id").cast("string").alias("isbn"))
    k = F.col("page_id") % 3
    item = lambda pos, url, ean, name: pages.select("page_id", F.lit(pos).alias("position"), url.alias("item_url"), ean.alias("ean"), F.lit(name).alias("name"))
    none = F.lit("-")
    items = (
        item(1, none, none, "first")
        .union(item(3, F.when(k == 0, F.col("url")).otherwise("-"), none, "by url"))
        .union(item(2, none, F.when(k < 2, F.col("isbn")).otherwise("-"), "by number"))
    )
    return matching.join_by_priority(pages, items).select("page_id", "matched_by", "name")


COUNT = " + ".join(f"CASE WHEN {d.blank(c)} THEN 0 ELSE 1 END" for c in matching.SCORED)
MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN {d.blank(c)} THEN '{c}' END" for c in matching.SCORED) + ")"


@query(with_book_std(f"""SELECT isbn AS asked, site, url, CAST(filled AS INT) AS filled, n AS n_rows, {MISSING} AS missing FROM (SELECT *, count(*) OVER (PARTITION BY isbn) AS n,
row_number() OVER (PARTITION BY isbn ORDER BY filled DESC, CASE WHEN site = 'amazon_books' THEN 0 ELSE 1 END, updated_at DESC, site, url) AS r FROM (SELECT *, {COUNT} AS filled FROM book_std WHERE isbn <> '')) WHERE r = 1"""))
def lookup(spark, sf):
    std = listings(spark, sf)
    return matching.lookup(std, std.filter("isbn <> ''").select("isbn"))


# ---- extraction


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


H1 = "(?is)<h1[^>]*>(.*?)</h1>"
TITLE = "(?is)<title[^>]*>(.*?)</title>"


@query(f"SELECT page_id, url, coalesce(nullif({d.strip_html(d.ext('html', H1, 1))}, ''), nullif({d.strip_html(d.ext('html', TITLE, 1))}, ''), '') AS titulo FROM pages")
def extract_fields(spark, sf):
    return extract.extract_fields(pages(spark, sf)).select("page_id", "url", "titulo")


#: Product pages as five sites write them, from the listings' own values.
SITE_PAGES = {
    "el_lector": "<h1 class='x product_title'>{t}</h1><div class='product-brand'><b>Autor:</b> x Autor: <a href='/a'>{a}</a></div><span class='sku'>{i}</span><table class='table'><tr><th>Editorial</th> <td>{e}</td></tr></table>",
    "contrapunto": "<h1>{t}</h1><ul><li>Autor: <a>{a}</a></li><li> Editor: {e} </li></ul><dl><dt>ISBN</dt><dd class='isbn'>{i}</dd></dl>",
    "yenny": "<h1 class='h1 js-product-name'>{t}</h1><p class='text-accent mb-3'>{a}</p><div class='std'><div><strong>ISBN:</strong> {i}</div><div><strong>Editorial:</strong> {e}</div></div>",
    "bookpeople": "<h1 class='product-details__title'>{t}</h1><a href='/search?type=author&x'>{a}</a><div class='f--variation_field_publisher__11'><div class='product-details__label'>Publisher:</div>{e}</div><div class='f--variation_field_isbn_13__11'><div class='product-details__label'>ISBN:</div>{i}</div>",
    "cuspide": "<div><h1 id='t-p-f'>{t}</h1><div><a href='/libros-ebooks/x'>{a}</a><a href='/libros-ebooks/y'>Ver más</a></div></div><div class='ficha-tecnica'><p data-campo='ISBN'><b>ISBN:</b> {i}</p><p data-campo='Editorial'><b>Editorial:</b><i>{e}</i> <i class='tooltip'>?</i></p></div>",
    "casa_del_libro": "<h1 id='t-p-f'>{t}</h1><div class='ficha-tecnica' id='contributors'><ul><li data-campo='ISBN'>ISBN: {i}<li data-campo='Editorial'>Editorial: {e}</ul></div>",
    "amazon_books": "<span id='productTitle' class='a'> {t} </span><span class='author notFaded'><a href='/x'>{a}</a></span><li><span class='a-text-bold'>Editorial &rlm; : </span> <span>{e}</span></li><li><span class='a-text-bold'>ISBN-13 : </span><span>{i}</span></li>",
}
SPEC_OF = {"contrapunto": "riverside"}


@query(with_book_std(f"""SELECT site, url, {d.collapse("coalesce(titulo, '')")} AS titulo, CASE WHEN site = 'casa_del_libro' THEN '' ELSE coalesce(autor, '') END AS autor, isbn,
CASE WHEN site = 'el_lector' THEN {d.initcap("coalesce(editorial, '')")} ELSE coalesce(editorial, '') END AS editorial FROM book_std
WHERE site IN ({", ".join(f"'{s}'" for s in SITE_PAGES)})"""))
def extract_site_fields(spark, sf):
    std = listings(spark, sf)
    shown = {k: F.coalesce(c, F.lit("")) for k, c in {"t": "titulo", "a": "autor", "i": "isbn", "e": "editorial"}.items()}
    out = []
    for site, form in SITE_PAGES.items():
        parts = [shown[x[1]] if x in ("{t}", "{a}", "{i}", "{e}") else F.lit(x) for x in re.split(r"(\{[taie]\})", form) if x]
        page = std.filter(F.col("site") == site).select(F.col("pk").alias("page_id"), "url", F.concat(*parts).alias("html"))
        found = site_specs.extract_fields(page, site_specs.spec_of(SPEC_OF.get(site, site)), ("titulo", "autor", "isbn", "editorial"))
        author = F.col("autor") if "autor" in found.columns else F.lit("")
        out.append(found.select(F.lit(site).alias("site"), "url", "titulo", author.alias("autor"), "isbn", "editorial"))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(f"""SELECT page_id, min(k) - 1 AS first_at, link FROM (SELECT page_id, k, {d.canonical(d.resolve("url", "href"))} AS link FROM (SELECT page_id, url, unnest(l) AS href, unnest(range(1, len(l) + 1)) AS k
FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*href=["'']([^"'']+)', 1) AS l FROM pages))) GROUP BY page_id, link""")
def extract_links(spark, sf):
    rows = pages(spark, sf)
    links = extract.extract_links(rows).drop("position")
    cards = extract.extract_cards(rows).select("page_id", "link", "position")
    return links.join(cards, ["page_id", "link"]).select("page_id", F.col("position").cast("bigint").alias("first_at"), "link")


@query(f"""SELECT page_id, link, arg_min(titulo, k) AS titulo, CAST(min(k) AS INT) - 1 AS position FROM (SELECT page_id, k, {d.canonical(d.resolve("url", "href"))} AS link, {d.strip_html("t")} AS titulo FROM (
SELECT page_id, url, k, regexp_extract(c, '(?is)<a[^>]+href=["'']([^"'']*)', 1) AS href, regexp_extract(c, '(?is)<a[^>]*>(.*?)</a>', 1) AS t FROM (SELECT page_id, url, unnest(l) AS c, unnest(range(1, len(l) + 1)) AS k
FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS l FROM pages)))) GROUP BY page_id, link""")
def extract_cards(spark, sf):
    return extract.extract_cards(pages(spark, sf))


@query("SELECT page_id, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INT), CAST(ceil((page_id % 90) / 20) AS INT), 1) AS last_page FROM pages")
def max_page(spark, sf):
    return extract.max_page(pages(spark, sf), "url", F.col("page_id") % 90, 20)


def part_pages(spark, sf, html):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("page_id"), F.lit("https://x.org/a").alias("url"), html.alias("html"))


def glue(*parts):
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts])


@query("SELECT p_partkey AS page_id, p_name AS titulo, p_brand AS editorial, CAST(p_size AS VARCHAR) AS paginas, p_type AS tipo FROM part")
def extract_kv(spark, sf):
    html = glue("<table><tr><th>Título:</th><td>", "@p_name", "</td></tr></table><dl><dt>Editorial</dt><dd>", "@p_brand", "</dd></dl><ul><li><b>Páginas:</b> ", "@p_size", "</li></ul><p data-campo='tipo'>", "@p_type", "</p>")
    rows = extract.extract_kv(part_pages(spark, sf, html))
    return rows.select("page_id", *[F.try_element_at("sheet", F.lit(k)).alias(k) for k in ("titulo", "editorial", "paginas", "tipo")])


@query("SELECT p_partkey AS page_id, 'Book' AS type, p_name AS name, 'A ' || p_brand || ', B' AS author, p_type AS publisher, CAST(p_size AS VARCHAR) AS isbn FROM part")
def extract_jsonld(spark, sf):
    html = glue('<script type="application/ld+json">{"@graph":[{"@type":"WebPage","name":"no"},{"@type":"Book","name":"', "@p_name", '","author":[{"name":"A ', "@p_brand", '"},"B"],"publisher":{"name":"', "@p_type", '"},"isbn":"', "@p_size", '"}]}</script>')
    return extract.extract_jsonld(part_pages(spark, sf, html))


@query("SELECT p_partkey AS page_id, p_partkey AS product_id, p_name AS titulo, 'a,b' AS tags, CAST(CASE WHEN p_size % 2 = 0 THEN 20.5 ELSE 10 END AS DECIMAL(18,2)) AS precio, CASE WHEN p_size % 2 = 0 THEN 's2' ELSE 's1' END AS isbn, p_size % 2 = 0 AS available FROM part")
def extract_product_json(spark, sf):
    second = F.when(F.col("p_size") % 2 == 0, "true").otherwise("false")
    json = F.concat(glue('{"id":', "@p_partkey", ',"title":"', "@p_name", '","tags":["a","b","a"],"variants":[{"id":1,"sku":"s1","price":"10.00","available":false},{"id":2,"sku":"s2","price":"20.50","available":'), second, F.lit("}]}"))
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("page_id"), json.alias("json"))
    return extract.extract_product_json(rows).withColumn("tags", F.array_join("tags", ","))


@query("SELECT p_partkey AS page_id, p_name || ' ' || p_type || ' end' AS block FROM part")
def extract_block(spark, sf):
    html = glue("<div class='x synopsis'>short</div><div id='synopsis'>", "@p_name", "<div><p>", "@p_type", "</p></div>end</div><div>other</div>")
    return extract.extract_block(part_pages(spark, sf, html), "synopsis")


@query("SELECT p_partkey AS page_id, 'Home>' || p_brand || '>' || p_type AS path, p_type AS last FROM part")
def extract_breadcrumb(spark, sf):
    html = glue("<nav class='breadcrumb'><a href='/'>Home</a><a>", "@p_brand", "</a> <a>", "@p_type", "</a></nav><a>no</a>")
    return extract.extract_breadcrumb(part_pages(spark, sf, html)).withColumn("path", F.array_join("path", ">"))


@query("SELECT p_partkey AS page_id, p_brand || '/' || p_name || '/' || CAST(p_size AS VARCHAR) || '.jpg|Ana//' AS authors FROM part")
def extract_contributors(spark, sf):
    html = glue("<div class='autor'><h3>", "@p_brand", "</h3><img src='", "@p_size", ".jpg'><p>", "@p_name", "</p></div><div class='autor'><h3>Ana</h3></div>")
    rows = extract.extract_contributors(part_pages(spark, sf, html))
    one = F.transform("authors", lambda a: F.concat_ws("/", a["nombre"], a["bio"], a["foto"]))
    return rows.select("page_id", F.array_join(one, "|").alias("authors"))


@query("SELECT p_partkey AS page_id, 3 AS n, CASE WHEN p_size % 2 = 0 THEN 'Hardcover' ELSE p_type END AS chosen FROM part")
def extract_formats(spark, sf):
    mark = F.when(F.col("p_size") % 2 == 0, " selected").otherwise("")
    html = F.concat(glue("<select><option selected>Kindle</option><option>", "@p_type", "</option><option"), mark, F.lit(">Hardcover</option></select>"))
    rows = extract.extract_formats(part_pages(spark, sf, html))
    return rows.select("page_id", F.size("formats").alias("n"), "chosen")


@query("SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand WHEN 2 THEN p_name || chr(10) || p_brand ELSE 'plain ' || p_name END AS html FROM part")
def unwrap_json_html(spark, sf):
    k = F.col("p_partkey") % 4
    json = (
        F.when(k == 0, glue('{"html":"', "@p_name", '"}'))
        .when(k == 1, glue('{"data":{"html":"', "@p_brand", '"}}'))
        .when(k == 2, glue('{"results":[{"html":"', "@p_name", '"},{"content":"', "@p_brand", '"}]}'))
        .otherwise(glue("plain ", "@p_name"))
    )
    return extract.unwrap_json_html(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("page_id"), json.alias("json")))


@query("SELECT p_partkey AS page_id, 'product' AS kind, '/p/' || p_name AS link FROM part UNION ALL SELECT p_partkey, 'category', '/c/' || p_brand FROM part UNION ALL SELECT p_partkey, 'pager', '?page=2' FROM part")
def links_from_category_json(spark, sf):
    json = glue('{"content":{"products":[{"x":{"link":{"src":"/p/', "@p_name", '"}}}]},"categories":{"a":[{"href":"/c/', "@p_brand", '"}]},"pagination":{"next":{"url":"?page=2"}}}')
    rows = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("page_id"), json.alias("json"))
    return readers.links_from_category_json(rows)
