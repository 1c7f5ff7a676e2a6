"""Expressions over whole tables."""

from pyspark.sql import functions as F

from shelfmerge.functions import ids, text, urls, values
from shelfmerge.operators.extract import non_digital as printed_formats
from shelfmerge.plans import duck as d
from shelfmerge.plans.base import query
from shelfmerge.plans.fixtures import QUERIES, listings, queries_table, with_book_std

PAGES = "SELECT page_id, url, html FROM pages"


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def parts(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet")


def with_queries(sql: str) -> str:
    return f"WITH queries AS ({QUERIES}) {sql}"


@query(with_queries(f"SELECT line_no, {d.isbn('raw')} AS isbn FROM queries"))
def normalize_isbn(spark, sf):
    return queries_table(spark, sf).select("line_no", ids.normalize_isbn(F.col("raw")).alias("isbn"))


@query(with_queries(f"SELECT line_no, length({d.isbn('raw')}) IN (10, 13) AS loose, regexp_matches({d.isbn('raw')}, '^([0-9]{{13}}|[0-9]{{9}}[0-9X])$') AS strict FROM queries"))
def is_isbn(spark, sf):
    return queries_table(spark, sf).select("line_no", ids.is_isbn(F.col("raw")).alias("loose"), ids.is_isbn(F.col("raw"), True).alias("strict"))


@query(with_queries(f"SELECT line_no, {d.to10('n')} AS isbn10 FROM (SELECT line_no, {d.isbn('raw')} AS n FROM queries)"))
def isbn13_to_isbn10(spark, sf):
    return queries_table(spark, sf).select("line_no", ids.isbn13_to_isbn10(F.col("raw")).alias("isbn10"))


@query(f"SELECT p_partkey, {d.to13('n')} AS isbn13 FROM (SELECT p_partkey, lpad(CAST(p_partkey * 7919 % 1000000000 AS VARCHAR), 9, '0') || 'X' AS n FROM part)")
def isbn10_to_isbn13(spark, sf):
    n = F.concat(F.lpad((F.col("p_partkey") * 7919 % 1000000000).cast("string"), 9, "0"), F.lit("X"))
    return parts(spark, sf).select("p_partkey", ids.isbn10_to_isbn13(n).alias("isbn13"))


@query(with_queries(f"""SELECT line_no, n || CASE WHEN o <> '' THEN ',' || o ELSE '' END AS candidates FROM (SELECT line_no, n,
CASE WHEN length(n) = 13 THEN {d.to10('n')} WHEN length(n) = 10 THEN {d.to13('n')} ELSE '' END AS o FROM (SELECT line_no, {d.isbn('raw')} AS n FROM queries))"""))
def isbn_candidates(spark, sf):
    return queries_table(spark, sf).select("line_no", F.array_join(ids.isbn_candidates(F.col("raw")), ",").alias("candidates"))


@query(with_book_std("SELECT site, url, regexp_extract(url, '/book/([0-9Xx]{10,13})', 1) AS book, regexp_extract(url, '^[a-z]+://[^/?#]*/book/([0-9]+)/', 1) AS segment, regexp_extract(url, '[^0-9]([0-9]{10,13})[^0-9]', 1) AS run FROM book_std"))
def isbn_from_url(spark, sf):
    u = F.col("url")
    return listings(spark, sf).select("site", "url", *[ids.isbn_from_url(u, r).alias(r) for r in ("book", "segment", "run")])


@query(f"SELECT page_id, {d.strip_html('html')} AS text FROM pages")
def strip_html(spark, sf):
    return pages(spark, sf).select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) AS text FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents")
def clean_paragraphs(spark, sf):
    return documents(spark, sf).select("doc_id", text.clean_paragraphs(F.col("text")).alias("text"))


@query(with_book_std(f"SELECT site, url, {d.titleish('titulo')} AS titulo FROM book_std"))
def titleish(spark, sf):
    return listings(spark, sf).select("site", "url", text.titleish(F.col("titulo")).alias("titulo"))


@query(with_book_std(f"SELECT site, url, {d.language('idioma')} AS idioma FROM book_std"))
def normalize_language(spark, sf):
    return listings(spark, sf).select("site", "url", text.normalize_language(F.col("idioma")).alias("idioma"))


@query(f"SELECT doc_id, {d.fold('text')} AS text FROM documents")
def fold_accents(spark, sf):
    return documents(spark, sf).select("doc_id", text.fold_accents(F.col("text")).alias("text"))


@query(f"SELECT doc_id, nullif(trim(regexp_replace({d.fold('lower(text)')}, '[^a-z0-9]+', ' ', 'g')), '') AS folded, nullif(trim(regexp_replace(lower(text), '[^a-z0-9áéíóúñü]+', ' ', 'g')), '') AS kept FROM documents")
def normalize_title(spark, sf):
    t = F.col("text")
    return documents(spark, sf).select("doc_id", text.normalize_title(t).alias("folded"), text.normalize_title(t, fold=False).alias("kept"))


@query(f"SELECT doc_id, {d.collapse('regexp_replace(' + d.fold('lower(trim(text))') + ', ' + d.q('[^a-z0-9 ]+') + ', ' + d.q('') + ', ' + d.q('g') + ')')} AS label FROM documents")
def normalize_label(spark, sf):
    return documents(spark, sf).select("doc_id", text.normalize_label(F.col("text")).alias("label"))


@query(f"SELECT page_id, {d.canonical('url')} AS url, regexp_replace(trim(url), '#.*$', '') AS with_query FROM pages")
def canonical_url(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select("page_id", urls.canonical_url(u).alias("url"), urls.canonical_url(u, keep_query=True).alias("with_query"))


LINK = "CASE page_id % 5 WHEN 0 THEN '/a/b' WHEN 1 THEN '//h.org/x' WHEN 2 THEN 'c/d.html' WHEN 3 THEN 'https://z.net/q' ELSE '' END"


@query(f"SELECT page_id, {d.resolve('url', f'({LINK})')} AS link FROM pages")
def resolve_url(spark, sf):
    return pages(spark, sf).select("page_id", urls.resolve_url(F.col("url"), F.expr(LINK)).alias("link"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(p, '^/[a-z]{2}/\d+(\.html|/)?$') THEN 'product'
WHEN regexp_matches(p, '^/[a-z]{2}/?$|/(category|categoria|libros)(/|$)') THEN 'category' ELSE 'other' END AS kind,
CASE WHEN NOT (h = 'example.com' OR ends_with(h, '.example.com')) THEN 'other' WHEN regexp_matches(p, '^/[a-z]{2}/\d+(\.html|/)?$') THEN 'product'
WHEN regexp_matches(p, '^/[a-z]{2}/?$|/(category|categoria|libros)(/|$)') THEN 'category' ELSE 'other' END AS own_kind
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)""")
def classify_url(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select("page_id", urls.classify_url(u).alias("kind"), urls.classify_url(u, "example.com").alias("own_kind"))


@query(with_book_std(f"SELECT site, url, coalesce(CASE WHEN NOT {d.blank('titulo')} THEN titulo END, CASE WHEN NOT {d.blank('autor')} THEN autor END, editorial, '') AS v FROM book_std"))
def first_filled(spark, sf):
    return listings(spark, sf).select("site", "url", text.first_filled(*map(F.col, ("titulo", "autor", "editorial"))).alias("v"))


@query("SELECT p_partkey, p_name AS once FROM part")
def dedupe_repeated(spark, sf):
    glue = F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("")
    return parts(spark, sf).select("p_partkey", text.dedupe_repeated(F.concat("p_name", glue, "p_name")).alias("once"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents")
def slugify(spark, sf):
    return documents(spark, sf).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(w)), ' ') AS sorted, len(list_distinct(w)) AS n,
array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda z: list_position(w, z[1]) = z[2] + 1), lambda z: z[1]), ' ') AS ordered
FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, replace(text, chr(10), ' ') AS text FROM documents))""")
def ordered_distinct(spark, sf):
    w = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    o = text.ordered_distinct(w)
    return documents(spark, sf).select(
        "doc_id", F.array_join(text.sorted_distinct(w), " ").alias("sorted"), F.size(o).cast("bigint").alias("n"), F.array_join(o, " ").alias("ordered")
    )


@query(with_book_std("SELECT site, url, 'https://www.amazon.com/s?k=' || isbn || '&i=stripbooks' AS search, substr(coalesce(autor, ''), 1, 7) AS head FROM book_std"))
def search_url(spark, sf):
    return listings(spark, sf).select("site", "url", ids.search_url(F.col("isbn")).alias("search"), text.head(F.col("autor"), 7).alias("head"))


@query(with_book_std(f"SELECT site, url, {d.binding('encuadernacion')} AS binding FROM book_std"))
def normalize_binding(spark, sf):
    return listings(spark, sf).select("site", "url", values.normalize_binding(F.col("encuadernacion")).alias("binding"))


@query(with_book_std("""SELECT site, url, CASE WHEN regexp_matches(b, 'tapa dura|hardcover') THEN 'tapa dura' WHEN regexp_matches(b, 'tapa blanda|paperback') THEN 'tapa blanda'
WHEN regexp_matches(b, 'r[uú]stica') THEN 'rustica' ELSE regexp_replace(b, '^encuadernación de ', '') END AS binding
FROM (SELECT *, 'encuadernación de ' || lower(trim(coalesce(encuadernacion, 'Piel'))) AS b FROM book_std)"""))
def simplify_binding(spark, sf):
    led = F.concat(F.lit("Encuadernación  de "), F.coalesce("encuadernacion", F.lit("Piel")))
    return listings(spark, sf).select("site", "url", values.simplify_binding(led).alias("binding"))


OPTION = r"^(.*?)\s*\((\d{1,2})/(\d{1,2})/(\d{4})\)$"
E = d.collapse("coalesce(encuadernacion, '')")


@query(with_book_std(f"SELECT site, url, nullif(CASE WHEN regexp_matches({E}, {d.q(OPTION)}) THEN trim({d.ext(E, OPTION, 1)}) ELSE {E} END, '') AS binding, CASE WHEN regexp_matches({E}, {d.q(OPTION)}) THEN {d.iso(d.ext(E, OPTION, 4), d.ext(E, OPTION, 2), d.ext(E, OPTION, 3))} END AS date FROM book_std"))
def split_binding_date(spark, sf):
    s = values.split_binding_date(F.col("encuadernacion"))
    return listings(spark, sf).select("site", "url", s["binding"].alias("binding"), s["date"].alias("date"))


FORMAT = "CASE p_partkey % 3 WHEN 0 THEN 'Tapa Blanda - ' || p_type WHEN 1 THEN 'tapa dura' ELSE p_name END"


@query(f"SELECT p_partkey, f AS format, trim(regexp_extract(f, '(?i)^tapa\\s+([^-]+)', 1)) AS cover, CASE WHEN contains(f, '-') THEN trim(regexp_extract(f, '^[^-]*-(.*)$', 1)) ELSE '' END AS binding FROM (SELECT p_partkey, {FORMAT} AS f FROM part)")
def split_format(spark, sf):
    return parts(spark, sf).withColumn("s", values.split_format(F.expr(FORMAT))).select("p_partkey", "s.*")


@query("SELECT p_partkey, p_type AS binding FROM part")
def binding_from_subtitle(spark, sf):
    dash = F.element_at(F.array(*map(F.lit, "–-—")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return parts(spark, sf).select("p_partkey", values.binding_from_subtitle(F.concat("p_type", F.lit(" "), dash, F.lit(" 1 mayo 2020"))).alias("binding"))


@query(with_book_std(f"SELECT site, url, {d.date('fecha_publicacion')} AS fecha, CAST(TRY_CAST({d.date('fecha_publicacion')} AS DATE) AS VARCHAR) AS valid FROM book_std"))
def parse_date_iso(spark, sf):
    iso = values.parse_date_iso(F.col("fecha_publicacion"))
    return listings(spark, sf).select("site", "url", iso.alias("fecha"), iso.try_cast("date").cast("string").alias("valid"))


MONTHS = "enero,Febrero,marzo,April,mayo,June,julio,agosto,Setiembre,octubre,November,diciembre,otro"
SAID = f"CASE pk % 3 WHEN 0 THEN CAST(day(updated_at) AS STRING) || ' de ' || split('{MONTHS}', ',')[@@] || ' de ' || CAST(year(updated_at) AS STRING) WHEN 1 THEN CAST(day(updated_at) AS STRING) || ' ' || split('{MONTHS}', ',')[@@] || ' ' || CAST(year(updated_at) AS STRING) ELSE split('{MONTHS}', ',')[@@] || ' ' || CAST(day(updated_at) AS STRING) || ', ' || CAST(year(updated_at) AS STRING) END"
AT = "CAST(pk % 13 AS INT)"


@query(with_book_std(f"SELECT site, url, {d.month_date('said')} AS fecha FROM (SELECT site, url, {SAID.replace('@@', AT + ' + 1')} AS said FROM book_std)"))
def parse_month_date(spark, sf):
    return listings(spark, sf).select("site", "url", values.parse_month_date(F.expr(SAID.replace('@@', AT))).alias("fecha"))


@query(with_book_std(f"SELECT site, url, {d.pages('paginas')} AS display, TRY_CAST(regexp_extract(paginas, '(\\d+)', 1) AS INT) AS num FROM book_std"))
def format_pages(spark, sf):
    p = values.format_pages(F.col("paginas"))
    return listings(spark, sf).select("site", "url", p["display"].alias("display"), p["num"].alias("num"))


@query(with_book_std(f"SELECT site, url, {d.dimensions('dimensiones')} AS plain, {d.dimensions('mm')} AS with_unit FROM (SELECT *, dimensiones || ' MM' AS mm FROM book_std)"))
def format_dimensions(spark, sf):
    c = F.col("dimensiones")
    return listings(spark, sf).select("site", "url", values.format_dimensions(c).alias("plain"), values.format_dimensions(F.concat(c, F.lit(" MM"))).alias("with_unit"))


CENTS = "CAST(round(p_retailprice * 100) AS BIGINT)"


@query(f"""SELECT p_partkey, CAST({CENTS} // 100 AS DECIMAL(18,2)) AS pyg, CAST({CENTS} / 100.0 AS DECIMAL(18,2)) AS eur,
CAST({CENTS} / 100.0 AS DECIMAL(18,2)) AS usd, CAST({CENTS} / 100.0 AS DECIMAL(18,2)) AS mixed FROM part""")
def parse_price(spark, sf):
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    whole, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    dotted = F.translate(F.format_number(whole, 0), ",", ".")
    return parts(spark, sf).select(
        "p_partkey",
        values.parse_price(F.concat(F.lit("₲"), dotted), "PYG").alias("pyg"),
        values.parse_price(F.concat(F.lit("$ "), dotted, F.lit(","), rest), "EUR").alias("eur"),
        values.parse_price(F.concat(F.lit("US$"), F.format_number(whole, 0), F.lit("."), rest), "USD").alias("usd"),
        values.parse_price(F.concat(dotted, F.lit(","), rest), "mixed").alias("mixed"),
    )


@query("SELECT o_orderkey, CASE WHEN c >= 100000 AND c % 100 = 0 THEN c // 100 ELSE c END AS major FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS c FROM orders)")
def minor_to_major(spark, sf):
    c = F.floor("o_totalprice").cast("bigint")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", values.minor_to_major(c).cast("bigint").alias("major"))


@query(with_book_std(f"SELECT site, url, {d.placeholder('url_portada')} AS why FROM book_std"))
def is_placeholder_cover(spark, sf):
    return listings(spark, sf).select("site", "url", values.placeholder_cover(F.col("url_portada")).alias("why"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b.jpg' ELSE 'a.jpg' END AS best, 'c.jpg' AS last FROM part")
def best_srcset(spark, sf):
    w = F.when(F.col("p_size") % 2 == 0, "600w").otherwise("200w")
    s = F.concat(F.lit("a.jpg 400w, b.jpg "), w, F.lit(", c.jpg 100w"))
    return parts(spark, sf).select("p_partkey", values.best_srcset(F.lit("s.jpg"), s).alias("best"), values.best_srcset(F.lit("s.jpg"), s, last=True).alias("last"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/x/' || p_partkey || '00000000.webp' WHEN 1 THEN '/y/pic.png' ELSE '/y/a.webp' END AS best FROM part")
def best_cover(spark, sf):
    number = F.concat(F.col("p_partkey").cast("string"), F.lit("00000000"))
    k = F.col("p_partkey") % 3
    first = F.when(k == 0, F.concat(F.lit("/x/"), number, F.lit(".webp"))).when(k == 1, "/y/mediamodifier.png").otherwise("/y/a.webp")
    second = F.when(k == 2, "/y/b.webp").otherwise("/y/pic.png")
    return parts(spark, sf).select("p_partkey", values.best_cover(F.array(first, second), number).alias("best"))


_ES, _EN = d.language_scores("text")
_LANG, _CONF = d.guess("es", "en")


@query(f"SELECT doc_id, {_LANG} AS lang, round({_CONF}, 6) AS conf FROM (SELECT doc_id, {_ES} AS es, {_EN} AS en FROM documents)")
def guess_language(spark, sf):
    g = values.guess_language(F.col("text"))
    return documents(spark, sf).select("doc_id", g.alias("g")).select("doc_id", "g.lang", F.round("g.conf", 6).alias("conf"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'in_stock' WHEN event_type = 'click' THEN 'out_of_stock'
WHEN event_type = 'purchase' THEN CASE WHEN value > 100 THEN 'in_stock' ELSE 'out_of_stock' END WHEN event_type = 'error' THEN 'out_of_stock' END AS stock FROM events""")
def availability(spark, sf):
    t = F.col("event_type")
    schema = F.when(t == "view", "http://schema.org/InStock").when(t == "click", "OutOfStock")
    variants = F.when(t == "purchase", F.array(F.lit(False), F.col("value") > 100)).otherwise(F.array().cast("array<boolean>"))
    words = F.when(t == "error", "AGOTADO").otherwise("?")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", values.availability(schema, variants, words).alias("stock"))


@query("SELECT page_id, regexp_matches(lower(html), 'robot check|enter the characters you see below|automated access|captcha|access denied') AS blocked FROM pages")
def is_blocked_page(spark, sf):
    return pages(spark, sf).select("page_id", values.is_blocked_page(F.col("html")).alias("blocked"))


@query("SELECT p_partkey, 'Rústica' AS printed FROM part")
def non_digital(spark, sf):
    formats = F.transform(F.array(F.lit("Kindle"), F.lit("Rústica"), F.lit("Audiolibro digital")), lambda n: F.struct(n.alias("name")))
    return parts(spark, sf).select("p_partkey", F.array_join(F.transform(printed_formats(formats), lambda f: f["name"]), ",").alias("printed"))


@query(PAGES)
def read_pages(spark, sf):
    from shelfmerge.sources.readers import read_pages as read

    return read(spark, f"{sf}/pages.parquet")


