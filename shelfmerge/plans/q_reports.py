"""Golden table and reports."""

from pyspark.sql import functions as F

from shelfmerge.functions.text import is_blank
from shelfmerge.operators import gold, reports
from shelfmerge.operators.texts import with_texts
from shelfmerge.plans.base import query
from shelfmerge.plans.duck import blank
from shelfmerge.plans.fixtures import listings, texts, with_book_std
from shelfmerge.sources import writers

SCORE = " + ".join(f"CASE WHEN {blank(f)} THEN 0 ELSE {w} END" for f, w in gold.WEIGHTS.items())
BEST = f"""best AS (SELECT * FROM (SELECT *, {SCORE} AS score FROM book_std WHERE NOT {blank("isbn")})
QUALIFY row_number() OVER (PARTITION BY isbn, site ORDER BY score DESC, updated_at DESC, url) = 1)"""


def with_best(sql: str) -> str:
    return with_book_std("SELECT 1").replace(" SELECT 1", f", {BEST} {sql}")


MASTER_FIELDS = ", ".join(
    "coalesce("
    + ", ".join(
        [f"max(CASE WHEN site = '{s}' AND NOT {blank(f)} THEN {f} END)" for s in sites] + [f"max(CASE WHEN NOT {blank(f)} THEN {f} END)"]
    )
    + f") AS {f.upper()}"
    for f, sites in gold.PRIORITY.items()
)


@query(with_book_std(f"SELECT site, url, {SCORE} AS score FROM book_std"))
def completeness_score(spark, sf):
    return listings(spark, sf).select("site", "url", gold.completeness_score().alias("score"))


@query(with_best("SELECT isbn, site, url, score FROM best"))
def listing_best(spark, sf):
    return gold.listing_best(listings(spark, sf)).select("isbn", "site", "url", "score")


@query(with_best(f"SELECT isbn AS ISBN, {MASTER_FIELDS}, 'master' AS SITE FROM best GROUP BY isbn"))
def master(spark, sf):
    return with_texts(gold.master(gold.listing_best(listings(spark, sf))), texts(spark, sf), "SINOPSIS")


@query(with_book_std("SELECT " + ", ".join(f'{c} AS "{n}"' for n, c in reports.EXPORT.items()) + " FROM book_std"))
def scan_all(spark, sf):
    return reports.scan_all(listings(spark, sf), texts(spark, sf))


@query(with_book_std(f"""SELECT isbn, titulo, site, url, CAST(updated_at AS VARCHAR) AS updated_at FROM book_std
WHERE {blank("encuadernacion")} ORDER BY book_std.updated_at DESC, site, url LIMIT 100"""))
def missing_rows(spark, sf):
    return reports.missing_rows(listings(spark, sf), "encuadernacion").withColumn("updated_at", F.col("updated_at").cast("string"))


COUNTED = ["isbn", "titulo", "autor", "sinopsis"]


@query(with_book_std("SELECT " + ", ".join(f"count(*) FILTER (WHERE {blank(c)}) AS missing_{c}" for c in COUNTED) + " FROM book_std"))
def missing_count(spark, sf):
    return reports.missing_count(listings(spark, sf), *COUNTED)


@query(with_book_std("""SELECT isbn, site, url, encuadernacion, CAST(updated_at AS VARCHAR) AS updated_at FROM book_std
WHERE site = 'bookpeople' ORDER BY book_std.updated_at DESC, url LIMIT 5"""))
def site_rows(spark, sf):
    return reports.site_rows(listings(spark, sf), "bookpeople").withColumn("updated_at", F.col("updated_at").cast("string"))


SAMPLE = ["9780000000101", "9780000000118", "9780000000057"]


@query(with_book_std(f"SELECT isbn, site, url, encuadernacion FROM book_std WHERE isbn IN ({', '.join(repr(s) for s in SAMPLE)})"))
def by_isbns(spark, sf):
    return reports.by_isbns(listings(spark, sf), SAMPLE)


@query(with_book_std(f"""SELECT isbn, site, encuadernacion, isbn || '|' || titulo AS raw_json, CAST(updated_at AS VARCHAR) AS updated_at
FROM book_std WHERE isbn = '{SAMPLE[2]}' AND site = 'yenny' ORDER BY book_std.updated_at DESC, url LIMIT 1"""))
def lineage_of(spark, sf):
    std = listings(spark, sf).withColumn("raw_json", F.concat("isbn", F.lit("|"), "titulo"))
    return reports.lineage_of(std, SAMPLE[2], "yenny").withColumn("updated_at", F.col("updated_at").cast("string"))


LACKING = " OR ".join(blank(c) for c in reports.WANTED)


@query(with_book_std(f"SELECT isbn, site, url FROM book_std WHERE NOT {blank('isbn')} AND site <> 'amazon_books' AND ({LACKING})"))
def needs_enrichment(spark, sf):
    return reports.needs_enrichment(listings(spark, sf)).select("isbn", "site", "url")


@query(with_book_std(f"SELECT site, url, isbn FROM book_std WHERE NOT {blank('isbn')}"))
def only_with_isbn(spark, sf):
    return reports.only_with_isbn(listings(spark, sf)).select("site", "url", "isbn")


TYPO = "(lower(replace(replace(trim(encuadernacion), chr(160), ''), chr(9), '')) IN ('rstica', 'rustica') OR lower(encuadernacion) LIKE '%rstica%' OR lower(encuadernacion) LIKE '%rustica%')"


@query(with_book_std(f"SELECT site, url, encuadernacion FROM book_std WHERE {TYPO}"))
def typo_candidates(spark, sf):
    return reports.typo_candidates(listings(spark, sf)).select("site", "url", "encuadernacion")


@query(with_book_std(f"""SELECT site, encuadernacion, hex(encode(encuadernacion)) AS hex, length(encuadernacion) AS len, count(*) AS c
FROM book_std WHERE {TYPO} GROUP BY ALL"""))
def typo_profile(spark, sf):
    return reports.typo_profile(listings(spark, sf))


@query("SELECT doc_id, hex(encode(text)) AS hex, length(text) AS len FROM documents")
def byte_profile(spark, sf):
    from shelfmerge.functions.text import byte_profile as profile

    code, size = profile(F.col("text"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", code.alias("hex"), size.alias("len"))


@query(with_book_std("SELECT site, count(*) AS c FROM book_std GROUP BY site"))
def counts_by_site(spark, sf):
    return reports.counts_by_site(listings(spark, sf))


@query(with_book_std("SELECT count(*) AS total FROM book_std"))
def count_total(spark, sf):
    return reports.run_named_query(spark, listings(spark, sf), "count_total")


@query(with_book_std("SELECT site, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {blank(c)}) AS missing_{c}" for c in reports.FIELDS) + " FROM book_std GROUP BY site"))
def missing_by_site(spark, sf):
    return reports.missing_by_site(listings(spark, sf))


@query(with_book_std(reports.NAMED["dup_isbn"]))
def dupes_by_isbn(spark, sf):
    return reports.dupes(listings(spark, sf), "isbn")


@query(with_book_std(reports.NAMED["dup_isbn_by_site"]))
def dupes_by_site_isbn(spark, sf):
    return reports.dupes(listings(spark, sf), "site", "isbn")


@query(with_book_std("""SELECT isbn, titulo, site, url, encuadernacion, CAST(updated_at AS VARCHAR) AS updated_at
FROM book_std ORDER BY book_std.updated_at DESC, site, url LIMIT 30"""))
def latest(spark, sf):
    return reports.latest(listings(spark, sf)).withColumn("updated_at", F.col("updated_at").cast("string"))


@query(with_book_std("SELECT count(*) AS n FROM book_std WHERE site = 'yenny'"))
def run_named_query(spark, sf):
    return reports.run_named_query(spark, listings(spark, sf), "site_count", ["yenny"])


EXPORTED = ", ".join(f'{c} AS "{n}"' for n, c in reports.EXPORT.items())


@query(with_book_std(f"SELECT {EXPORTED} FROM book_std WHERE isbn IN (SELECT isbn FROM book_std WHERE pk % 9 = 4)"))
def export_by_isbn(spark, sf):
    std = listings(spark, sf)
    return writers.export_by_isbn(std, std.filter("pk % 9 = 4").select("isbn"), texts(spark, sf))


@query(with_book_std(f"SELECT {', '.join(reports.EXPORT.values())}, h, pk, sk, updated_at IS NULL AS undated FROM book_std"))
def write_standard(spark, sf):
    std = listings(spark, sf).withColumn("undated", F.col("updated_at").isNull()).drop("updated_at")
    return with_texts(writers.standard_columns(std, full=True), texts(spark, sf), "sinopsis")


@query(with_best(f"SELECT isbn AS ISBN, count(*) AS sites, count(*) FILTER (WHERE {blank('titulo')}) AS untitled FROM best GROUP BY isbn"))
def sites_per_item(spark, sf):
    best = gold.listing_best(listings(spark, sf))
    return best.groupBy(F.col("isbn").alias("ISBN")).agg(F.count("*").alias("sites"), F.count_if(is_blank(F.col("titulo"))).alias("untitled"))
