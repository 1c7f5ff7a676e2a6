"""Reports over the standard table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmerge.functions.text import byte_profile, is_blank
from shelfmerge.operators.texts import ordered_with_texts

FIELDS = (
    "isbn titulo autor editorial encuadernacion categoria sinopsis idioma paginas dimensiones url_portada".split()
)
#: What an enriched listing should have.
WANTED = ["titulo", "autor", "editorial", "sinopsis", "idioma", "paginas", "url_portada"]
#: Columns of the full scan, by their export names.
EXPORT = {
    "ISBN": "isbn", "TITULO": "titulo", "AUTOR": "autor", "EDITORIAL": "editorial", "ENCUADERNACION": "encuadernacion",
    "CATEGORIA": "categoria", "SINOPSIS": "sinopsis", "IDIOMA": "idioma", "PAGINAS": "paginas",
    "DIMENSIONES": "dimensiones", "FECHA PUBLICACION": "fecha_publicacion", "URL": "url", "URL PORTADA": "url_portada",
    "SITE": "site",
}
#: Catalogue of named reports: text with ? for arguments, over the view book_std.
NAMED = {
    "count_total": "SELECT count(*) AS total FROM book_std",
    "count_by_site": "SELECT site, count(*) AS c FROM book_std GROUP BY site ORDER BY c DESC, site",
    "latest": "SELECT isbn, titulo, site, url, updated_at FROM book_std ORDER BY updated_at DESC, site, url LIMIT 50",
    "site_count": "SELECT count(*) AS n FROM book_std WHERE site = ?",
    "site_latest": "SELECT isbn, titulo, autor, site, url, updated_at FROM book_std WHERE site = ? ORDER BY updated_at DESC, url LIMIT 50",
    "missing_isbn": "SELECT count(*) AS n FROM book_std WHERE isbn IS NULL OR trim(isbn) = ''",
    "missing_title": "SELECT count(*) AS n FROM book_std WHERE titulo IS NULL OR trim(titulo) = ''",
    "missing_author": "SELECT count(*) AS n FROM book_std WHERE autor IS NULL OR trim(autor) = ''",
    "missing_synopsis": "SELECT count(*) AS n FROM book_std WHERE sinopsis IS NULL OR trim(sinopsis) = ''",
    "dup_isbn": "SELECT isbn, count(*) AS c FROM book_std WHERE trim(isbn) <> '' GROUP BY isbn HAVING count(*) > 1 ORDER BY c DESC, isbn LIMIT 100",
    "dup_isbn_by_site": "SELECT site, isbn, count(*) AS c FROM book_std WHERE trim(isbn) <> '' GROUP BY site, isbn HAVING count(*) > 1 ORDER BY c DESC, site, isbn LIMIT 100",
}


def run_named_query(spark: SparkSession, std: DataFrame, name: str, args: list | None = None) -> DataFrame:
    """A report of the catalogue with its arguments bound by place."""
    if name not in NAMED:
        raise KeyError(f"no report {name!r}; there are {', '.join(NAMED)}")
    std.createOrReplaceTempView("book_std")
    return spark.sql(NAMED[name], args=args)


def scan_all(std: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Every row under its export names, by site, isbn and title; texts: (ref, text), if synopses are references to it."""
    rows, order = std.select(*[F.col(c).alias(name) for name, c in EXPORT.items()]), ["SITE", "ISBN", "TITULO", "URL"]
    return rows.orderBy(*order) if texts is None else ordered_with_texts(rows, texts, "SINOPSIS", order)


def missing_rows(std: DataFrame, column: str, n: int = 100) -> DataFrame:
    rows = std.filter(is_blank(F.col(column))).select("isbn", "titulo", "site", "url", "updated_at")
    return rows.orderBy(F.desc("updated_at"), "site", "url").limit(n)


def missing_count(std: DataFrame, *columns: str) -> DataFrame:
    return std.agg(*[F.count_if(is_blank(F.col(c))).alias(f"missing_{c}") for c in columns])


def site_rows(std: DataFrame, site: str, n: int = 5) -> DataFrame:
    rows = std.filter(F.col("site") == site).select("isbn", "site", "url", "encuadernacion", "updated_at")
    return rows.orderBy(F.desc("updated_at"), "url").limit(n)


def by_isbns(std: DataFrame, isbns: list[str]) -> DataFrame:
    return std.filter(F.col("isbn").isin(isbns)).select("isbn", "site", "url", "encuadernacion")


def lineage_of(std: DataFrame, isbn: str, site: str) -> DataFrame:
    rows = std.filter((F.col("isbn") == isbn) & (F.col("site") == site))
    return rows.orderBy(F.desc("updated_at"), "url").limit(1).select("isbn", "site", "encuadernacion", "raw_json", "updated_at")


def needs_enrichment(std: DataFrame, site: str = "amazon_books", wanted: list[str] = WANTED) -> DataFrame:
    """Listings of other sites with an isbn and any wanted field blank."""
    lacking = F.lit(False)
    for c in wanted:
        lacking = lacking | is_blank(F.col(c))
    return std.filter(~is_blank(F.col("isbn")) & (F.col("site") != site) & lacking)


def only_with_isbn(std: DataFrame) -> DataFrame:
    return std.filter(~is_blank(F.col("isbn")))


def cleaned_binding(c: Column) -> Column:
    return F.lower(F.translate(F.trim(c), " \t", ""))


def is_typo(c: Column) -> Column:
    low = F.lower(c)
    return cleaned_binding(c).isin("rstica", "rustica") | low.like("%rstica%") | low.like("%rustica%")


def typo_candidates(std: DataFrame) -> DataFrame:
    return std.filter(is_typo(F.col("encuadernacion")))


def typo_profile(std: DataFrame) -> DataFrame:
    code, size = byte_profile(F.col("encuadernacion"))
    return typo_candidates(std).groupBy("site", "encuadernacion", code.alias("hex"), size.alias("len")).agg(
        F.count("*").alias("c")
    )


def counts_by_site(std: DataFrame) -> DataFrame:
    return std.groupBy("site").agg(F.count("*").alias("c"))


def missing_by_site(std: DataFrame, columns: list[str] = FIELDS) -> DataFrame:
    """Rows and missing values per site, all in one pass."""
    return std.groupBy("site").agg(
        F.count("*").alias("total"), *[F.count_if(is_blank(F.col(c))).alias(f"missing_{c}") for c in columns]
    )


def dupes(std: DataFrame, *keys: str, n: int = 100) -> DataFrame:
    """Keys with more than one row, the most frequent first."""
    found = only_with_isbn(std).groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1")
    return found.orderBy(F.desc("c"), *keys).limit(n)


def each_issue(std: DataFrame, *columns: str) -> DataFrame:
    """One row per issue, as i. A plain explode would have the optimizer work out all issues once more to see if there are any."""
    return std.select(*columns, F.explode_outer("qc_issues").alias("i")).filter(F.col("i").isNotNull())


def qc_report(std: DataFrame, only_warn: bool = False, min_count: int = 1) -> DataFrame:
    """Issues by (site, code, severity) with a __TOTAL__ row for each site; min_count holds for the others."""
    issue = each_issue(std, "site")
    rows = issue.select(
        "site",
        F.when(is_blank(F.col("i.code")), "UNKNOWN").otherwise(F.col("i.code")).alias("code"),
        F.when(is_blank(F.col("i.severity")), "info").otherwise(F.col("i.severity")).alias("severity"),
    )
    if only_warn:
        rows = rows.filter("severity = 'warn'")
    sets = rows.groupingSets(
        [[F.col("site"), F.col("code"), F.col("severity")], [F.col("site")]], "site", "code", "severity"
    ).agg(F.count("*").alias("n"), F.grouping("code").alias("total"))
    kept = sets.filter((F.col("total") == 1) | (F.col("n") >= min_count))
    return kept.select(
        "site",
        F.when(F.col("total") == 1, "__TOTAL__").otherwise(F.col("code")).alias("code"),
        F.when(F.col("total") == 1, "").otherwise(F.col("severity")).alias("severity"),
        "n",
    )


def qc_details(std: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per issue."""
    rows = each_issue(std, "site", "url").select("site", "url", "i.*")
    return rows.orderBy("site", "url", "code").limit(limit) if limit else rows


def latest(std: DataFrame, n: int = 30) -> DataFrame:
    rows = std.select("isbn", "titulo", "site", "url", "encuadernacion", "updated_at")
    return rows.orderBy(F.desc("updated_at"), "site", "url").limit(n)
