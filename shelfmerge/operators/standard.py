"""Raw listings to the standard row, and the quality rules on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmerge.functions import text as tx
from shelfmerge.functions import values as vl
from shelfmerge.functions.ids import normalize_isbn
from shelfmerge.functions.urls import joined as joined_url
from shelfmerge.operators import texts as refs

#: Standard field to the names that sources give it, in the order they are tried.
ALIASES = {
    "url": ["URL", "url", "url_detalle", "detail_url", "link"],
    "url_portada": ["URL PORTADA", "url_portada", "portada_url", "cover_url", "image", "image_url"],
    "isbn": ["ISBN", "isbn", "gtin13", "ean"],
    "titulo": ["TITULO", "titulo", "title", "name"],
    "autor": ["AUTOR", "autor", "author"],
    "editorial": ["EDITORIAL", "editorial", "publisher"],
    "encuadernacion": ["ENCUADERNACION", "encuadernacion", "binding", "formato", "format", "cover", "tipo_encuadernacion", "tipo_de_encuadernacion"],
    "categoria": ["CATEGORIA", "categoria", "categoría", "category", "genre", "genero", "género"],
    "idioma": ["IDIOMA", "idioma", "language"],
    "sinopsis": ["SINOPSIS", "sinopsis", "descripcion", "description", "summary"],
    "paginas": ["PAGINAS", "paginas", "pages"],
    "dimensiones": ["DIMENSIONES", "dimensiones", "medidas", "dimensions"],
    "fecha_publicacion": ["FECHA PUBLICACION", "fecha_publicacion", "fecha_edicion", "published", "publication_date"],
}
#: Fields that stand in the row itself and never in its extras.
OWN_ONLY = {"url", "url_portada"}
#: The fields of the older row form, and where each comes from.
LEGACY = {
    "url_detalle": ["url_detalle", "url", "URL", "link", "href", "detail_url"],
    "titulo": ["titulo", "TITULO", "title", "name"],
    "autor": ["autor", "AUTOR", "author", "authors"],
    "isbn": ["isbn", "ISBN", "isbn13", "ean", "gtin13"],
    "precio": ["precio", "price", "PRECIO"],
    "descripcion": ["descripcion", "sinopsis", "SINOPSIS", "description", "summary"],
    "portada_url": ["portada_url", "url_portada", "URL PORTADA", "cover_url", "image", "image_url"],
    "sitio": ["sitio", "site", "SITE", "source"],
}
#: Extras of the older form.
LEGACY_INFO = {
    f: ALIASES[f]
    for f in ("editorial", "encuadernacion", "idioma", "paginas", "dimensiones", "fecha_publicacion", "categoria")
}
STD = list(ALIASES)


def non_empty(m: Column) -> Column:
    """The map without null and empty values."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def pick(raw: Column, names: list[str], extra: Column | None = None) -> Column:
    """The first name that the row's map has, then its extras'. Both hold no empty values.

    The names are met with the map's keys at once: a look-up for each of the hundred
    names makes a generated method of a size that the JVM does not compile.
    """

    def found(m: Column) -> Column:
        held = F.array_intersect(F.array(*[F.lit(n) for n in names]), F.map_keys(m))
        return F.try_element_at(m, F.get(held, F.lit(0)))

    return F.coalesce(*[found(m) for m in (raw, extra) if m is not None], F.lit(""))


def standardize(raw: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(site, raw map, info map) to the standard columns, quality rules applied in fix mode.

    texts: (ref, text), if synopses are references to it; each text is then worked on once.
    """
    r, info = F.col("raw"), F.col("info")
    # step by step: what several expressions need is a column, and worked out once
    raw = raw.select("site", non_empty(r).alias("raw"), non_empty(info).alias("info"))
    picked = raw.select("site", *[pick(r, names, None if f in OWN_ONLY else info).alias(f) for f, names in ALIASES.items()])
    lead = r"(?i)^\s*Información adicional\s*Descripción\s*"
    stripped = lambda df, *columns: df.withColumns({c: tx.untagged(F.col(c)) for c in columns}).withColumns({c: tx.plain(F.col(c)) for c in columns})
    synopsis = lambda df, c: stripped(df, c).withColumn(c, F.trim(F.regexp_replace(c, lead, "")))
    link = F.trim(F.coalesce("url_portada", F.lit("")))
    known = stripped(picked, "encuadernacion", "categoria", "paginas", "dimensiones").withColumns(
        {
            "url_portada": joined_url(F.col("url"), link),
            "idioma": tx.titleish(F.col("idioma")),
            "fecha_publicacion": tx.titleish(F.col("fecha_publicacion")),
            "dimensiones": vl.spaced(F.col("dimensiones")),
        }
    )
    known = known.withColumn("_pages", vl.pages_of(F.col("paginas")))
    known = synopsis(known, "sinopsis") if texts is None else known
    no_photo = F.lower(F.trim(vl.url_path(F.col("url_portada")))).endswith("sin_foto.jpg")
    std = known.select(
        "site",
        "url",
        normalize_isbn(F.col("isbn")).alias("isbn"),
        *[tx.titleish(F.col(c)).alias(c) for c in ("titulo", "autor", "editorial", "encuadernacion", "categoria")],
        "sinopsis",
        tx.language_named(F.col("idioma")).alias("idioma"),
        F.col("_pages.display").alias("paginas"),
        vl.size_of(F.col("dimensiones")).alias("dimensiones"),
        vl.date_of(F.col("fecha_publicacion")).alias("fecha_publicacion"),
        F.when(no_photo, "").otherwise(F.col("url_portada")).alias("url_portada"),
        F.col("_pages.num").alias("paginas_num"),
    )
    if texts is None:
        return qc_rules(std, "fix")
    texts = synopsis(texts.select("ref", "text"), "text")
    both = refs.met(std, "sinopsis", texts.select("ref", F.col("text").alias("_text"), vl.language_counts(F.col("text")).alias("_counts")))
    return qc_rules(both.withColumn("sinopsis", F.coalesce("_text", "sinopsis")).drop("_text"), "fix")


def qc_rules(std: DataFrame, mode: str = "fix", fix: float = 0.75, warn: float = 0.55, texts: DataFrame | None = None) -> DataFrame:
    """std with qc_issues; in fix mode wrong languages and covers are put right, flag mode only reports.

    texts: (ref, text), if synopses are references to it: their words are counted once a
    text. A column _counts holds such counts if they are known already, and is dropped.
    """
    mend = mode == "fix"
    if texts is not None:
        std = refs.met(std, "sinopsis", refs.counted(texts, vl.language_counts(F.col("text")), "_counts"))
    clean = lambda c: tx.collapse(F.coalesce(F.col(c), F.lit("")))
    if "_counts" in std.columns:
        counted = std.withColumn("_own", vl.language_counts(F.col("titulo"))).withColumn("_s", vl.added_counts(F.col("_own"), F.col("_counts")))
    else:  # white space makes no difference to the guess
        counted = std.withColumn("_s", vl.language_counts(F.concat_ws(". ", "titulo", "sinopsis")))
    # step by step: what several expressions need is a column, as what is bound in an expression is not compiled
    counted = counted.withColumns({"_s": vl.scores_of(F.col("_s")), "_lang": clean("idioma"), "_cover": clean("url_portada"), "_isbn": clean("isbn")})
    rows = counted.withColumn("_low", F.lower("_cover")).withColumns(
        {
            "_g": vl.decide(F.col("_s")),
            "_bad": vl.why_no_cover(F.col("_low")),
            "_in_url": F.regexp_extract("_cover", r"(?<!\d)(\d{10,13})(?!\d)", 1),
        }
    )
    told, lang, conf = F.col("_g.lang") != "", F.col("_lang"), F.col("_g.conf")
    wrong = told & (conf >= warn) & (lang != "") & (lang != F.col("_g.lang"))
    mended = wrong & (conf >= fix) & F.lit(mend)
    added = told & (conf >= fix) & (lang == "") & F.lit(mend)
    bad = (F.col("_cover") != "") & F.col("_bad").isNotNull()
    other = (F.col("_cover") != "") & (F.col("_isbn") != "") & (F.col("_in_url") != "") & (F.col("_in_url") != F.col("_isbn"))
    issue = lambda when, code, severity, message: F.when(
        when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))
    )
    say = lambda form, *c: F.format_string(form, *c)
    issues = F.array_compact(
        F.array(
            issue(wrong, "LANG_MISMATCH", "warn", say("%s given, reads like %s", lang, F.col("_g.lang"))),
            issue(mended, "LANG_FIXED", "info", say("language set to %s", F.col("_g.lang"))),
            issue(added, "LANG_FILLED", "info", say("language filled with %s", F.col("_g.lang"))),
            issue(bad, "COVER_PLACEHOLDER", "warn", say("no real cover: %s", F.col("_bad"))),
            issue(bad & F.lit(mend), "COVER_CLEARED", "info", F.lit("placeholder cleared")),
            issue(other, "COVER_ISBN_MISMATCH", "warn", say("cover is of %s", F.col("_in_url"))),
            issue(other & F.lit(mend), "COVER_CLEARED", "info", F.lit("cover of another item cleared")),
        )
    )
    out = rows.withColumn("qc_issues", issues)
    if mend:
        out = out.withColumns(
            {
                "idioma": F.when(mended | added, F.col("_g.lang")).otherwise(F.col("idioma")),
                "url_portada": F.when(bad | other, "").otherwise(F.col("url_portada")),
            }
        )
    return out.drop("_counts", "_own", "_s", "_low", "_isbn", "_g", "_lang", "_cover", "_bad", "_in_url")


def harmonize(raw: DataFrame) -> DataFrame:
    """(site, raw map, info map) to the older row form; extras are filled from the row, never overwritten."""
    none = F.create_map().cast("map<string,string>")
    raw = raw.select("site", non_empty(F.col("raw")).alias("raw"), F.coalesce("info", none).alias("info"))
    r, info = F.col("raw"), F.col("info")
    top = [pick(r, names).alias(f) for f, names in LEGACY.items()]
    added = F.map_from_arrays(
        F.array(*[F.lit(f) for f in LEGACY_INFO]), F.array(*[pick(r, names) for names in LEGACY_INFO.values()])
    )
    own = F.map_filter(info, lambda k, v: ~tx.is_blank(v))
    fresh = F.map_filter(added, lambda k, v: ~tx.is_blank(v) & ~F.map_contains_key(own, k))
    return raw.select("site", *top, F.map_concat(own, fresh).alias("info_adicional"))


def coerce_legacy(raw: DataFrame) -> DataFrame:
    """Standard rows pass with isbn and binding normalized; older ones are mapped, their extras from info."""
    r, info = F.col("raw"), F.col("info")
    is_std = F.map_contains_key(r, F.lit("ISBN")) & F.map_contains_key(r, F.lit("URL")) & F.map_contains_key(r, F.lit("SITE"))
    get = lambda m, *names: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names], F.lit(""))
    binding = vl.normalize_binding(tx.first_filled(*[F.try_element_at(info, F.lit(n)) for n in ("encuadernacion", "binding", "formato", "format", "tapa", "cover")]))
    old = {
        "site": get(r, "sitio"),
        "url": get(r, "url_detalle"),
        "isbn": normalize_isbn(get(r, "isbn")),
        "titulo": get(r, "titulo"),
        "autor": get(r, "autor"),
        "editorial": get(info, "editorial"),
        "encuadernacion": binding,
        "categoria": get(info, "categoria", "categoría", "category"),
        "sinopsis": get(r, "descripcion"),
        "idioma": get(info, "idioma"),
        "paginas": get(info, "paginas"),
        "dimensiones": get(info, "dimensiones"),
        "fecha_publicacion": get(info, "fecha_publicacion"),
        "url_portada": get(r, "portada_url"),
    }
    new = {f: get(r, ALIASES[f][0]) for f in ALIASES} | {"site": get(r, "SITE")}
    new["isbn"], new["encuadernacion"] = normalize_isbn(new["isbn"]), vl.normalize_binding(new["encuadernacion"])
    return raw.select(*[F.when(is_std, new[f]).otherwise(old[f]).alias(f) for f in old])


def coerce_captures(df: DataFrame) -> DataFrame:
    """(SITE, ISBN, ISBN10, FECHA PUBLICACION, detail map, ...): site names, numbers and dates put in form."""

    def number(own: str, label: str) -> Column:
        values = F.map_values(F.map_filter("detail", lambda k, v: k.contains(label)))
        return F.coalesce(F.nullif(normalize_isbn(F.col(own)), F.lit("")), normalize_isbn(F.try_element_at(values, F.lit(1))))

    site = F.trim(F.coalesce("SITE", F.lit("")))
    return df.withColumns(
        {
            "SITE": F.when(F.lower(site) == "amazon", "amazon_books").otherwise(site),
            "ISBN": number("ISBN", "ISBN-13"),
            "ISBN10": number("ISBN10", "ISBN-10"),
            "FECHA PUBLICACION": vl.parse_month_date(F.col("FECHA PUBLICACION")),
        }
    )


def wrap_lineage(raw: Column, std: Column, qc: Column) -> Column:
    """raw_json: the row as found, as standardized, and its issues."""
    return F.to_json(F.struct(raw.alias("raw"), std.alias("std"), qc.alias("qc")))


#: Keys of a JSON column that may become columns.
MOST_KEYS = 500


def clean_table(df: DataFrame, html_columns: list[str], json_column: str | None = None, most_keys: int = MOST_KEYS) -> DataFrame:
    """HTML out of the named columns; the keys of a JSON column as columns ``column__key``, sorted, existing ones stay.

    Finding the keys is one small action. More than most_keys of them are an error: no table has so many columns.
    """
    out = df.withColumns({c: tx.strip_html(F.col(c)) for c in html_columns})
    if not json_column:
        return out
    parsed = F.from_json(json_column, "map<string,string>")
    keys = df.select(F.explode(F.map_keys(parsed)).alias("k")).distinct().orderBy("k").limit(most_keys + 1).collect()
    if len(keys) > most_keys:
        raise ValueError(f"{json_column} has more than {most_keys} keys; read it as a map")
    fresh = [r.k for r in keys if f"{json_column}__{r.k}" not in df.columns]
    return out.select("*", *[F.coalesce(F.try_element_at(parsed, F.lit(k)), F.lit("")).alias(f"{json_column}__{k}") for k in fresh])


def backfill_from_lineage(std: DataFrame, only_missing: bool = True, site: str | None = None) -> DataFrame:
    """Rows whose binding or category differ from what their raw_json says: (site, url, encuadernacion, categoria).

    Looked up flat, then under std, then under info_adicional. An old category is
    never blanked; an old binding may be.
    """
    rows = std.filter(F.col("site") == site) if site else std
    if only_missing:
        rows = rows.filter(tx.is_blank(F.col("encuadernacion")) | tx.is_blank(F.col("categoria")))
    v = F.try_parse_json("raw_json")
    get = lambda *paths: tx.first_filled(*[F.try_variant_get(v, p, "string") for p in paths])
    binding = vl.normalize_binding(get("$.ENCUADERNACION", "$.encuadernacion", "$.std.ENCUADERNACION", "$.info_adicional.encuadernacion", "$.raw.info_adicional.encuadernacion"))
    found = get("$.CATEGORIA", "$.categoria", "$.std.CATEGORIA", "$.info_adicional.categoria", "$.raw.info_adicional.categoria")
    category = F.when(tx.is_blank(found), F.col("categoria")).otherwise(found)
    made = rows.select("site", "url", F.col("encuadernacion").alias("_e"), F.col("categoria").alias("_c"), binding.alias("encuadernacion"), category.alias("categoria"))
    return made.filter(~F.col("_e").eqNullSafe(F.col("encuadernacion")) | ~F.col("_c").eqNullSafe(F.col("categoria"))).drop("_e", "_c")


def list_plus_detail(listing: DataFrame, detail: DataFrame, prefer_detail: list[str], unite: list[str]) -> DataFrame:
    """One item from its listing card and its own page: the card wins but for the named fields; lists are united."""
    both = listing.alias("l").join(detail.alias("d"), "url", "left")
    out = []
    for c in listing.columns:
        if c == "url":
            out.append(F.col("url"))
        elif c in unite:
            out.append(F.array_union(F.coalesce(f"l.{c}", F.array().cast("array<string>")), F.coalesce(f"d.{c}", F.array().cast("array<string>"))).alias(c))
        else:
            first, second = (f"d.{c}", f"l.{c}") if c in prefer_detail else (f"l.{c}", f"d.{c}")
            out.append(tx.first_filled(F.col(first), F.col(second)).alias(c))
    return both.select(*out)
