"""Site specs: where each site's product pages hold their fields. A new site is a new entry."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmerge.functions.ids import normalize_isbn
from shelfmerge.functions.text import clean_text, dedupe_repeated, fold_accents, ordered_distinct, strip_html
from shelfmerge.functions.values import best_srcset, format_dimensions, format_pages, parse_date_iso, parse_month_date, simplify_binding
from shelfmerge.operators.elements import PARTED, first_filled, select_all
from shelfmerge.operators.extract import GENERIC, SPECS, Spec
from shelfmerge.operators.extract import extract_fields as by_patterns

Finish = Callable[[Column], Column]


@dataclass(frozen=True)
class PageSpec:
    """Fields of a site's pages: selectors tried in order, each with its finish; and fields made of others."""

    site: str
    fields: dict[str, tuple[tuple[str, Finish], ...]]
    derived: dict[str, Callable[[], Column]] = field(default_factory=dict)


def pick(*selectors: str, by: Finish = strip_html) -> tuple[tuple[str, Finish], ...]:
    return tuple((s, by) for s in selectors)


def extract_fields(pages: DataFrame, spec: Spec | PageSpec = GENERIC, names: Sequence[str] | None = None) -> DataFrame:
    """page_id, url and the fields of a spec; missing ones are empty. names: of these fields, and nothing else is looked for in the pages."""
    if isinstance(spec, Spec):
        out = by_patterns(pages, spec)
        return out if names is None else out.select("page_id", "url", *[n for n in spec.fields if n in names])
    made = {n: f for n, f in spec.derived.items() if names is None or n in names}
    fields = {n: picks for n, picks in spec.fields.items() if names is None or made or n in names}  # what is derived may need any
    wanted = list(dict.fromkeys(s for picks in fields.values() for s, _ in picks))
    place = {s: f"s{k}" for k, s in enumerate(wanted)}
    # step by step: what is found is finished once, and then asked whether it is blank
    tried = {(n, k): (f"{n}_{k}", finish(F.col(place[s]))) for n, picks in fields.items() for k, (s, finish) in enumerate(picks)}
    finished = select_all(pages, wanted).select("page_id", "url", *[F.trim(made_of).alias(c) for c, made_of in tried.values()])
    out = finished.select("page_id", "url", *[first_filled([F.col(tried[n, k][0]) for k in range(len(picks))]).alias(n) for n, picks in fields.items()])
    out = out.withColumns({name: F.coalesce(f(), F.lit("")) for name, f in made.items()}) if made else out
    return out if names is None else out.select("page_id", "url", *[c for c in out.columns if c in names])


def paragraphs(c: Column) -> Column:
    return strip_html(c, keep_breaks=True)


def isbn(c: Column) -> Column:
    return normalize_isbn(strip_html(c))


def pages(c: Column) -> Column:
    return format_pages(c)["display"]


def numeric_date(c: Column) -> Column:
    return parse_date_iso(strip_html(c))


def written_date(c: Column) -> Column:
    """A date in words, or one in figures."""
    return parse_date_iso(parse_month_date(strip_html(c)))


def first_day(c: Column) -> Column:
    return F.substring(c, 1, 10)


def as_is(c: Column) -> Column:
    return c


def title_case(c: Column) -> Column:
    return F.initcap(strip_html(c))


def amount(c: Column) -> Column:
    """The first number, as it is written."""
    return F.regexp_extract(strip_html(c), r"\d[\d.,]*", 0)


def dollars(c: Column) -> Column:
    return F.regexp_extract(strip_html(c), r"[$]\s*(\d+[.]?\d*)", 1)


def euros(c: Column) -> Column:
    """The first amount before a euro sign, with a decimal point."""
    return F.replace(F.replace(F.regexp_extract(strip_html(c), r"([\d.,]*\d)\s*€", 1), F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def whole_amount(c: Column) -> Column:
    """The first number without its separators: prices in a currency that has no cents."""
    return F.regexp_replace(amount(c), "[.,]", "")


def binding_named(c: Column) -> Column:
    """The first of the site's bindings that a text names."""
    low, out = F.lower(strip_html(c)), F.when(F.lit(False), "")
    for name in ("Tapa blanda", "Tapa dura", "Bolsillo", "Ebook", "Otros"):
        out = out.when(low.contains(name.lower()), name)
    return out.otherwise("")


def before_dash(c: Column) -> Column:
    """What stands before a dash between spaces."""
    return F.regexp_extract(strip_html(c), r"^(.*?)\s[-–—]\s", 1)


def all_of(c: Column) -> Column:
    """All that was found, each once, by comma."""
    return F.array_join(ordered_distinct(F.transform(F.split(c, PARTED), lambda x: strip_html(x))), ", ")


def authors_of_links(c: Column) -> Column:
    """As all_of, without links that lead on, and long ones."""
    names = ordered_distinct(F.transform(F.split(c, PARTED), lambda x: strip_html(x)))
    real = F.filter(names, lambda x: (F.length(x) <= 60) & ~F.lower(x).rlike("ver|más|descubre"))
    return F.array_join(real, ", ")


def longest(c: Column) -> Column:
    texts = F.transform(F.split(c, PARTED), lambda x: paragraphs(x))
    return F.coalesce(F.array_max(F.transform(texts, lambda x, k: F.struct(F.length(x).alias("n"), (-k).alias("k"), x.alias("x"))))["x"], F.lit(""))


def first_long(c: Column) -> Column:
    """The first of more than 80 characters."""
    texts = F.filter(F.transform(F.split(c, PARTED), lambda x: strip_html(x)), lambda x: F.length(x) > 80)
    return F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit(""))


def once(c: Column) -> Column:
    """Text that may be there twice; a label alone is none."""
    return F.regexp_replace(dedupe_repeated(strip_html(c)), "^[^:]{1,40}:$", "")


def after_colon(c: Column) -> Column:
    return dedupe_repeated(F.regexp_replace(strip_html(c), r"^[^:]{1,40}:\s*", ""))


def widest(c: Column) -> Column:
    return best_srcset(F.lit(""), c)


def sheet_value(*labels: str) -> Finish:
    """The text behind a label and a colon, in the same piece of text or the next, of a sheet of pairs."""

    def find(c: Column) -> Column:
        pieces = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", PARTED), PARTED), lambda x: strip_html(x)), lambda x: x != "")
        joined = F.concat(F.lit("\n"), F.array_join(pieces, "\n"), F.lit("\n"))
        plain = F.upper(fold_accents(joined))  # as long as what it folds
        found = [F.regexp_instr(plain, F.lit(rf"\n{label}\s*:")) for label in labels]
        value = lambda at: F.trim(F.regexp_extract(F.substr(joined, at), r"^\n[^:]*:[ ]*\n?([^\n]*)", 1))
        return F.coalesce(*[F.when(at > 0, value(at)) for at in found], F.lit(""))

    return find


def ld(name: str) -> tuple[str, Finish]:
    """A value of a page's linked data, or the name of the thing, or of the first thing, that stands there."""

    def read(c: Column) -> Column:
        paths = [f"$.{name}[0].name", f"$.{name}.name", f"$.{name}"]
        values = [F.get_json_object(c, p) for p in paths]
        return F.coalesce(*values[:2], F.when(~values[2].rlike(r"^\s*[\[{]"), values[2]))

    return f'script[type*=ld+json][:inner*="{name}"]', read


def bullet(labels: str) -> str:
    """The value beside a bold label."""
    return f"span.a-text-bold{{{labels}}} + span"


def variation(name: str) -> tuple[str]:
    """A numbered variation field, without its label."""
    return (f"div[class*=variation_field_{name}__] !product-details__label",)


def campo(name: str) -> tuple[str, str]:
    """A field of the technical sheet: behind its label, or all of it, without hints."""
    box = f"div.ficha-tecnica [data-campo={name}]"
    return f"{box} > b .. !tooltip|tooltip-content", f"{box} !tooltip|tooltip-content"


def three_sizes() -> Column:
    """Height, width and depth, where all are known."""
    known = (F.col("alto") != "") & (F.col("ancho") != "") & (F.col("grueso") != "")
    return F.when(known, F.concat_ws(" x ", "alto", "ancho", "grueso"))


META_IMAGE = "meta[property=og:image] @content"
SHEET = "p.pivot-metadata"
SPEC_OF_SHEET = {
    "isbn": pick(*campo("ISBN"), by=lambda c: normalize_isbn(once(c))),
    "idioma": pick(*campo("Idioma"), by=once),
    "paginas": pick(*campo("Número de páginas"), by=lambda c: format_pages(once(c))["display"]),
    "fecha_publicacion": pick(*campo("Fecha de lanzamiento"), by=lambda c: parse_date_iso(once(c))),
    "editorial": pick(*campo("Editorial"), by=once),
    **{c.lower(): pick(*campo(c), by=once) for c in ("Alto", "Ancho", "Grueso", "Peso")},
}

FOUND = [
    PageSpec(
        "el_lector",
        {
            "titulo": pick("h1.product_title"),
            "autor": pick(".product-brand a"),
            "isbn": pick("span.sku", by=isbn),
            "editorial": pick("th{editorial} + td", by=title_case),
            "encuadernacion": pick("div.format .value"),
            "idioma": pick("div.format .value (1)", "th{idioma} + td"),
            "paginas": pick("th{páginas} + td", by=pages),
            "dimensiones": pick("th{medidas} + td", by=format_dimensions),
            "fecha_publicacion": pick("th{fecha de edición} + td", by=numeric_date),
            "precio": pick("div.price bdi", "p.price bdi", by=amount),
            "sinopsis": pick("p.product-description-text"),
            "url_portada": pick("img.w-100 @src", by=as_is),
        },
    ),
    PageSpec(
        "riverside",
        {
            "titulo": pick("h1"),
            "autor": pick("li{autor:}"),
            "editorial": pick("li{editor:}"),
            "isbn": pick("dd.isbn", by=isbn),
            "precio": pick("dd.precio"),
            "encuadernacion": pick("dd.tapa"),
            "paginas": pick("dd.paginas", by=pages),
            "dimensiones": pick("dd.dimensiones", by=format_dimensions),
            "sinopsis": pick("header ..{aside|dl}", by=paragraphs),
            "url_portada": pick("a#portada_imagen @href", "a.portada_imagen @href", "figure img @src", by=as_is),
        },
    ),
    PageSpec(
        "yenny",
        {
            "titulo": pick("h1.js-product-name", "h1[data-store^=product-name]"),
            "autor": pick("p.text-accent"),
            "precio": pick("#price_display @data-product-price", "#price_display"),
            "isbn": pick("strong{isbn} ..", by=isbn),
            "editorial": pick("strong{editorial} .."),
            "encuadernacion": pick("strong{encuadernación|formato} .."),
            "idioma": pick("strong{idioma} .."),
            "paginas": pick("strong{páginas|número de páginas|cantidad de páginas} ..", by=pages),
            "dimensiones": pick("strong{dimensiones} ..", by=format_dimensions),
            "fecha_publicacion": pick("strong{fecha de publicación|fecha} ..", by=written_date),
            "sinopsis": pick("strong{sinopsis} ..", by=paragraphs),
            "url_portada": pick("a[class*=product-gallery] @href", "img.js-product-slide-img @data-src", "img.js-product-slide-img @src", by=as_is),
        },
    ),
    PageSpec(
        "bookpeople",
        {
            "titulo": pick("h1.product-details__title"),
            "autor": pick("a[href^=/search?type=author]", ".product-details__contributors a", ".product-details__author a"),
            "isbn": pick(*variation("isbn_13"), by=isbn),
            "editorial": pick(*variation("publisher")),
            "paginas": pick(*variation("pages"), by=pages),
            "idioma": pick(*variation("language")),
            "fecha_publicacion": pick("time[datetime] @datetime", by=first_day),
            "precio": pick(".product-details__price", ".browse-books__price-sale", by=dollars),
            "encuadernacion": pick("select[name*=related] option[selected]"),
            "sinopsis": pick("div.field--name-body", "div[class*=product-details__desc]", by=paragraphs),
            "url_portada": pick("img[src*=images.booksense.com] @src", ".product-details__image img @src", ".product-details__media img @src", by=as_is),
        },
    ),
    PageSpec(
        "amazon_books",
        {
            "titulo": (ld("name"), *pick("#productTitle")),
            "autor": (ld("author"), *pick("span.author a")),
            "editorial": (ld("publisher"), *pick(bullet("editorial|publisher|imprint"))),
            "isbn": (*pick(bullet("isbn-13|isbn13"), by=isbn), (ld("isbn")[0], lambda c: normalize_isbn(ld("isbn")[1](c))), *pick(bullet("isbn-10|isbn10"), by=isbn)),
            "idioma": pick(bullet("idioma|language")),
            "paginas": pick(bullet("número de páginas|number of pages|print length"), by=pages),
            "dimensiones": pick(bullet("dimensiones|dimensions"), by=format_dimensions),
            "fecha_publicacion": ((ld("datePublished")[0], lambda c: written_date(ld("datePublished")[1](c))), *pick(bullet("fecha de publicación|publication date"), by=written_date)),
            "encuadernacion": pick("#productSubtitle", by=before_dash),
            "sinopsis": pick("#bookDescription_feature_div .a-expander-content", by=paragraphs),
            "url_portada": pick(META_IMAGE, "#landingImage @data-old-hires", "#landingImage @src", by=as_is),
        },
    ),
    PageSpec(
        "contrapunto",
        {
            "titulo": pick(".product__title h1", "h1"),
            "autor": (*pick(".pivot-authors a (*)", by=all_of), *pick(".card-information .caption-with-letter-spacing")),
            "editorial": pick(SHEET, by=sheet_value("EDITORIAL")),
            "isbn": pick(SHEET, by=lambda c: normalize_isbn(sheet_value("ISBN", "ISBN-13", "ISBN13")(c))),
            "encuadernacion": pick(SHEET, by=sheet_value("ENCUADERNACION")),
            "idioma": pick(SHEET, by=sheet_value("IDIOMA")),
            "dimensiones": pick(SHEET, by=lambda c: format_dimensions(sheet_value("DIMENSIONES")(c))),
            "paginas": pick(SHEET, by=lambda c: format_pages(sheet_value("N[°º]? DE PAGINAS", "PAGINAS")(c))["display"]),
            "fecha_publicacion": pick(SHEET, by=lambda c: parse_date_iso(sheet_value("FECHA DE PUBLICACION", "PUBLICACION")(c))),
            "precio": pick(".price-item--sale", ".price__regular .price-item--regular", by=whole_amount),
            "sinopsis": (
                *pick("summary{~descripcion|sinopsis|reseña|resumen|contraportada|contenido} ^ .accordion__content"),
                *pick("div.accordion__content (*)", by=first_long),
                *pick("meta[property=og:description] @content", "meta[name=description] @content", by=clean_text),
            ),
            "url_portada": pick(".product__media img @src", ".product__media img @data-src", META_IMAGE, by=as_is),
        },
    ),
    PageSpec(
        "cuspide",
        {
            "titulo": pick("#t-p-f"),
            "autor": pick("#t-p-f ^ a[href^=/libros-ebooks/] (*)", by=authors_of_links),
            "precio": pick(".producto-asociado.selected", ".producto-asociado[aria-current=true]", by=euros),
            "encuadernacion": (*pick(".producto-asociado.selected", ".producto-asociado[aria-current=true]", by=binding_named), *pick(*campo("Encuadernación"), by=once)),
            **SPEC_OF_SHEET,
            "sinopsis": pick(".resumen-content (*)", by=longest),
            "url_portada": (*pick("cdl-img img @srcset", by=widest), *pick("cdl-img img @src", "img[src*=casadellibro] @src", by=as_is)),
        },
        {"dimensiones": three_sizes},
    ),
    PageSpec(
        "casa_del_libro",
        {
            "titulo": pick("#t-p-f", "h1"),
            "encuadernacion": pick(*campo("Encuadernación")[1:], by=after_colon),
            **{name: pick(s[-1][0], by=(lambda c: normalize_isbn(after_colon(c))) if name == "isbn" else after_colon) for name, s in SPEC_OF_SHEET.items()},
            "sinopsis": (*pick("h2{~sinopsis de} + div .resumen-content", by=paragraphs), *pick(".resumen-content (*)", by=longest)),
            "url_portada": (*pick("cdl-img img @srcset", by=widest), *pick("cdl-img img @src", "img[src*=casadellibro] @src", "img @src", by=as_is)),
        },
        {"dimensiones": three_sizes},
    ),
    PageSpec(
        "iberlibro",
        {
            "autor": pick("h2#book-author a", "h2[data-test-id=book-author] a"),
            **{
                name: pick(f"dl.listing-metadata dt{{{label}}} + dd", by=by)
                for name, label, by in (
                    ("titulo", "título", strip_html), ("editorial", "editor", strip_html), ("fecha_publicacion", "fecha de publicación", strip_html),
                    ("idioma", "idioma", strip_html), ("encuadernacion", "encuadernación", lambda c: simplify_binding(strip_html(c))), ("estado", "estado", strip_html),
                )
            },
            "isbn": pick("dl.listing-metadata dt{isbn 13} + dd", "dl.listing-metadata dt{isbn 10} + dd", by=isbn),
            "url_portada": pick("img#isbn-image @src", by=as_is),
        },
    ),
]
PAGE_SPECS = {s.site: s for s in FOUND}


def spec_of(site: str) -> Spec | PageSpec:
    """A site's spec, or the generic one."""
    name = re.sub(r"[^a-z0-9]+", "_", site.strip().lower())
    return PAGE_SPECS.get(name) or SPECS.get(name, GENERIC)
