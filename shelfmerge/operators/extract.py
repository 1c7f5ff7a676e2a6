"""Pages to rows. A site is a spec: patterns and finishing as data, compiled to native columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmerge.functions.text import normalize_label, ordered_distinct, strip_html
from shelfmerge.functions.urls import canonical_url, resolve_url


@dataclass(frozen=True)
class Field:
    """Patterns tried in order, each with one group; what is found goes through ``finish``."""

    patterns: tuple[str, ...]
    finish: Callable[[Column], Column] = strip_html


@dataclass(frozen=True)
class Spec:
    site: str
    fields: dict[str, Field]
    card: str | None = None
    card_fields: dict[str, Field] = field(default_factory=dict)


META = lambda name: rf'(?is)<meta[^>]+(?:property|name)=["\']{name}["\'][^>]*content=["\']([^"\']*)'
GENERIC = Spec(
    "generic",
    {
        "titulo": Field((r"(?is)<h1[^>]*>(.*?)</h1>", META("og:title"), r"(?is)<title[^>]*>(.*?)</title>")),
        "isbn": Field((r"(?is)\bISBN(?:-1[03])?\b[^0-9]{0,20}([0-9Xx-]{10,17})",)),
        "precio": Field((META("product:price:amount"), r"(?is)class=[\"'][^\"']*price[^\"']*[\"'][^>]*>(.*?)<")),
        "url_portada": Field((META("og:image"),)),
        "sinopsis": Field((META("og:description"), META("description"))),
    },
    card=r"(?is)<li[^>]*>(.*?)</li>",
    card_fields={
        "titulo": Field((r"(?is)<a[^>]*>(.*?)</a>",)),
        "link": Field((r"(?is)<a[^>]+href=[\"']([^\"']*)",), lambda c: c),
    },
)
#: Site id to its spec. A new site is a new entry.
SPECS: dict[str, Spec] = {GENERIC.site: GENERIC}


def value_of(html: Column, f: Field) -> Column:
    found = [F.nullif(F.trim(f.finish(F.regexp_extract(html, p, 1))), F.lit("")) for p in f.patterns]
    return F.coalesce(*found, F.lit(""))


def extract_fields(pages: DataFrame, spec: Spec = GENERIC) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", *[value_of(html, f).alias(name) for name, f in spec.fields.items()])


def extract_links(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """(page_id, position, link): hrefs, absolute and canonical, each once, in order of first sight."""
    raw = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)"""), F.lit(1))
    links = F.transform(raw, lambda x: canonical_url(resolve_url(F.col("url"), x)))
    rows = pages.select("page_id", F.posexplode(F.array_distinct(links)).alias("position", "link"))
    return rows.filter(F.col("link").rlike(pattern)) if pattern else rows


def extract_cards(pages: DataFrame, spec: Spec = GENERIC) -> DataFrame:
    """One row per result card of a listing page, first of each link."""
    cards = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(spec.card), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(cards).alias("position", "card"))
    rows = rows.select("page_id", "url", "position", *[value_of(F.col("card"), f).alias(n) for n, f in spec.card_fields.items()])
    rows = rows.withColumn("link", canonical_url(resolve_url(F.col("url"), F.col("link"))))
    return rows.groupBy("page_id", "link").agg(F.min_by("titulo", "position").alias("titulo"), F.min("position").cast("int").alias("position"))


#: Label and value, as tables, definition lists, bullets and data attributes write them.
PAIRS = [
    r"(?is)<t[hd][^>]*>(.*?)</t[hd]>\s*<td[^>]*>(.*?)</td>",
    r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>",
    r"(?is)<li[^>]*>\s*<(?:b|strong|span)[^>]*>(.*?):?\s*</(?:b|strong|span)>(.*?)</li>",
    r"(?is)data-campo=[\"']([^\"']+)[\"'][^>]*>(.*?)<",
]


def extract_kv(pages: DataFrame) -> DataFrame:
    """(page_id, sheet): label/value pairs with normalized labels; the first of a label counts."""
    html = F.coalesce("html", F.lit(""))
    pairs = []
    for p in PAIRS:
        names = F.regexp_extract_all(html, F.lit(p), F.lit(1))
        values = F.regexp_extract_all(html, F.lit(p), F.lit(2))
        pairs.append(
            F.zip_with(
                names,
                values,
                lambda k, v: F.struct(
                    normalize_label(F.regexp_replace(strip_html(k), r"[:\s]+$", "")).alias("k"), strip_html(v).alias("v")
                ),
            )
        )
    good = F.filter(F.concat(*pairs), lambda e: (e["k"] != "") & (e["v"] != ""))
    keys = F.array_distinct(F.transform(good, lambda e: e["k"]))
    first = F.transform(keys, lambda k: F.filter(good, lambda e: e["k"] == k)[0]["v"])
    return pages.select("page_id", F.map_from_arrays(keys, first).alias("sheet"))


def extract_jsonld(pages: DataFrame, types: tuple[str, ...] = ("Book", "Product")) -> DataFrame:
    """(page_id, type, name, author, publisher, isbn): the first thing of these types in the page's ld+json."""
    scripts = F.regexp_extract_all(
        F.coalesce("html", F.lit("")), F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)
    )
    docs = pages.select("page_id", F.posexplode(F.transform(scripts, F.try_parse_json)).alias("k", "v")).filter("v is not null")
    graph = F.try_variant_get("v", "$['@graph']", "array<variant>")
    many = F.coalesce(graph, F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    things = docs.select("page_id", "k", F.posexplode(many).alias("j", "t"))
    get = lambda p: F.try_variant_get("t", p, "string")
    kind = F.coalesce(get("$['@type'][0]"), get("$['@type']"))
    person = lambda f: F.coalesce(
        get(f"$.{f}.name"),
        F.array_join(F.transform(F.try_variant_get("t", f"$.{f}", "array<variant>"), lambda a: F.coalesce(F.try_variant_get(a, "$.name", "string"), F.try_variant_get(a, "$", "string"))), ", "),
        get(f"$.{f}"),
    )
    rows = things.select(
        "page_id",
        F.struct("k", "j").alias("at"),
        kind.alias("type"),
        get("$.name").alias("name"),
        person("author").alias("author"),
        person("publisher").alias("publisher"),
        F.coalesce(get("$.isbn"), get("$.gtin13")).alias("isbn"),
    ).filter(F.col("type").isin(list(types)))
    best = rows.groupBy("page_id").agg(F.min_by(F.struct("type", "name", "author", "publisher", "isbn"), "at").alias("b"))
    return best.select("page_id", "b.*")


PRODUCT = (
    "id bigint, title string, vendor string, tags string, "
    "variants array<struct<id:bigint,sku:string,price:string,available:boolean>>"
)


def extract_product_json(df: DataFrame) -> DataFrame:
    """(page_id, json) of a store to ids, tags, and the first variant that is available, else the first."""
    p = F.from_json("json", PRODUCT)
    v = F.coalesce(F.try_element_at(F.filter(p["variants"], lambda x: x["available"]), F.lit(1)), F.try_element_at(p["variants"], F.lit(1)))
    tags = F.split(F.regexp_replace(F.coalesce(p["tags"], F.lit("")), r'[\[\]"]', ""), ",")
    return df.select(
        "page_id",
        p["id"].alias("product_id"),
        p["title"].alias("titulo"),
        ordered_distinct(tags).alias("tags"),
        v["price"].try_cast("decimal(18,2)").alias("precio"),
        v["sku"].alias("isbn"),
        F.coalesce(v["available"], F.lit(False)).alias("available"),
    )


class BlockReader(HTMLParser):
    """Texts of elements that start with a class or id, nested ones of their tag included."""

    def __init__(self, mark: str):
        super().__init__(convert_charrefs=True)
        self.mark, self.tag, self.depth, self.parts, self.found = mark, "", 0, [], []

    def handle_starttag(self, tag, attrs):
        if self.depth:
            self.depth += tag == self.tag
            self.parts.append(" ")
        elif any(self.mark in (v or "").split() for k, v in attrs if k in ("class", "id")):
            self.tag, self.depth, self.parts = tag, 1, []

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1
            if not self.depth:
                self.found.append(" ".join("".join(self.parts).split()))
        elif self.depth:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def extract_block(pages: DataFrame, mark: str) -> DataFrame:
    """(page_id, block): the longest text of an element with this class or id; tags are balanced, so Python reads them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            blocks = []
            for h in f["html"]:
                r = BlockReader(mark)
                r.feed(h or "")
                blocks.append(max(r.found, key=len, default=""))
            yield pd.DataFrame({"page_id": f["page_id"], "block": blocks})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, block string")


def extract_breadcrumb(pages: DataFrame) -> DataFrame:
    """(page_id, path, last): the category path and its end."""
    nav = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<(?:nav|ol|ul)[^>]*breadcrumb[^>]*>(.*?)</(?:nav|ol|ul)>", 1)
    path = ordered_distinct(F.transform(F.regexp_extract_all(nav, F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), lambda x: strip_html(x)))
    return pages.select("page_id", path.alias("path"), F.try_element_at(path, F.lit(-1)).alias("last"))


def extract_contributors(pages: DataFrame) -> DataFrame:
    """(page_id, authors): name, biography and photo of each block of class author."""
    blocks = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<div[^>]*class=[\"']autor[\"'][^>]*>(.*?)</div>"), F.lit(1))
    one = lambda b, p: strip_html(F.regexp_extract(b, p, 1))
    return pages.select(
        "page_id",
        F.transform(
            blocks,
            lambda b: F.struct(
                one(b, r"(?is)<h\d[^>]*>(.*?)</h\d>").alias("nombre"),
                one(b, r"(?is)<p[^>]*>(.*?)</p>").alias("bio"),
                F.regexp_extract(b, r"(?is)<img[^>]+src=[\"']([^\"']*)", 1).alias("foto"),
            ),
        ).alias("authors"),
    )


def non_digital(formats: Column) -> Column:
    return F.filter(formats, lambda f: ~F.lower(f["name"]).rlike("ebook|e-book|kindle|digital|audio"))


def extract_formats(pages: DataFrame) -> DataFrame:
    """(page_id, formats, chosen): format options; chosen is the selected one if printed, else the first printed."""
    form = r"(?is)<option([^>]*)>(.*?)</option>"
    html = F.coalesce("html", F.lit(""))
    options = F.zip_with(
        F.regexp_extract_all(html, F.lit(form), F.lit(1)),
        F.regexp_extract_all(html, F.lit(form), F.lit(2)),
        lambda a, t: F.struct(strip_html(t).alias("name"), a.rlike(r"(?i)\bselected\b").alias("selected")),
    )
    printed = non_digital(options)
    chosen = F.coalesce(
        F.try_element_at(F.filter(printed, lambda f: f["selected"]), F.lit(1))["name"], F.try_element_at(printed, F.lit(1))["name"]
    )
    return pages.select("page_id", options.alias("formats"), chosen.alias("chosen"))


def max_page(pages: DataFrame, column: str = "html", total: Column | None = None, per_page: int = 1) -> DataFrame:
    """(page_id, last_page): the greatest page number linked, else from the number of items, else 1."""
    n = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda x: x.try_cast("int")))
    other = F.ceil(total / per_page).cast("int") if total is not None else F.lit(None).cast("int")
    return pages.select("page_id", F.coalesce(n, other, F.lit(1)).alias("last_page"))


def unwrap_json_html(df: DataFrame) -> DataFrame:
    """(page_id, html) from answers that hide HTML in JSON: html, data.html, or results' html or content in order."""
    v = F.try_parse_json("json")
    get = lambda x, p: F.try_variant_get(x, p, "string")
    results = F.array_join(F.transform(F.try_variant_get(v, "$.results", "array<variant>"), lambda r: F.coalesce(get(r, "$.html"), get(r, "$.content"))), "\n")
    return df.select("page_id", F.coalesce(get(v, "$.html"), get(v, "$.data.html"), results, F.col("json")).alias("html"))
