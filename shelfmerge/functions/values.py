"""Domain values: bindings, dates, pages, sizes, prices, covers, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmerge.functions.text import clean_text, collapse, fold_accents, let, look_up, strip_html, titleish

#: Words that say "nothing here".
NO_BINDING = ["-", "–", "—", "N/A", "n/a", "NA", "na", "None", "null", "NULL", "s/d", "sin dato"]
#: Bindings in the order they are tried, with the texts that tell them. "paperback" comes before
#: "trade paperback", which therefore never decides.
BINDINGS = [
    ("eBook", ["ebook", "e-book", "digital", "kindle"]),
    ("Tapa Dura", ["hardcover", "hard cover", "hardback", "hard-back", "tapa dura"]),
    ("De Bolsillo", ["paperback", "mass market paperback"]),
    ("Rústica", ["trade paperback", "tapa blanda", "rustica", "rstica", "softcover", "soft cover"]),
]
#: The same for marketplace listings.
SIMPLE_BINDINGS = [
    ("tapa dura", ["tapa dura", "hardcover"]),
    ("tapa blanda", ["tapa blanda", "paperback"]),
    ("rustica", ["rustica", "rústica"]),
]
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
    "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
}
#: Stop words that tell Spanish from English.
STOP_ES = (
    "el la los las de del y o en para por con sin un una al a que como cuando donde quien su sus se es son"
).split()
STOP_EN = "the and or of to in for with without on at from by a an is are was were this that these those".split()
#: Parts of the addresses of covers that show no cover.
NO_COVER = [
    "sin_foto", "placeholder", "no-image", "noimage", "not-available", "image-not-available", "default",
    "coming-soon", "comingsoon", "missing", "blank", "generic", "cover-not-available",
]
BLOCKED = ["robot check", "enter the characters you see below", "automated access", "captcha", "access denied"]


def any_in(c: Column, texts: list[str]) -> Column:
    found = F.lit(False)
    for t in texts:
        found = found | c.contains(t)
    return found


def normalize_binding(c: Column) -> Column:
    v = F.trim(F.coalesce(c, F.lit("")))

    def named(kept: Column) -> Column:
        return let(collapse(F.lower(fold_accents(kept))), lambda low: binding_of(kept, low))

    return F.when(v.isin(NO_BINDING), "").otherwise(let(F.trim(F.regexp_replace(v, r"\s*\([^)]*\)\s*", "")), named))


def binding_of(kept: Column, low: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, texts in BINDINGS:
        out = out.when(any_in(low, texts), name)
    return out.when(low.isin("de bolsillo", "bolsillo"), "De Bolsillo").otherwise(kept)


def simplify_binding(c: Column) -> Column:
    """The second vocabulary, of marketplace listings: lower-case ``tapa dura``, ``tapa blanda``, ``rustica`` or the text without its lead-in."""

    def named(low: Column) -> Column:
        out = F.when(F.lit(False), "")
        for name, texts in SIMPLE_BINDINGS:
            out = out.when(any_in(low, texts), name)
        return out.otherwise(F.trim(F.regexp_replace(low, r"^encuadernaci[oó]n\s+de\s+", "")))

    return let(F.lower(clean_text(c)), named)


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def split_binding_date(c: Column) -> Column:
    """``Paperback (11/17/2025)`` to struct(binding, date), the month first; date is null without one."""
    t = collapse(F.coalesce(c, F.lit("")))
    form = r"^(.*?)\s*\((\d{1,2})/(\d{1,2})/(\d{4})\)$"
    part = lambda k: F.regexp_extract(t, form, k)
    dated = t.rlike(form)
    return F.struct(
        F.nullif(F.when(dated, F.trim(part(1))).otherwise(t), F.lit("")).alias("binding"),
        F.when(dated, iso(part(4), part(2), part(3))).alias("date"),
    )


def split_format(c: Column) -> Column:
    """``Tapa Blanda - Rústica`` to struct(format, cover, binding)."""
    t = F.trim(F.coalesce(c, F.lit("")))
    after = F.when(t.contains("-"), F.trim(F.regexp_extract(t, r"^[^-]*-([\s\S]*)$", 1))).otherwise("")
    return F.struct(
        t.alias("format"), F.trim(F.regexp_extract(t, r"(?i)^tapa\s+([^-]+)", 1)).alias("cover"), after.alias("binding")
    )


def binding_from_subtitle(c: Column) -> Column:
    """Text before a spaced dash."""
    return F.trim(F.split(clean_text(c), " [–—-] ")[0])


def parse_date_iso(c: Column) -> Column:
    """d/m/y and y-m-d to ISO, not validated; other text as it is."""
    return let(titleish(c), date_of)


def date_of(t: Column) -> Column:
    dmy, ymd = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})\s*$", r"^\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})\s*$"
    part = lambda form, k: F.regexp_extract(t, form, k)
    return (
        F.when(t.rlike(dmy), iso(part(dmy, 3), part(dmy, 2), part(dmy, 1)))
        .when(t.rlike(ymd), iso(part(ymd, 1), part(ymd, 2), part(ymd, 3)))
        .otherwise(t)
    )


def month_number(name: Column) -> Column:
    return look_up(MONTHS, fold_accents(F.lower(name))).cast("string")


def parse_month_date(c: Column) -> Column:
    """``16 Mayo 2023``, ``16 de mayo de 2023``, ``May 16, 2023`` to ISO; other text as it is."""
    t = F.trim(F.coalesce(c, F.lit("")))
    day_first = r"(?i)^(\d{1,2})\s+(?:de\s+)?([a-záéíóúñ]+)\s+(?:de\s+)?(\d{4})$"
    month_first = r"(?i)^([a-záéíóúñ]+)\s+(\d{1,2}),?\s+(\d{4})$"
    part = lambda form, k: F.regexp_extract(t, form, k)
    a, b = month_number(part(day_first, 2)), month_number(part(month_first, 1))
    return (
        F.when(t.rlike(day_first) & a.isNotNull(), iso(part(day_first, 3), a, part(day_first, 1)))
        .when(t.rlike(month_first) & b.isNotNull(), iso(part(month_first, 3), b, part(month_first, 2)))
        .otherwise(t)
    )


def format_pages(c: Column) -> Column:
    """struct(display, num): the first whole number of the text."""
    return let(strip_html(c), pages_of)


def pages_of(t: Column) -> Column:
    n = F.regexp_extract(t, r"(\d+)", 1).try_cast("int")
    return F.struct(
        F.when(n.isNull(), t).otherwise(F.concat(n.cast("string"), F.lit(" págs"))).alias("display"), n.alias("num")
    )


def format_dimensions(c: Column) -> Column:
    """``21,5 X 14`` to ``21.5 x 14 cm``; a unit that is there stays."""
    return let(spaced(strip_html(c)), size_of)


def spaced(c: Column) -> Column:
    """The crosses of sizes between spaces."""
    return collapse(F.regexp_replace(c, r"\s*[xX]\s*", " x "))


def size_of(t: Column) -> Column:
    form = r"(\d+(?:[.,]\d+)?) x (\d+(?:[.,]\d+)?)"
    part = lambda k: F.replace(F.regexp_extract(t, form, k), F.lit(","), F.lit("."))
    base = F.concat(part(1), F.lit(" x "), part(2))
    start = F.regexp_instr(t, F.lit(form))
    rest = F.substr(t, start + F.length(F.regexp_extract(t, form, 0)))
    whole = F.concat(F.substr(t, F.lit(1), start - 1), base, rest)
    return (
        F.when(start == 0, t)
        .when(t.rlike(r"(?i)\b(cm|mm|in|inch|pulgadas)\b"), F.regexp_replace(whole, r"(?i)\bcm\b", "cm"))
        .otherwise(F.concat(base, F.lit(" cm")))
    )


def parse_price(c: Column, locale: str = "mixed") -> Column:
    """DECIMAL(18,2) by the habits of a market; null where there is no number.

    PYG and CLP have no decimals; ARS and EUR write 1.234,56; USD writes 1,234.56;
    mixed takes the last separator with two digits behind it for the decimal one.
    """
    t = F.regexp_extract(F.coalesce(c, F.lit("")), r"([0-9][0-9.,]*)", 1)
    if locale in ("PYG", "CLP"):
        n = F.regexp_replace(F.split(t, ",")[0], "[^0-9]", "")
    elif locale in ("ARS", "EUR"):
        n = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    elif locale == "USD":
        n = F.replace(t, F.lit(","), F.lit(""))
    else:
        comma_last = t.rlike(r",\d{2}$")
        n = F.when(comma_last, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(
            F.replace(t, F.lit(","), F.lit(""))
        )
    return F.rtrim(n, F.lit(".")).try_cast("decimal(18,2)")


def minor_to_major(c: Column) -> Column:
    """Prices in hundredths, told by their size and two zeros, in whole units."""
    return F.when((c >= 100000) & (c % 100 == 0), F.floor(c / 100)).otherwise(c)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[a-z]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def placeholder_cover(c: Column) -> Column:
    """Why an address shows no cover, else null."""
    return let(F.lower(collapse(F.coalesce(c, F.lit("")))), why_no_cover)


def why_no_cover(u: Column) -> Column:
    out = F.when(u == "", F.lit(None)).when(u.startswith("data:"), "data_uri")
    for p in NO_COVER:
        out = out.when(u.contains(p), f"pattern:{p}")
    last = F.element_at(F.split(url_path(u), "/"), -1)
    return out.when((last != "") & ~last.contains("."), "no_extension")


def best_srcset(src: Column, srcset: Column, last: bool = False) -> Column:
    """The widest address of a srcset (first of equals), or its last; src where there is none."""
    parts = F.filter(F.transform(F.split(F.coalesce(srcset, F.lit("")), ","), lambda x: F.trim(x)), lambda p: p != "")
    if last:
        return F.coalesce(F.split(F.try_element_at(parts, F.lit(-1)), " ")[0], src, F.lit(""))
    ranked = F.transform(
        parts,
        lambda p, k: F.struct(
            F.coalesce(F.regexp_extract(p, r"\s(\d+)w$", 1).try_cast("int"), F.lit(-1)).alias("w"),
            (-k).alias("k"),
            F.split(p, r"\s+")[0].alias("url"),
        ),
    )
    top = F.array_max(ranked)
    return F.when(top.isNotNull() & (top["w"] >= 0), top["url"]).otherwise(F.coalesce(src, top["url"], F.lit("")))


def best_cover(urls: Column, isbn: Column) -> Column:
    """The highest by score, first of equals: the number in the address, its extension, known derivatives."""

    def score(u: Column) -> Column:
        low = F.lower(u)
        has = (isbn != "") & F.contains(F.regexp_replace(F.upper(u), "[^0-9X]", ""), isbn)
        kind = F.when(low.rlike(r"\.(jpg|jpeg|png)$"), 5000).when(low.endswith(".webp"), 1000).otherwise(0)
        return F.when(has, 20000).otherwise(0) + kind - F.when(low.contains("mediamodifier"), 50).otherwise(0)

    ranked = F.transform(urls, lambda u, k: F.struct(score(u).alias("s"), (-k).alias("k"), u.alias("url")))
    return F.coalesce(F.array_max(F.filter(ranked, lambda r: F.trim(r["url"]) != ""))["url"], F.lit(""))


def guess_language(c: Column) -> Column:
    """struct(lang, conf): Spanish or English by stop words and accents; empty where undecided."""
    return let(language_counts(c), lambda n: let(scores_of(n), decide))


#: Letters of the words that are counted.
LETTER = "[a-záéíóúñ]"


def stop_words(t: Column, words: list[str]) -> Column:
    """How many words of a lower-case text are among these."""
    return F.regexp_count(t, F.lit(f"(?<!{LETTER})(?:{'|'.join(words)})(?!{LETTER})")).cast("double")


def language_counts(c: Column) -> Column:
    """struct(es, en, accents): stop words of either language and accents, three at most; those of parts of a text add up."""

    t = F.lower(F.coalesce(c, F.lit("")))
    accents = F.size(F.split(t, "[áéíóúñ]", 4)) - 1
    return F.struct(stop_words(t, STOP_ES).alias("es"), stop_words(t, STOP_EN).alias("en"), accents.alias("accents"))


def added_counts(a: Column, b: Column) -> Column:
    """Of a text from the language_counts() of its parts, columns, between which a word ends; null counts nothing."""
    sum_of = lambda f, none: F.coalesce(a[f], F.lit(none)) + F.coalesce(b[f], F.lit(none))
    return F.struct(sum_of("es", 0.0).alias("es"), sum_of("en", 0.0).alias("en"), F.least(sum_of("accents", 0), F.lit(3)).alias("accents"))


def scores_of(n: Column) -> Column:
    """Scores from language_counts()."""
    return F.struct((n["es"] + n["accents"] * 0.75).alias("es"), n["en"].alias("en"))


def decide(s: Column) -> Column:
    es, en = s["es"], s["en"]
    undecided = ((es < 2) & (en < 2)) | (es == en)
    return F.struct(
        F.when(undecided, "").when(es > en, "Español").otherwise("Inglés").alias("lang"),
        F.when(undecided, 0.0).otherwise(F.abs(es - en) / F.greatest(es, en, F.lit(1.0))).alias("conf"),
    )


def availability(schema: Column, variants: Column, text: Column) -> Column:
    """in_stock, out_of_stock or null: the page's own mark, else any variant, else words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(schema.rlike("(?i)instock"), "in_stock")
        .when(schema.rlike("(?i)outofstock|soldout"), "out_of_stock")
        .when(F.size(variants) > 0, F.when(F.exists(variants, lambda v: v), "in_stock").otherwise("out_of_stock"))
        .when(low.rlike("agotado|sin stock|out of stock"), "out_of_stock")
        .when(low.rlike("disponible|en stock|in stock"), "in_stock")
    )


def is_blocked_page(html: Column) -> Column:
    return any_in(F.lower(F.coalesce(html, F.lit(""))), BLOCKED)
