"""Text expressions: all are native columns; what ``let`` binds is worked out once per row, by interpreted lambdas."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import html5, name2codepoint
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to, position by position.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
#: Planes of letters whose decompositions are looked at; syllables that decompose by arithmetic are left as they are.
LETTERS = range(0x80, 0x10000)
SYLLABLES = range(0xAC00, 0xD7A4)


def decompositions() -> dict[str, str]:
    """What each letter is without its marks, where that is something else: its compatibility decomposition, or nothing for a mark."""
    found = {}
    for code in LETTERS:
        if code in SYLLABLES or 0xD800 <= code < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code):
            found[chr(code)] = plain
    return found


#: Letters that become one letter, then marks, which go; and those that become several.
_ONE = {c: p for c, p in decompositions().items() if len(p) == 1}
_MARKS = "".join(c for c, p in decompositions().items() if not p)
SEVERAL = {c: p for c, p in decompositions().items() if len(p) > 1}
#: Spaces other than those of ASCII: references to them become a space.
SPACES = [c for c in range(0x80, 0x10000) if chr(c).isspace() and c != 0x85]
#: Named character references of HTML 5, with their semicolon where they need it; those of HTML 4 are looked at first.
ENTITIES = {
    name: "".join(" " if ord(c) in SPACES else c for c in value)
    for name, value in sorted(html5.items(), key=lambda x: (x[0].rstrip(";") not in name2codepoint, x[0]))
}
#: Names are looked up backwards, so that those of arrows do not read like an operator's name in a plan's text.
ENTITY_TABLE = "\x01".join(f"{name[::-1]}\x02{value}" for name, value in ENTITIES.items())
#: References that count without their semicolon too, even with letters behind; the longest that fits.
BARE = "^(" + "|".join(sorted((n for n in ENTITIES if n[-1] != ";"), key=len, reverse=True)) + ")"
#: What numbers of the upper control characters mean: the signs of Windows-1252.
CONTROLS = {c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}
FOLDED, PLAIN_OF = "".join(_ONE) + _MARKS, "".join(_ONE.values())
SEVERAL_TABLE = "\x01".join(f"{c}\x02{p}" for c, p in SEVERAL.items())
#: The letters of SEVERAL, run by run.
SEVERAL_CLASS = "[" + "".join(
    f"{chr(min(run))}-{chr(max(run))}" for run in ([*map(ord, [c for _, c in g])] for _, g in groupby(enumerate(sorted(SEVERAL)), lambda x: ord(x[1]) - x[0]))
) + "]"
#: Language names as sources write them, folded, and the name that is kept.
LANGUAGE_NAMES = {
    "espanol": "Español",
    "castellano": "Español",
    "english": "Inglés",
    "ingles": "Inglés",
    "portugues": "Portugués",
    "portuguese": "Portugués",
}


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out once per row, however often f names it."""
    return F.transform(F.array(value), lambda x: f(x))[0]


def look_up(table: dict, key: Column) -> Column:
    """The table's value for a key, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def is_blank(c: Column) -> Column:
    """The one meaning of "missing": null, or nothing but spaces."""
    return c.isNull() | (F.trim(c) == "")


def filled(c: Column) -> Column:
    """c where it is not missing, else null."""
    return F.when(~is_blank(c), c)


def first_filled(*columns: Column) -> Column:
    """The first column that is not missing, else the empty string."""
    return F.coalesce(*[filled(c) for c in columns], F.lit(""))


def collapse(c: Column) -> Column:
    """White space becomes single spaces: each kind by a plain replacement, runs by a pattern."""
    for other in "\t\n\x0B\f\r":
        c = F.replace(c, F.lit(other), F.lit(" "))
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def decode_entities(c: Column) -> Column:
    """Character references as their characters, each once, as HTML 5 reads them: by number or name, also without a semicolon.

    What is none of them stays; references to spaces become a plain space.
    """

    def joined(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.concat(parts[0], F.array_join(F.transform(rest, decoded), ""))

    return F.when(c.contains("&"), let(F.split(c, "&"), joined)).otherwise(c)


def decoded(part: Column) -> Column:
    """The text behind an ampersand, with the ampersand or what both stand for."""
    table = F.str_to_map(F.lit(ENTITY_TABLE), F.lit("\x01"), F.lit("\x02"))  # one literal, folded to a map once
    behind = lambda name: F.substr(part, F.length(name) + 1)

    def found(name: Column) -> Column:
        bare = F.regexp_extract(name, BARE, 1)
        by_name = F.coalesce(
            F.concat(F.try_element_at(table, F.reverse(name)), behind(name)),
            F.when(bare != "", let(bare, lambda b: F.concat(F.try_element_at(table, F.reverse(b)), behind(b)))),
        )
        return F.when(name.startswith("#"), F.concat(numbered(name), behind(name))).when(name != "", by_name)

    name = F.regexp_extract(part, r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <#;]{1,32};?)", 1)
    return F.coalesce(let(name, found), F.concat(F.lit("&"), part))


def numbered(name: Column) -> Column:
    """The character of ``#233;`` or ``#xE9``; nothing for numbers that mean none, U+FFFD for those that cannot."""

    def character(n: Column) -> Column:
        none = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFF) >= 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.isin(SPACES), " ")
            .when(n.between(0x80, 0x9F), look_up(CONTROLS, n))
            .when(none, "")
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
        )

    digits = F.concat(F.lit("0"), F.regexp_replace(name, "^#[xX]?0*|;$", ""))
    number = F.when(F.length(digits) > 8, F.lit(0x110000)).when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("int"))
    return let(number.otherwise(digits.cast("int")), character)


def strip_html(c: Column, keep_breaks: bool = False) -> Column:
    """Text without tags; block ends and breaks part words, or stay as line breaks."""
    if not keep_breaks:
        return let(untagged(c), plain)
    text = let(untagged(c, ""), decode_entities)
    lines = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(lines, r"\n{3,}", "\n\n"), F.lit(" \n"))


def untagged(c: Column, between: str = " ") -> Column:
    """The first half of strip_html(): breaks as line breaks, other tags as what stands between texts."""
    broken = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<(?:br\s*/?|/(?:p|div|li|tr|h1|h2|h3)\s*)>", "\n")
    return F.regexp_replace(broken, r"<[^>]+>", between)


def plain(c: Column) -> Column:
    """The second half, of a column, as it is named several times: references decoded, white space collapsed."""
    return collapse(decode_entities(c))


def clean_text(c: Column) -> Column:
    """No-break spaces become spaces, invisible characters go, white space collapses."""
    visible = F.regexp_replace(F.coalesce(c, F.lit("")), "[​-‏‪-‮⁠﻿]", "")
    return F.trim(F.regexp_replace(visible, r"(?U)\s+", " "))


def clean_paragraphs(c: Column) -> Column:
    """Each line cleaned, empty ones dropped, line breaks kept."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first and small letters behind: ``O'NEILL-DÍAZ`` to ``O'Neill-Díaz``."""
    apart = F.regexp_replace(c, r"(?<=[^\p{L}])(?=\p{L})", "\x01 ")
    return F.regexp_replace(F.initcap(apart), "\x01 ", "")


def titleish(c: Column) -> Column:
    """All-capital text of four or more characters in title case, other text as it is."""
    t = F.trim(F.coalesce(c, F.lit("")))
    shouting = (F.length(t) >= 4) & (t == F.upper(t)) & (t != F.lower(t))
    return F.when(shouting, title_case(t)).otherwise(t)


def fold_accents(c: Column) -> Column:
    """Letters without their accents, by compatibility decomposition: also ligatures, full-width letters and loose marks.

    Texts of ASCII are what they are; only those with a letter that becomes several are taken letter by letter.
    """
    one = F.translate(c, FOLDED, PLAIN_OF)
    table = F.str_to_map(F.lit(SEVERAL_TABLE), F.lit("\x01"), F.lit("\x02"))  # one literal, folded to a map once
    each = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    return F.when(F.length(c) == F.octet_length(c), c).when(c.rlike(SEVERAL_CLASS), each).otherwise(one)


def normalize_language(c: Column) -> Column:
    return let(titleish(c), language_named)


def language_named(t: Column) -> Column:
    """The kept name of a language, by a titleish() name."""
    return F.coalesce(look_up(LANGUAGE_NAMES, F.regexp_replace(fold_accents(F.lower(t)), "[^a-z]+", "")), t)


def normalize_title(c: Column, fold: bool = True) -> Column:
    """Lower-case words for comparison; null where nothing is left."""
    t = F.lower(c)
    t = fold_accents(t) if fold else t
    kept = "[^a-z0-9]+" if fold else "[^a-z0-9áéíóúñü]+"
    return F.nullif(F.trim(F.regexp_replace(t, kept, " ")), F.lit(""))


def normalize_label(c: Column) -> Column:
    """Keys of label/value sheets."""
    t = F.regexp_replace(fold_accents(F.lower(F.trim(F.coalesce(c, F.lit(""))))), "[^a-z0-9 ]+", "")
    return collapse(t)


def dedupe_repeated(c: Column) -> Column:
    """``A B A B`` to ``A B``, ``XYZXYZ`` to ``XYZ``."""
    return F.regexp_replace(clean_text(c), r"^(.+?)\s*\1$", "$1")


def slugify(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))


def ordered_distinct(c: Column) -> Column:
    """Array without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def sorted_distinct(c: Column) -> Column:
    return F.array_sort(ordered_distinct(c))


def head(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def byte_profile(c: Column) -> tuple[Column, Column]:
    """Hex of the UTF-8 bytes, and the number of characters."""
    return F.hex(F.encode(c, "UTF-8")), F.length(c)
