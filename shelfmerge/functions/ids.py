"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmerge.functions.text import let


def normalize_isbn(c: Column) -> Column:
    """Upper-case digits and X; a whole number written as a float loses its fraction."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^(\d+)\.0+$", "$1")
    return F.regexp_replace(F.upper(t), "[^0-9X]", "")


def is_isbn(c: Column, strict: bool = False) -> Column:
    """Ten or thirteen characters after cleaning; strictly, digits with an X only at the end of ten."""
    n = normalize_isbn(c)
    return n.rlike("^([0-9]{13}|[0-9]{9}[0-9X])$") if strict else F.length(n).isin(10, 13)


def weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of the digits by weight."""
    total = F.lit(0)
    for k, w in enumerate(weights):
        total = total + F.substring(digits, k + 1, 1).try_cast("int") * w
    return total


def short_form(n: Column) -> Column:
    """The ten-digit form of a cleaned 978 number, else empty."""
    check = F.substring(F.lit("0123456789X"), (weighted(F.substring(n, 4, 9), list(range(1, 10))) % 11 + 1).cast("int"), F.lit(1))
    return F.when(n.rlike("^978[0-9]{9}[0-9X]$"), F.concat(F.substring(n, 4, 9), check)).otherwise("")


def long_form(n: Column) -> Column:
    """The thirteen-digit form of a cleaned ten-digit number, else empty."""
    check = (10 - (38 + weighted(n, [3, 1] * 4 + [3])) % 10) % 10  # 38: the weighted sum of 978
    return F.when(n.rlike("^[0-9]{9}[0-9X]$"), F.concat(F.lit("978"), F.substring(n, 1, 9), check.cast("string"))).otherwise("")


def isbn13_to_isbn10(c: Column) -> Column:
    """The ten-digit form of a 978 number, else empty."""
    return let(normalize_isbn(c), short_form)


def isbn10_to_isbn13(c: Column) -> Column:
    """The thirteen-digit form; the old check digit is not verified."""
    return let(normalize_isbn(c), long_form)


def isbn_candidates(c: Column) -> Column:
    """The number and its other form, distinct, in this order."""
    other = lambda n: F.when(F.length(n) == 13, short_form(n)).otherwise(long_form(n))
    return let(normalize_isbn(c), lambda n: F.array_distinct(F.filter(F.array(n, other(n)), lambda x: x != "")))


def isbn_from_url(c: Column, rule: str = "run") -> Column:
    """From a url: the part after /book/, the last but one path segment, or a lone run of 10 to 13 digits."""
    if rule == "book":
        return F.regexp_extract(c, r"/book/([0-9Xx]{10,13})", 1)
    if rule == "segment":
        path = F.split(F.btrim(F.regexp_extract(c, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")), "/+")
        return F.when(F.size(path) >= 3, F.regexp_replace(F.element_at(path, -2), "[^0-9Xx]", "")).otherwise("")
    return F.regexp_extract(c, r"(?<!\d)(\d{10,13})(?!\d)", 1)


def search_url(isbn: Column) -> Column:
    return F.concat(F.lit("https://www.amazon.com/s?k="), isbn, F.lit("&i=stripbooks"))
