"""DuckDB texts of the expressions, for the oracles."""

from __future__ import annotations

from shelfmerge.functions.text import ACCENTED, LANGUAGE_NAMES, PLAIN
from shelfmerge.functions.values import BINDINGS, MONTHS, NO_BINDING, NO_COVER, STOP_EN, STOP_ES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def blank(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def fold(c: str) -> str:
    return f"translate({c}, {q(ACCENTED)}, {q(PLAIN)})"


def strip_html(c: str) -> str:
    broken = f"regexp_replace(coalesce({c}, ''), '(?i)<br\\s*/?>|</(p|div|li|tr|h1|h2|h3)\\s*>', chr(10), 'g')"
    t = f"regexp_replace({broken}, '<[^>]+>', ' ', 'g')"
    for a, b in [("&nbsp;?", " "), ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;?", "'"), ("&apos;", "'"), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")]:
        t = f"regexp_replace({t}, {q(a)}, {q(b)}, 'g')"
    return collapse(t)


def initcap(t: str) -> str:
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


def title_case(t: str) -> str:
    words = f"string_split(regexp_replace({t}, '([^\\pL])(\\pL)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"array_to_string(list_transform({words}, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"


def titleish(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    return f"CASE WHEN length({t}) >= 4 AND {t} = upper({t}) AND {t} <> lower({t}) THEN {title_case(t)} ELSE {t} END"


def language(c: str) -> str:
    key = f"regexp_replace({fold(f'lower({titleish(c)})')}, '[^a-z]+', '', 'g')"
    arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in LANGUAGE_NAMES.items())
    return f"CASE {key} {arms} ELSE {titleish(c)} END"


def isbn(c: str) -> str:
    return f"regexp_replace(upper(regexp_replace(trim(coalesce({c}, '')), '^(\\d+)\\.0+$', '\\1')), '[^0-9X]', '', 'g')"


def digit(c: str, i: int) -> str:
    return f"CAST(substr({c}, {i}, 1) AS INT)"


def to10(n: str) -> str:
    core = f"substr({n}, 4, 9)"
    r = "(" + " + ".join(f"{i} * {digit(core, i)}" for i in range(1, 10)) + ") % 11"
    return f"CASE WHEN regexp_matches({n}, '^978[0-9]{{9}}[0-9X]$') THEN {core} || CASE WHEN {r} = 10 THEN 'X' ELSE CAST({r} AS VARCHAR) END ELSE '' END"


def to13(n: str) -> str:
    core = f"('978' || substr({n}, 1, 9))"
    r = "(10 - (" + " + ".join(f"{3 if i % 2 == 0 else 1} * {digit(core, i)}" for i in range(1, 13)) + ") % 10) % 10"
    return f"CASE WHEN regexp_matches({n}, '^[0-9]{{9}}[0-9X]$') THEN {core} || CAST({r} AS VARCHAR) ELSE '' END"


def binding(c: str) -> str:
    v = f"trim(coalesce({c}, ''))"
    kept = f"trim(regexp_replace({v}, '\\s*\\([^)]*\\)\\s*', '', 'g'))"
    low = collapse(f"lower({fold(kept)})")
    arms = "".join(f" WHEN regexp_matches({low}, {q('|'.join(texts))}) THEN {q(name)}" for name, texts in BINDINGS)
    return f"CASE WHEN {v} IN {among(NO_BINDING)} THEN ''{arms} WHEN {low} IN ('de bolsillo', 'bolsillo') THEN 'De Bolsillo' ELSE {kept} END"


def ext(c: str, form: str, k: int) -> str:
    return f"regexp_extract({c}, {q(form)}, {k})"


def iso(y: str, m: str, d: str) -> str:
    return f"lpad({y}, 4, '0') || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0')"


def date(c: str) -> str:
    t = titleish(c)
    dmy, ymd = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})\s*$", r"^\s*(\d{4})[/-](\d{1,2})[/-](\d{1,2})\s*$"
    return (
        f"CASE WHEN regexp_matches({t}, {q(dmy)}) THEN {iso(ext(t, dmy, 3), ext(t, dmy, 2), ext(t, dmy, 1))} "
        f"WHEN regexp_matches({t}, {q(ymd)}) THEN {iso(ext(t, ymd, 1), ext(t, ymd, 2), ext(t, ymd, 3))} ELSE {t} END"
    )


def month_date(c: str) -> str:
    t = f"trim(coalesce({c}, ''))"
    df = r"(?i)^(\d{1,2})\s+(?:de\s+)?([a-záéíóúñ]+)\s+(?:de\s+)?(\d{4})$"
    mf = r"(?i)^([a-záéíóúñ]+)\s+(\d{1,2}),?\s+(\d{4})$"

    def month(x: str) -> str:
        return f"CASE {fold(f'lower({x})')} " + " ".join(f"WHEN {q(k)} THEN '{v}'" for k, v in MONTHS.items()) + " END"

    a, b = month(ext(t, df, 2)), month(ext(t, mf, 1))
    return (
        f"CASE WHEN regexp_matches({t}, {q(df)}) AND ({a}) IS NOT NULL THEN {iso(ext(t, df, 3), f'({a})', ext(t, df, 1))} "
        f"WHEN regexp_matches({t}, {q(mf)}) AND ({b}) IS NOT NULL THEN {iso(ext(t, mf, 3), f'({b})', ext(t, mf, 2))} ELSE {t} END"
    )


def pages(c: str) -> str:
    t = strip_html(c)
    n = f"TRY_CAST(regexp_extract({t}, '(\\d+)', 1) AS INT)"
    return f"CASE WHEN {n} IS NULL THEN {t} ELSE CAST({n} AS VARCHAR) || ' págs' END"


def dimensions(c: str) -> str:
    t = collapse(f"regexp_replace({strip_html(c)}, '\\s*[xX]\\s*', ' x ', 'g')")
    form = r"(\d+(?:[.,]\d+)?) x (\d+(?:[.,]\d+)?)"
    base = f"replace({ext(t, form, 1)}, ',', '.') || ' x ' || replace({ext(t, form, 2)}, ',', '.')"
    unit = r"(?i)\b(cm|mm|in|inch|pulgadas)\b"
    return (
        f"CASE WHEN NOT regexp_matches({t}, {q(form)}) THEN {t} WHEN regexp_matches({t}, {q(unit)}) "
        f"THEN regexp_replace(replace({t}, {ext(t, form, 0)}, {base}), '(?i)\\bcm\\b', 'cm', 'g') ELSE {base} || ' cm' END"
    )


def placeholder(c: str) -> str:
    u = f"lower({collapse(f'coalesce({c}, chr(32))')})"
    arms = "".join(f" WHEN contains({u}, {q(p)}) THEN {q('pattern:' + p)}" for p in NO_COVER)
    path = f"regexp_extract({u}, '^(?:[a-z]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
    last = f"regexp_extract({path}, '([^/]*)$', 1)"
    return f"CASE WHEN {u} = '' THEN NULL WHEN starts_with({u}, 'data:') THEN 'data_uri'{arms} WHEN {last} <> '' AND NOT contains({last}, '.') THEN 'no_extension' END"


def language_scores(c: str) -> tuple[str, str]:
    """Spanish and English scores of a text."""
    t = f"lower({collapse(f'coalesce({c}, chr(32))')})"
    words = f"regexp_extract_all({t}, '[a-záéíóúñ]+')"
    count = lambda stop: f"CAST(len(list_filter({words}, lambda w: w IN {among(stop)})) AS DOUBLE)"
    accents = f"length({t}) - length(regexp_replace({t}, '[áéíóúñ]', '', 'g'))"
    return f"({count(STOP_ES)} + least(3, {accents}) * 0.75)", f"({count(STOP_EN)})"


def guess(es: str, en: str) -> tuple[str, str]:
    """Language and confidence from the names of score columns."""
    none = f"(({es} < 2 AND {en} < 2) OR {es} = {en})"
    return (
        f"CASE WHEN {none} THEN '' WHEN {es} > {en} THEN 'Español' ELSE 'Inglés' END",
        f"CASE WHEN {none} THEN 0.0 ELSE abs({es} - {en}) / greatest({es}, {en}, 1.0) END",
    )


def resolve(base: str, link: str) -> str:
    t = f"trim(coalesce({link}, ''))"
    root = f"regexp_extract({base}, '^([a-z]+://[^/?#]*)', 1)"
    folder = f"regexp_extract({base}, '^([a-z]+://[^/?#]*(?:/[^?#]*/|/)?)', 1)"
    return (
        f"CASE WHEN {t} = '' OR regexp_matches({t}, '^[a-z][a-z0-9+.-]*://') THEN {t} "
        f"WHEN starts_with({t}, '//') THEN regexp_extract({base}, '^([a-z]+:)', 1) || {t} WHEN starts_with({t}, '/') THEN {root} || {t} "
        f"WHEN ends_with({folder}, '/') THEN {folder} || {t} ELSE {folder} || '/' || {t} END"
    )


def canonical(c: str) -> str:
    t = f"regexp_replace(trim({c}), '[?#].*$', '')"
    return f"CASE WHEN starts_with({t}, '//') THEN 'https:' || {t} ELSE {t} END"
