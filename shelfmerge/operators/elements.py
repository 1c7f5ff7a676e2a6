"""An element tree of a page, read forward once, and selectors over it.

Steps of a selector are compound, as in style sheets: ``tag#id.class[name]``,
``[name=value]`` with ``=``, ``^=`` (begins with) or ``*=`` (holds); the name ``:inner``
is what the element holds. ``{a|b}`` asks that its text is one of these labels, ``{~a|b}``
that it holds one, ``{a:}`` that it begins with the label and a colon, and what follows
the colon is the value; case, accents and signs at the ends do not count. Steps stand
below each other (space), directly below (``>``) or next to each other (``+``); ``A ^ B``
is B under the nearest of six ancestors of A that has one. ``A ..`` is what follows A in
its parent, ``A ..{p|div}`` that up to the next element of these tags. At the end
``@name`` takes an attribute, ``!x|y`` leaves out elements of these classes, and ``(n)``
the n-th of all found, from 0; ``(*)`` gives all, with PARTED between.
"""

from __future__ import annotations

import functools
import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTED = "\x1f"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: Elements that a tag ends where it finds them open just above.
ENDS = {
    "li": {"li"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
}
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
#: Ancestors that ``^`` looks at.
CLIMB = 6


SIGNS = re.compile(r"^[\W_]+|[\W_]+$")
MARKUP = re.compile(r"<[^>]*>")
COLON = re.compile(r"(?:<[^>]*+>|[^<:])*+:")


@functools.lru_cache(1 << 12)
def folded(text: str) -> str:
    """Without case, accents and signs at the ends; labels come again on every page."""
    plain = text.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    return SIGNS.sub("", " ".join(plain.split()))


class Page:
    """Elements in order of their start: tag, attributes, parent, where they and what they hold begin and end, and their last descendant."""

    def __init__(self, html: str):
        self.html = html
        self.tag, self.raw, self.parent = [""], [""], [-1]
        self.start, self.inner, self.end, self.after, self.last = [0], [0], [len(html)], [len(html)], [0]
        self.kept: dict[int, dict[str, str]] = {}
        self.of_tag: dict[str, list[int]] = {}
        self.read()

    def read(self) -> None:
        html, at, open_, held = self.html, 0, [0], {"": 1}
        final = {q: html.rfind(q) for q in "\"'"}
        while (lead := html.find("<", at)) >= 0:
            if html.startswith("<!--", lead):
                stop = html.find("-->", lead + 4)
                at = stop + 3 if stop >= 0 else len(html)
                continue
            name = NAME.match(html, lead + 1)
            if not name:
                at = lead + 1
                continue
            stop = self.tag_end(name.end(), final)
            tag = name[2].lower()
            if name[1]:
                if held.get(tag):
                    while True:
                        node = open_.pop()
                        held[self.tag[node]] -= 1
                        self.close(node, lead, stop if self.tag[node] == tag else lead)
                        if self.tag[node] == tag:
                            break
            else:
                while self.tag[open_[-1]] in ENDS.get(tag, ()):
                    node = open_.pop()
                    held[self.tag[node]] -= 1
                    self.close(node, lead, lead)
                node = len(self.tag)
                raw = html[name.end() : max(name.end(), stop - 1)]
                self.of_tag.setdefault(tag, []).append(node)
                self.tag.append(tag)
                self.raw.append(raw)
                self.parent.append(open_[-1])
                self.start.append(lead)
                self.inner.append(stop)
                self.end.append(stop)
                self.after.append(stop)
                self.last.append(node)
                if tag in RAW:
                    close = re.compile(rf"</{tag}\b", re.I).search(html, stop)
                    end = close.start() if close else len(html)
                    far = html.find(">", end)
                    stop = far + 1 if close and far >= 0 else len(html)
                    self.close(node, end, stop)
                elif tag not in VOID and not raw.endswith("/"):
                    open_.append(node)
                    held[tag] = held.get(tag, 0) + 1
            at = stop
        for node in open_:
            self.close(node, len(html), len(html))

    def tag_end(self, at: int, final: dict[str, int]) -> int:
        """Behind the > that ends a tag; one within quotes that are closed does not."""
        html = self.html
        while True:
            stop = html.find(">", at)
            if stop < 0:
                return len(html)
            p, q = html.find('"', at, stop), '"'
            if 0 <= (other := html.find("'", at, stop if p < 0 else p)):
                p, q = other, "'"
            if p < 0:
                return stop + 1
            if html[p - 1] != "=" and html[at:p].rstrip()[-1:] != "=" or final[q] <= p:
                at = p + 1  # no value begins here, or it never ends
                continue
            at = html.find(q, p + 1) + 1

    def close(self, node: int, end: int, after: int) -> None:
        self.end[node], self.after[node], self.last[node] = end, after, len(self.tag) - 1

    def attributes(self, node: int) -> dict[str, str]:
        if node not in self.kept:
            found = {}
            for m in ATTRIBUTE.finditer(self.raw[node]):
                value = next((x for x in m.groups()[1:] if x is not None), "")
                found.setdefault(m[1].lower(), entities.unescape(value))
            self.kept[node] = found
        return self.kept[node]

    def held(self, node: int) -> str:
        return self.html[self.inner[node] : self.end[node]]

    def text(self, node: int) -> str:
        held = self.held(node)
        return entities.unescape(MARKUP.sub(" ", held) if "<" in held else held)

    def next(self, node: int) -> int:
        """The next element of the same parent, or -1."""
        after = self.last[node] + 1
        return after if after < len(self.tag) and self.parent[after] == self.parent[node] else -1


@dataclass(frozen=True)
class Step:
    """One compound, and how it stands to the step before."""

    to: str
    tag: str = ""
    needs: tuple[tuple[str, str, str], ...] = ()
    labels: tuple[str, ...] = ()
    how: str = ""

    def fits(self, page: Page, node: int) -> bool:
        if self.tag and page.tag[node] != self.tag:
            return False
        if self.needs:
            raw = page.raw[node]
            for name, op, value in self.needs:
                if name == ":inner":
                    has = page.held(node)
                elif value in raw or "&" in raw:
                    has = page.attributes(node).get(name)
                else:  # it stands nowhere in the tag, so there is no need to read its attributes
                    return False
                if has is None:
                    return False
                if op == "." and value not in has.split():
                    return False
                if (op == "=" and has != value) or (op == "^=" and not has.startswith(value)) or (op == "*=" and value not in has):
                    return False
        if not self.labels:
            return True
        text = page.text(node)
        if self.how == ":":
            lead, colon, _ = text.partition(":")
            return bool(colon) and folded(lead) in self.labels
        text = folded(text)
        return any(x in text for x in self.labels) if self.how == "~" else text in self.labels


@dataclass(frozen=True)
class Selector:
    steps: tuple[Step, ...]
    rest: tuple[str, ...] | None = None
    attribute: str = ""
    without: tuple[str, ...] = ()
    nth: int | None = 0
    every: dict = field(default_factory=dict, compare=False)


PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[\s*(:?[\w-]+)\s*(?:([*^]?=)\s*\"?([^\]\"]*)\"?)?\s*\]|\{(~?)([^}]*?)(:?)\}")
ENDING = re.compile(r"\s*(?:\((\d+|\*)\)|!([\w|-]+)|@([\w-]+)|\.\.(?:\{([\w|]+)\})?)$")


@functools.cache
def selector(text: str) -> Selector:
    """The selector that a text says; an unreadable one is an error."""
    nth, without, attribute, rest = 0, (), "", None
    while m := ENDING.search(text):
        if m[1]:
            nth = None if m[1] == "*" else int(m[1])
        elif m[2]:
            without = tuple(m[2].split("|"))
        elif m[3]:
            attribute = m[3].lower()
        else:
            rest = tuple((m[4] or "").split("|")) if m[4] else ()
        text = text[: m.start()]
    steps, at, to = [], 0, " "
    text = text.strip()
    while at < len(text):
        if m := re.compile(r"\s*([>+^])\s*|\s+").match(text, at):
            to, at = m[1] or " ", m.end()
        m = re.compile(r"[\w-]*").match(text, at)
        tag, at, needs, labels, how = m[0].lower(), m.end(), [], (), ""
        while p := PART.match(text, at):
            at = p.end()
            if p[1] or p[2]:
                needs.append(("id", "=", p[1]) if p[1] else ("class", ".", p[2]))
            elif p[3]:
                needs.append((p[3].lower(), p[4] or "", p[5] or ""))
            else:
                labels, how = tuple(folded(x) for x in p[7].split("|")), p[6] or p[8]
        if not (tag or needs or labels):
            raise ValueError(f"what is meant by {text[at:]!r}?")
        steps.append(Step(to, tag, tuple(needs), labels, how))
        to = " "
    return Selector(tuple(steps), rest, attribute, without, nth)


def among(page: Page, tag: str, begin: int, end: int) -> Sequence[int]:
    """The elements from begin up to end, without it, in order; with a tag, only those of it."""
    if not tag:
        return range(begin, end)
    own = page.of_tag.get(tag, [])
    return own[bisect_left(own, begin) : bisect_left(own, end)]


def below(page: Page, node: int, step: Step) -> list[int]:
    return [n for n in among(page, step.tag, node + 1, page.last[node] + 1) if step.fits(page, n)]


def matches(page: Page, wanted: Selector) -> list[int]:
    """The elements that a selector means, in order, each once; every step looks at each element once."""
    now = [0]
    for step in wanted.steps:
        found: list[int] = []
        if step.to == " ":
            upto = 0
            for n in now:  # in order, so what lies within an earlier one has been seen
                for k in among(page, step.tag, max(n + 1, upto), page.last[n] + 1):
                    if step.fits(page, k):
                        found.append(k)
                upto = max(upto, page.last[n] + 1)
        elif step.to == ">":
            parents = set(now)
            found = [k for k in among(page, step.tag, 1, len(page.tag)) if page.parent[k] in parents and step.fits(page, k)]
        elif step.to == "+":
            found = sorted({k for n in now if (k := page.next(n)) >= 0 and step.fits(page, k)})
        else:
            for n in now[:1]:
                up = page.parent[n]
                for _ in range(CLIMB):
                    if up < 0 or (found := below(page, up, step)):
                        break
                    up = page.parent[up]
        now = found
        if not now:
            break
    return now


def value_of(page: Page, node: int, wanted: Selector) -> str:
    if wanted.attribute:
        return page.attributes(node).get(wanted.attribute, "")
    last = wanted.steps[-1]
    begin, end = page.inner[node], page.end[node]
    if wanted.rest is not None:
        up = page.parent[node]
        begin, end, k = page.after[node], page.end[up], page.next(node)
        while wanted.rest and k >= 0:
            if page.tag[k] in wanted.rest:
                end = page.start[k]
                break
            k = page.next(k)
    elif last.how == ":":
        colon = COLON.match(page.html, begin, end)
        begin = colon.end() if colon else begin
    out = page.html[begin:end]
    if wanted.without:
        parts, at, k = [], begin, node + 1
        while k <= page.last[page.parent[node] if wanted.rest is not None else node]:
            if page.start[k] >= at and page.after[k] <= end and set(page.attributes(k).get("class", "").split()) & set(wanted.without):
                parts.append(page.html[at : page.start[k]])
                at, k = page.after[k], page.last[k]
            k += 1
        out = "".join([*parts, page.html[at:end]])
    return out


def select(page: Page, text: str) -> str:
    """What a selector finds in a page; nothing is an empty text."""
    wanted = selector(text)
    found = matches(page, wanted)
    if wanted.nth is None:
        return PARTED.join(value_of(page, n, wanted) for n in found)
    return value_of(page, found[wanted.nth], wanted) if wanted.nth < len(found) else ""


def select_all(pages: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """pages (page_id, url, html) with columns s0, s1, ... of what the selectors find, page by page in Arrow batches."""
    for s in selectors:
        selector(s)
    rows = pages.select("page_id", "url", "html")
    form = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c != "html"] + [f"s{k} string" for k in range(len(selectors))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[str]] = [[] for _ in selectors]
            for html in batch.column("html").to_pylist():
                page = Page(html or "")
                for column, s in zip(found, selectors, strict=True):
                    column.append(select(page, s))
            columns = [batch.column("page_id"), batch.column("url"), *(pa.array(c, pa.string()) for c in found)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", *(f"s{k}" for k in range(len(selectors)))])

    return rows.mapInArrow(run, form)


def first_filled(found: Sequence):
    """The first of several columns that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in found], F.lit(""))
