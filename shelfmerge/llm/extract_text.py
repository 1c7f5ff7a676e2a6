"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. Places that never hold the
article (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts)
give no lines. A line has the length of its text outside links, and none if it is
mostly links. A window of three lines slides over these lengths; where its sum surges
past the threshold a stretch begins, with the short lines that lead up to it; at the
dive back to nothing it ends, and all lines between are kept. The threshold is
``SURGE`` characters, or ``SHARE`` of the page's fullest window where that is less, so
short articles count. Behind a dive a stretch goes on with the next line of the element
that held its last one, so links in an article do not cut off its end.

The mark of an article is a prior on the lengths: a line inside counts ``PRIOR`` times,
its links as text, and of a stretch on a page with a mark only lines inside are kept.

The page is read forward once. Elements left open end with the element around them;
an article is never part of a menu or advert, so its start ends those still open. A tag
whose quotes do not close ends at the next ``>``.

Defined results: null or empty html gives an empty text; a page without a stretch gives
an empty text; repeated rows are extracted each; a tag that never ends is text; numbers
of characters that cannot be are U+FFFD.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmerge.llm.common import in_text_batches

WINDOW = 3
#: Characters that a stretch must surge past at most, and what share of the fullest window is enough.
SURGE = 80
SHARE = 0.25
#: How many times a line inside the mark of an article counts.
PRIOR = 4
#: Share of a line's characters in links from which it counts as a menu's.
LINKED = 0.6
#: Tags of a page whose quotes may be looked for to its end; further ones end at the next ``>``.
BROKEN = 64

TAG = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
SIMPLE = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>[^>]*+)>")
BEGINS = re.compile(r"</?[a-zA-Z]")
RAW = set("script style noscript template textarea iframe svg math object title".split())
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("nav header footer aside form menu dialog button select head fieldset".split())
#: Class names, ids and roles of elements that hold no text of the article, wherever they stand: whole, or as their last part, or before HOLDERS.
FOREIGN = set(
    "ad ads adv advert advertisement adverts advertising adsense sponsor sponsored comment comments disqus share sharing "
    "newsletter subscribe signup login cookie cookies consent gdpr".split()
)
#: As FOREIGN, but only outside a marked article.
BESIDE = FOREIGN | set(
    "sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead pagination pager toolbar".split()
)
#: Whole class names, ids and roles that do the same outside a marked article.
WHOLE = set(
    "promo banner notice notices alert header reply replies social related recommended popup modal widget search "
    "complementary contentinfo".split()
)
#: Parts of names that only say that something is held there.
HOLDERS = set(
    "area banner bar block bottom box button buttons code container content form holder icon icons inline inner item items left link links list "
    "main middle modal notice outer overlay panel popup right section slot space text thread title top unit widget widgets wrap wrapper zone".split()
)
#: Elements that hold an article's blocks.
KEEPS = set("div section article main td blockquote center".split())
#: Class names that begin so tell of an element beside, and are on the one around it.
AROUND = ("with", "has", "no", "without", "show", "hide")
CUTS_P = set("p div ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote section article main dl dt dd hr form".split())


def is_beside(tag: str, attrs: str, inside: bool) -> bool:
    if tag in NEVER:
        return True
    if "=" not in attrs or tag in ("article", "main", "body", "html"):
        return False
    for value in NAMES.findall(attrs):
        for token in value.strip("\"'").lower().split():
            parts = re.split(r"[^a-z0-9]+", token)
            if parts[0] in AROUND:
                continue
            if named(parts, FOREIGN) or not inside and (token in WHOLE or named(parts, BESIDE)):
                return True
    return False


def named(parts: list[str], words: set[str]) -> bool:
    """Whether a name is of these words: ``comments``, ``post-comments``, ``comment-list``, but not ``comment-analysis``."""
    parts = [p for p in parts if p]
    return bool(parts) and (parts[-1] in words or parts[0] in words and all(p in HOLDERS or p in words or p.isdigit() for p in parts[1:]))


class Lines:
    """The lines of a page: text, length outside links, length, whether each lies in the article, and the element that keeps it (0: the page)."""

    def __init__(self, page: str):
        self.rows: list[tuple[str, int, int, bool, int]] = []
        self.keepers: list[int] = [0]
        self.kept = 0
        self.open: list[tuple[str, bool]] = []
        self.opened: Counter[str] = Counter()
        self.beside = self.article = self.link = 0
        self.parts: list[str] = []
        self.linked = 0
        self.marked = False
        self.read(page)
        self.line()

    def read(self, page: str) -> None:
        at, look, broken, last = 0, 0, 0, page.rfind(">")
        while (lt := page.find("<", look)) >= 0:
            if page.startswith("<!--", lt):
                self.add(page[at:lt])
                end = page.find("-->", lt + 4)
                at = look = end + 3 if end >= 0 else len(page)
                continue
            if lt > last:
                look = lt + 1
                continue
            if page.startswith(("<!", "<?"), lt):
                self.add(page[at:lt])
                at = look = page.find(">", lt) + 1
                continue
            m = BEGINS.match(page, lt) and (broken < BROKEN and TAG.match(page, lt) or SIMPLE.match(page, lt))
            if not m:
                look = lt + 1
                continue
            broken += m.re is SIMPLE
            self.add(page[at:lt])
            at, tag = m.end(), m["tag"].lower()
            if tag in RAW and not m["end"]:
                self.line()
                stop = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            else:
                (self.end if m["end"] else self.start)(tag, m["attrs"])
            look = at
        self.add(page[at:])

    def add(self, text: str) -> None:
        if text and not self.beside:
            text = entities.unescape(NUMBER.sub("\ufffd", text)) if "&" in text else text
            self.parts.append(text)
            if self.link:
                self.linked += len("".join(text.split()))

    def line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            solid = len(text.replace(" ", ""))
            free = solid - self.linked
            self.rows.append((text, free if free > (1 - LINKED) * solid else 0, solid, self.article > 0, self.keepers[-1]))
        self.parts, self.linked = [], 0

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.add(" ")
            return
        if tag not in INLINE:
            self.line()
        if tag in EMPTY:
            return
        if tag in ("article", "main"):
            while self.beside:
                self.close()
        if tag in CUTS_P and any(t == "p" for t, _ in self.open[-8:]):
            self.end("p", "")
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self.end("li", "")
        beside = is_beside(tag, attrs, self.article > 0)
        if beside:
            self.line()
        if tag in KEEPS:
            self.kept += 1
            self.keepers.append(self.kept)
        self.open.append((tag, beside))
        self.opened[tag] += 1
        self.beside += beside
        self.article += tag in ("article", "main")
        self.marked |= tag in ("article", "main")
        self.link += tag == "a"

    def end(self, tag: str, _: str) -> None:
        if tag not in INLINE:
            self.line()
        if self.opened[tag]:
            while self.close() != tag:
                pass

    def close(self) -> str:
        tag, beside = self.open.pop()
        self.opened[tag] -= 1
        if beside or tag in KEEPS:
            self.line()
        if tag in KEEPS:
            self.keepers.pop()
        self.beside -= beside
        self.article -= tag in ("article", "main")
        self.link -= tag == "a"
        return tag


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points, one line a block."""
    found = Lines(page or "")
    if not found.rows:
        return ""
    length = np.array([PRIOR * solid if inside else free for _, free, solid, inside, _ in found.rows], np.int64)
    inside = np.array([r[3] for r in found.rows]) if found.marked else np.ones(len(length), bool)
    keeper = [r[4] for r in found.rows]
    sums = np.convolve(length, np.ones(window, np.int64))[window - 1 :]
    # on a page with a mark the fullest window is one of its own
    least = min(surge, SHARE * np.convolve(np.where(inside, length, 0), np.ones(window, np.int64)).max())
    solid = np.flatnonzero(length)
    out, k, done = [], 0, 0
    while k < len(sums):
        if not length[k] or sums[k] < least:
            k += 1
            continue
        first, stop = k, k
        while first > done and length[first - 1]:  # short lines that lead up to the surge
            first -= 1
        taken = range(first, first)
        while True:
            while stop < len(sums) and sums[stop]:
                stop += 1
            done = stop if stop == len(sums) else int(solid[np.searchsorted(solid, stop) - 1]) + 1
            out += [found.rows[j][0] for j in range(max(first, taken.stop), done) if inside[j]]
            taken = range(first, done)
            # behind the dive: the next line that is no link, if the element of the last one keeps it too
            after = int(np.searchsorted(solid, done))
            if after == len(solid) or not keeper[done - 1] or keeper[solid[after]] != keeper[done - 1]:
                break
            first = stop = int(solid[after])
            taken = range(first, first)
        k = max(stop, k + 1)
    return "\n".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    return in_text_batches(
        pages.select("page_id", "url", "html"), text_rows, "page_id bigint, url string, text string, n_chars bigint"
    )


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )
