"""Removal of repeated passages by overlapping three-line windows.

A line is a sentence or what a physical line holds of it: it ends after a word that
ends with ``.``, ``!`` or ``?``, and at a line feed. Passages are often pasted into
running text, so a line of more than ``LINE_WORDS`` words is cut where its content
says: after a word whose three-word hash is the least of ``NEAR`` words to either
side, and after ``LINE_WORDS`` words at the latest; the cuts fall alike wherever the
passage stands. Two lines are equal if their words are; words are parted by ASCII
white space. All windows of three consecutive lines are hashed (128 bits), however
short. Of all occurrences of a window the one with the smallest (doc_id, text hash,
line) stays; every other covers its three lines, and the union of the covered lines
goes. An occurrence that overlaps the first in the same document covers only the
lines after the first.

A map task decides what it can: an occurrence that is not the least among those it
holds is not the least anywhere, so only one row per task and window meets the others
in a shuffle, however frequent the window. Windows cross it packed by ranges of their
hash; a range holds about ``RANGE`` windows whatever the size of the corpus and of its
texts, whose line ends are counted first, and a reducing task holds one range at a time.

Defined results: null texts stay null, texts of fewer than three lines stay whole;
rows with a null doc_id stay as they are and count as nobody's first; rows that
repeat a doc_id and its text are one document and keep the same lines; rows that
share a doc_id but differ in text are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmerge.llm.common import in_text_batches
from shelfmerge.llm.words import Powers, Words, find_words, mix, run_hashes, text_bytes

LINES = 3
LINE_WORDS = 16
#: Words to either side that a cut inside a long sentence is compared with.
NEAR = 3
#: Windows that a map task holds before it decides what it can; windows of a hash range, about.
HELD = 1 << 20
RANGE = 1 << 20
#: Bytes for which one content cut is reckoned where the number of windows is estimated.
CUT_BYTES = 32
NONE = np.uint64(2**64 - 1)

FIRST, SECOND = Powers(0xC2B2AE3D27D4EB4F), Powers(0xA0761D6478BD642F)


class Lines:
    """The lines of a batch: hashes, where each ends (bytes, the blanks behind it included), and lines per text."""

    def __init__(self, column: pa.Array):
        self.data, self.bounds = text_bytes(column)
        w = find_words(self.data, self.bounds)
        feeds = np.flatnonzero(self.data == 10)
        ends = line_ends(self.data, self.bounds, w, feeds)
        last = np.flatnonzero(ends)
        first = np.r_[0, last[:-1] + 1] if len(last) else last
        self.text = w.text[last]
        self.a = run_hashes(w.hash, first, last + 1, FIRST)
        self.b = run_hashes(w.hash, first, last + 1, SECOND)
        self.upto = np.searchsorted(self.text, np.arange(len(self.bounds)))
        after = np.r_[w.start[1:], len(self.data)] if len(w.start) else w.start
        after = np.minimum(after, self.bounds[w.text + 1])[last]
        k = np.searchsorted(feeds, w.end[last])
        feed = np.r_[feeds, len(self.data)][k] + 1
        self.end = np.minimum(feed, after)

    def windows(self, width: int = LINES) -> tuple[np.ndarray, ...]:
        """(two hashes, text, line within it) of every window."""
        n = max(0, len(self.text) - width + 1)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :][:n])
        a, b = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for k in range(width):
            a = mix((a ^ self.a[at + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
            b = mix((b + self.b[at + k]) * np.uint64(0xE7037ED1A0B428DB) ^ np.uint64(k + 7))
        return a, b, self.text[at], at - self.upto[self.text[at]]

    def spans(self, k: int) -> list[tuple[int, int]]:
        """Byte spans of the lines of text k; they tile it but for the blanks at its end."""
        ends = (self.end[self.upto[k] : self.upto[k + 1]] - self.bounds[k]).tolist()
        return list(zip([0, *ends[:-1]], ends))


def line_ends(data: np.ndarray, bounds: np.ndarray, w: Words, feeds: np.ndarray) -> np.ndarray:
    """Which words end a line."""
    n = len(w.start)
    if not n:
        return np.zeros(0, bool)
    final = np.ones(n, bool)
    final[:-1] = w.text[1:] != w.text[:-1]
    ends = final | np.isin(data[w.end - 1], np.frombuffer(b".!?", np.uint8))
    ends[:-1] |= np.searchsorted(feeds, w.end[:-1]) < np.searchsorted(feeds, w.start[1:])
    last = np.flatnonzero(ends)
    sentence = np.cumsum(ends) - ends
    words = np.diff(np.r_[-1, last])
    long = np.flatnonzero((words > LINE_WORDS)[sentence])
    if len(long):
        cut = content_cuts(w.hash[long], sentence[long])
        ends[long[cut]] = True
        place = np.arange(n)
        begin = np.maximum.accumulate(np.where(np.r_[True, ends[:-1]], place, 0))
        ends[long] |= ((place - begin) % LINE_WORDS == LINE_WORDS - 1)[long]
    return ends


def content_cuts(h: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """After which words of long sentences a cut falls, by the three words that end there and those around."""
    n = len(h)
    three, same = np.full(n, NONE), np.zeros(n, bool)
    same[2:] = sentence[2:] == sentence[:-2]
    three[2:] = mix(h[2:] * np.uint64(5) + mix(h[1:-1] * np.uint64(7) + h[:-2]))
    three[~same] = NONE
    least = three < NONE
    for k in range(1, NEAR + 1):
        there = sentence[k:] == sentence[:-k]
        least[k:] &= ~there | (three[k:] < three[:-k])
        least[:-k] &= ~there | (three[:-k] <= three[k:])
    return least


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, per document, in order."""
    keep = start < end
    order = np.lexsort((end[keep], start[keep], doc[keep]))
    doc, start, end = doc[keep][order], start[keep][order], end[keep][order]
    if not len(doc):
        return doc, start, end
    # all spans of a document on a stretch of one number line, so that running ends do not cross documents
    base = (np.cumsum(np.r_[False, doc[1:] != doc[:-1]])) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    new = np.r_[True, (start + base)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], start[first], (reach - base)[last]


def resolve(h1, h2, doc, at) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Which occurrences are the first of their window, and what the others cover (doc, start, end).

    doc: a number in the order of (doc_id, text hash). Occurrences at one place are one.
    """
    order = np.argsort(h1)
    ordered = h1[order]
    equal = ordered[1:] == ordered[:-1]
    alone = np.ones(len(order), bool)
    alone[1:] &= ~equal
    alone[:-1] &= ~equal
    first = np.zeros(len(h1), bool)
    first[order[alone]] = True
    some = order[~alone]
    some = some[np.lexsort((at[some], doc[some], h2[some], h1[some]))]
    a, b, d, p = h1[some], h2[some], doc[some], at[some]
    new = np.ones(len(some), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
    own = d == d[lead]
    first[some[new]] = True
    other = ~(own & (p == p[lead]))
    start = np.where(own, np.maximum(p, p[lead] + LINES), p)
    return first, (d[other], start[other], p[other] + LINES)


ROWS = "range bigint, decided boolean, doc_id bigint, text_key bigint, data binary"
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc_id", "<i8"), ("key", "<i8"), ("at", "<i8")])
SPAN = np.dtype([("start", "<i8"), ("end", "<i8")])


def numbered(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers in the order of (id, key), and the id and key of each number."""
    order = np.lexsort((keys, ids))
    i, k = ids[order], keys[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
    number = np.empty(len(i), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, i[new], k[new]


def rows_of(ranges, decided: bool, ids, keys, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays(
        [pa.array(ranges, pa.int64()), pa.array(np.full(n, decided)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(data, pa.binary())],
        ["range", "decided", "doc_id", "text_key", "data"],
    )


def span_rows(doc, start, end, ids, keys, ranges: int | None) -> pa.RecordBatch:
    """One row per document with its spans packed; dealt by the document, as a frequent window has very many."""
    doc, start, end = merged(doc, start, end)
    packed = np.empty(len(doc), SPAN)
    packed["start"], packed["end"] = start, end
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else doc
    last = np.r_[first[1:], len(doc)] if len(first) else first
    own = doc[first]
    data = [packed[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    where = (mix(keys[own].view(np.uint64) ^ mix(ids[own].view(np.uint64))) % np.uint64(ranges)).astype(np.int64) if ranges else np.zeros(len(own), np.int64)
    return rows_of(where, True, ids[own], keys[own], data)


def occurrences(ranges: int, held: int = HELD):
    """The least occurrence of every window that a task holds, by hash range, and what all others cover."""

    def decide(parts: list[tuple[np.ndarray, ...]], docs: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, text, at = (np.concatenate(x) for x in zip(*parts))
        number, ids, keys = numbered(*(np.concatenate(x) for x in zip(*docs)))
        doc = number[text]
        first, covered = resolve(h1, h2, doc, at)
        yield span_rows(*covered, ids, keys, ranges)
        rows, doc = np.empty(int(first.sum()), WINDOW), doc[first]
        for name, x in zip(WINDOW.names, (h1[first], h2[first], ids[doc], keys[doc], at[first]), strict=True):
            rows[name] = x
        # the range is the hash's place among all, taken from its upper half
        where = ((rows["h1"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        rows, where = rows[order], where[order]
        start = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else where
        data = [rows[a:b].tobytes() for a, b in zip(start.tolist(), [*start[1:].tolist(), len(rows)])]
        yield rows_of(where[start], False, np.zeros(len(data), np.int64), np.zeros(len(data), np.int64), data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, n, k = [], [], 0, 0
        for batch in batches:
            h1, h2, text, at = Lines(batch.column("text")).windows()
            parts.append((h1, h2, text + k, at))
            docs.append(tuple(batch.column(c).to_numpy() for c in ("doc_id", "text_key")))
            n, k = n + len(h1), k + batch.num_rows
            if n >= held:
                yield from decide(parts, docs)
                parts, docs, n, k = [], [], 0, 0
        if n:
            yield from decide(parts, docs)

    return run


def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range: what every occurrence but the first covers; decided spans pass through."""
    now, held = None, []

    def finish() -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(held), WINDOW)
        # a window that one row alone holds has no others: only those that repeat are looked at further
        order = np.argsort(rows["h1"], kind="stable")
        h = rows["h1"][order]
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[:-1] |= again[1:]
        rows = rows[order[again]]
        number, ids, keys = numbered(rows["doc_id"], rows["key"])
        _, covered = resolve(rows["h1"], rows["h2"], number, rows["at"])
        return span_rows(*covered, ids, keys, None)

    for batch in batches:
        decided = batch.column("decided").to_numpy(zero_copy_only=False)
        if decided.any():
            yield batch.filter(pa.array(decided))
        rest = batch.filter(pa.array(~decided))
        for r, data in zip(rest.column("range").to_pylist(), rest.column("data").to_pylist(), strict=True):
            if r != now and held:
                yield finish()
                held = []
            now = r
            held.append(data)
    if held:
        yield finish()


def text_key():
    return F.xxhash64("text")


def windows_about(docs: DataFrame) -> float:
    """About how many windows docs have: their ends of sentences and lines, and the cuts that their bytes may hold.

    Long sentences are cut at every fourth word at most, and a word and its blank take two
    bytes or more, so there are never more than four times as many (``CUT_BYTES`` / 8).
    """
    ends = F.octet_length("text") - F.octet_length(F.regexp_replace("text", r"[.!?\n]+", ""))
    return docs.filter("doc_id is not null").agg(F.sum(ends + F.octet_length("text") / CUT_BYTES)).first()[0] or 0.0


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): packed spans of lines that later occurrences cover, one row per document that has any.

    The spans of a document are as many as its windows at most.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2 * parts, int(windows_about(docs)) // RANGE)
    rows = in_text_batches(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_key().alias("text_key")).filter("doc_id is not null"),
        occurrences(ranges),
        ROWS,
    )
    found = rows.repartition(max(parts, ranges // 2), "range").sortWithinPartitions("range").mapInArrow(later, ROWS)
    return found.groupBy("doc_id", "text_key").agg(F.collect_list("data").alias("spans"))


def cut(text: bytes, at: list[tuple[int, int]], spans: list[bytes]) -> tuple[bytes, int, list[tuple[int, int]]]:
    """The text without the lines covered; how many went, and the byte spans that went."""
    gone = np.zeros(len(at) + 1, bool)
    for a, b in np.frombuffer(b"".join(spans), SPAN).tolist():
        gone[a:b] = True
    gone = gone[: len(at)]
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2).tolist()
    went = [(at[a][0], at[b - 1][1]) for a, b in edge]
    kept = [text[a:b] for a, b in zip([0, *(b for _, b in went)], [*(a for a, _ in went), len(text)])]
    return b"".join(kept), int(gone.sum()), went


NEW = ("n_lines", "n_removed", "removed")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut, and n_lines, n_removed, removed (character spans of the old text).

    Existing columns of these names are replaced.
    """
    name = "covered"
    while name in docs.columns:
        name += "_"
    spans = covered_lines(docs).select(
        F.col("doc_id").alias("covered_doc_id"), F.col("text_key").alias("covered_key"), F.col("spans").alias(name)
    )
    same = (docs["doc_id"].cast("bigint") == spans["covered_doc_id"]) & (F.xxhash64(docs["text"]) == spans["covered_key"])
    joined = docs.join(spans, same, "left").select(
        *[docs[f"`{c}`"] for c in docs.columns if c not in NEW],
        spans[name],
        F.lit(0).cast("bigint").alias("n_lines"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"),
    )
    return in_text_batches(joined, cut_rows(name), joined.drop(name).schema)


def cut_rows(covered: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = cut_batch(batch.column("text"), batch.column(covered))
            fields = [f for f in batch.schema if f.name != covered]
            arrays = [pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

    return run


def cut_batch(column: pa.Array, covered: pa.Array) -> dict:
    found = Lines(column)
    n_removed = np.zeros(len(column), np.int64)
    removed: list[list[dict]] = [[]] * len(column)
    texts: dict[int, str] = {}
    for k in np.flatnonzero(covered.is_valid().to_numpy(zero_copy_only=False)).tolist():
        text = found.data[found.bounds[k] : found.bounds[k + 1]]
        new, n_removed[k], went = cut(text.tobytes(), found.spans(k), covered[k].as_py())
        texts[k] = new.decode()
        points = np.r_[0, np.cumsum((text & 0xC0) != 0x80)]
        removed[k] = [{"start": int(points[a]), "end": int(points[b])} for a, b in went]
    if texts:
        column = [texts.get(k, t) for k, t in enumerate(column.to_pylist())]
    return {"text": column, "n_lines": np.diff(found.upto), "n_removed": n_removed, "removed": removed}


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, removed, text."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "removed", "text")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Documents with their later occurrences cut; those with nothing left go. n_chars, if there, follows the text."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "doc_id", "text")
    done = dedup_lines(packed).filter("n_removed = 0 or trim(text) <> ''")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("d.n_chars"))
    types = dict(docs.dtypes)
    return done.select(*[new.get(c, F.col(f"d.`{c}`")).cast(types[c]).alias(c) for c in docs.columns])
