"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For each pattern length
there is a table of shifts by word block (the last two words under the window):
a block that ends no pattern lets the scan skip as many words as no occurrence
can end on. Blocks with shift zero lead, by their suffix and then their prefix
block, to a few patterns, which are compared word by word.

Defined results: null and empty texts have no words; repeated rows are judged
each on its own; items with a null id count under the id ``null``; repeated
windows, of one item or several, belong to every item that holds them; an empty
benchmark leaves every document clean.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmerge.llm.common import in_text_batches, materialise, per_worker

#: Words in a benchmark window.
WINDOW = 10
#: Benchmark bytes searched in one pass; a larger benchmark takes several passes.
PASS_BYTES = 4 << 20
#: Bytes of a text held as words at once; longer texts go through in pieces.
PIECE = 4 << 20

#: A-Z to a-z, other ASCII but digits and letters to a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of a UTF-8 text."""
    return (data or b"").translate(WORD_BYTES).split()


def windows(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of an item; a shorter item is one window, none without words."""
    if len(item) <= size:
        return [tuple(item)] if item else []
    return [tuple(item[i : i + size]) for i in range(len(item) - size + 1)]


class ShiftTable:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.length = len(patterns[0])
        self.block = min(2, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple]]] = {}
        for p in patterns:
            for end in range(self.block, self.length + 1):
                key = p[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), self.length - end)
            by_prefix = self.buckets.setdefault(p[-self.block :], {})
            by_prefix.setdefault(p[: self.block], []).append(p)

    def find(self, text: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence, by start."""
        m, b, default, shift, end = self.length, self.block, self.default, self.shift.get, self.length
        while end <= len(text):
            key = tuple(text[end - b : end])
            step = shift(key, default)
            if step:
                end += step
                continue
            start = end - m
            for p in self.buckets[key].get(tuple(text[start : start + b]), ()):
                if p == tuple(text[start:end]):
                    yield start, p
            end += 1


class Matcher:
    """The windows of benchmark items, searched length by length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.items: dict[tuple, list[str]] = {}
        for item_id, text in items:
            for w in windows(words(text), window):
                self.items.setdefault(w, []).append(item_id)
        by_length: dict[int, list[tuple]] = {}
        for w in self.items:
            by_length.setdefault(len(w), []).append(w)
        self.tables = [ShiftTable(p) for _, p in sorted(by_length.items())]
        self.overlap = max(by_length, default=1) - 1

    def search(self, data: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged word spans that windows cover, ids of their items."""
        total, base, tail, spans, found = 0, 0, [], [], set()
        for piece in pieces(data or b""):
            fresh = words(piece)
            text, base = tail + fresh, total - len(tail)
            total += len(fresh)
            for t in self.tables:
                for start, p in t.find(text):
                    spans.append((base + start, base + start + t.length))
                    found.update(self.items[p])
            tail = text[len(text) - self.overlap :] if self.overlap and self.overlap < len(text) else text[:]
            tail = tail if self.overlap else []
        return total, merged(spans), found


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text in pieces that end where a word ends."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and WORD_BYTES[data[end]] != 32:
            end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = "array<struct<start:bigint,end:bigint>>"


def benchmark_parts(benchmark: DataFrame, pass_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of parts of about pass_bytes, and the items of one after another.

    Only one part is in the driver, or broadcast, at a time.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"),
        F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // pass_bytes
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return n, ([(r.id, bytes(r.text)) for r in items.filter(part == k).collect()] for k in range(n))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES
) -> DataFrame:
    """docs with n_words, hit_spans (word positions) and item_ids (sorted as strings).

    Existing columns of these names are replaced; all others are kept. One scan
    without a shuffle where the benchmark fits one pass. A larger one takes a scan of
    the texts for each part, which writes no text but only what was found, by the
    text's digest; the last part's scan reads the table joined to that.
    """
    spark = docs.sparkSession
    n, parts = benchmark_parts(benchmark, pass_bytes)
    name = uuid.uuid4().hex
    found = []
    for k, items in enumerate(parts):
        shared = spark.sparkContext.broadcast(items)
        run = searcher(shared, window, f"{name}-{k}")
        if k == n - 1:
            out = with_found(docs, found)
            return in_text_batches(out, run, out.schema)
        texts = with_found(docs.select("text", digest_of("text").alias("digest")), [])
        hits = in_text_batches(texts, only_hits(run), "digest binary, hit_spans " + SPANS + ", item_ids array<string>")
        # equal texts have equal hits: one row for each, however many copies there are
        same = hits.groupBy("digest").agg(F.first("hit_spans").alias("hit_spans"), F.first("item_ids").alias("item_ids"))
        found.append(materialise(same, f"decontaminate-{k}"))
        shared.destroy()


def digest_of(text: str):
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def with_found(docs: DataFrame, found: list[DataFrame]) -> DataFrame:
    """docs with the columns of the search: what earlier parts found in a text, or nothing."""
    new = {
        "n_words": F.lit(0).cast("bigint"),
        "hit_spans": F.array().cast(SPANS),
        "item_ids": F.array().cast("array<string>"),
    }
    if not found:
        return docs.withColumns(new)
    rows = functools.reduce(DataFrame.unionByName, found)
    of_text = rows.groupBy(F.col("digest").alias("text_digest")).agg(
        F.flatten(F.collect_list("hit_spans")).alias("spans_before"),
        F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("ids_before"),
    )
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), digest_of("text").alias("own_digest"))
    joined = own.join(of_text, F.col("own_digest") == F.col("text_digest"), "left")
    new["hit_spans"] = F.coalesce("spans_before", new["hit_spans"])
    new["item_ids"] = F.coalesce("ids_before", new["item_ids"])
    kept = [new.pop(c).alias(c) if c in new else F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*kept, *[v.alias(c) for c, v in new.items()])


def only_hits(run):
    """What run finds, for the rows that hold any, without their texts."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            some = pa.compute.greater(pa.compute.list_value_length(batch.column("hit_spans")), 0)
            yield batch.select(["digest", "hit_spans", "item_ids"]).filter(some)

    return hits


def searcher(shared, window: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = per_worker("matcher", name, lambda: Matcher(shared.value, window))
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            before = zip(batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)
            counts, spans, ids = [], [], []
            for text, (old_spans, old_ids) in zip(texts, before, strict=True):
                n, hit, found = matcher.search(text)
                hit = merged(hit + [(s["start"], s["end"]) for s in old_spans])
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in hit])
                ids.append(sorted(found | set(old_ids)))
            fresh = {"n_words": counts, "hit_spans": spans, "item_ids": ids}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fresh[f.name], f.type) if f.name in fresh else batch.column(i)
                    for i, f in enumerate(batch.schema)
                ],
                schema=batch.schema,
            )

    return run


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of find_contamination for each document."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    own = [F.col(f"d.`{c}`").alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("text"))
    return find_contamination(packed, benchmark).filter(F.size("hit_spans") == 0).select(*own)
