"""Ranked lexical search with hashed max-sketches.

The index holds a row for every document: its terms' hashes and frequencies, and its
sketch. A sketch is a vector hashed by the leading bits of the terms, several times as
wide as the document has terms; each coordinate is the highest frequency of the terms
that fall there. A document's impact of a term grows with the frequency alone, so these
maxima stand for the maxima of the impacts, whatever the corpus' averages turn out to be.

A search looks up a batch of queries in the sketches at once: the sum over a query's
terms of weight times the impact at the term's coordinate is never below the score.
Documents are then scored exactly from their own terms in descending order of these
bounds, until no bound reaches the query's k-th best score. That threshold begins with
the k-th best of a bounded sample and rises within each task; the tasks' best are merged
in two steps, so no query gathers more than a few rows for each of many tasks at once.
Queries are the stated set of items, taken in parts of bounded size; no pair of a
document and a query is written unless it may be among the best.

Terms are held by 64 bits of hash. Defined results: null texts and texts without terms
are no documents of the statistics and never answers; repeated rows are documents, or
items, of their own; equal scores go to the smaller doc_id, a null one last; items
without terms, or whose terms no document holds, have no answers; an empty table of
either kind gives none.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmerge.llm.common import hash_sample, in_text_batches, materialise, per_worker
from shelfmerge.llm.words import find_words, text_bytes

K = 10
#: Coordinates for each term of a document, at least; bits of a coordinate's number, least and most.
WIDTH = 64
LEAST_BITS, MOST_BITS = 8, 22
#: Bytes of items searched at once.
PASS_BYTES = 4 << 20
#: Documents whose scores give the first thresholds, at most.
SAMPLE = 512
#: Frequencies from here on are not told apart in a sketch; impacts stay below TOP.
MANY = 255
TOP = 1_000_000
#: Groups in which a query's answers are first merged.
GROUPS = 64

#: The bytes of terms are ASCII letters and digits and all of other characters; A-Z are lowered.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
PARTING = ~np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of terms, and (text, hash, frequency) of its different terms, ordered by text and hash."""
    data, bounds = text_bytes(texts)
    w = find_words(LOWER[data], bounds, PARTING)
    n = np.bincount(w.text, minlength=len(bounds) - 1)
    order = np.lexsort((w.hash, w.text))
    text, h = w.text[order], w.hash[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])][: len(h)])
    return n, text[first], h[first], np.diff(np.r_[first, len(h)])


def bits_for(distinct: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(np.log2(np.maximum(1, WIDTH * distinct))), LEAST_BITS, MOST_BITS).astype(np.int64)


INDEX = "doc_id bigint, n bigint, bits int, buckets array<int>, peaks array<int>, terms array<bigint>, tfs array<int>"


def lists(bounds: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(kind)))


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, text, h, tf = terms_of(batch.column("text"))
        rows = len(n)
        at = np.searchsorted(text, np.arange(rows + 1))
        bits = bits_for(np.diff(at))
        bucket = h >> (64 - bits[text]).astype(np.uint64)
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])][: len(h)])
        peak = np.minimum(np.maximum.reduceat(tf, first), MANY) if len(h) else tf
        folded = np.searchsorted(text[first], np.arange(rows + 1))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(n), pa.array(bits.astype(np.int32)),
                lists(folded, bucket[first], np.int32), lists(folded, peak, np.int32),
                lists(at, h.view(np.int64), np.int64), lists(at, tf, np.int32),
            ],
            ["doc_id", "n", "bits", "buckets", "peaks", "terms", "tfs"],
        )


def build_index(docs: DataFrame) -> DataFrame:
    """The written index: a row for every document with a term."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialise(in_text_batches(rows, index_rows, INDEX).filter("n > 0"), "ranked-index")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and each row's bounds among them."""
    bounds = np.asarray(column.offsets).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0]


class Queries:
    """A batch of items: their terms by hash, and which items ask for each."""

    def __init__(self, texts: list[str | None]):
        _, item, h, _ = terms_of(pa.array(texts, pa.string()))
        self.n = len(texts)
        self.vocabulary, term = np.unique(h, return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.item = item[order]
        self.at = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.tables: dict[int, np.ndarray] = {}

    def weigh(self, df: np.ndarray, documents: int) -> None:
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()]
        self.weight = np.array(weights, np.int64)

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are asked for, and their places in the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == terms)
        return hit, at[hit]

    def sums(self, doc: np.ndarray, low: np.ndarray, high: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """(docs, items): impacts times weights, over the terms low to high of the vocabulary for each entry."""
        begin, many = self.at[low], self.at[high] - self.at[low]
        ends = np.cumsum(many)
        total = int(ends[-1]) if len(ends) else 0
        asked = np.repeat(begin - (ends - many), many) + np.arange(total)
        weight = np.repeat(self.weight, np.diff(self.at))
        # below 2**53: exact as doubles
        values = np.repeat(impact, many) * weight[asked]
        return np.bincount(np.repeat(doc * self.n, many) + self.item[asked], values, docs * self.n).reshape(docs, self.n)

    def bounds(self, batch: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        """(documents, items): no score is higher."""
        docs = batch.num_rows
        bucket, at = flat(batch.column("buckets"))
        peak = batch.column("peaks").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(docs), np.diff(at))
        impact = np.where(peak >= MANY, TOP, impacts(peak, m[doc]))
        bits = batch.column("bits").to_numpy()
        low, high = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for b in np.unique(bits).tolist():
            if b not in self.tables:
                places = (self.vocabulary >> np.uint64(64 - b)).astype(np.int64)
                self.tables[b] = np.searchsorted(places, np.arange((1 << b) + 1))
            own = (bits == b)[doc]
            low[own], high[own] = self.tables[b][bucket[own]], self.tables[b][bucket[own] + 1]
        some = high > low
        return self.sums(doc[some], low[some], high[some], impact[some], docs)

    def scores(self, batch: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        """(documents, items): exact scores."""
        terms, at = flat(batch.column("terms"))
        hit, v = self.found(terms.view(np.uint64))
        doc = np.searchsorted(at, hit, "right") - 1
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)[hit]
        return self.sums(doc, v, v + 1, impacts(tf, m[doc]), batch.num_rows)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def lengths(n: pa.Array, documents: int, total: int) -> np.ndarray:
    """Each document's m, from its number of terms and the average."""
    return np.array([10 + 90 * x * documents // total for x in n.to_pylist()], np.int64)


class Best:
    """Each item's k best so far: (-score, no id, doc_id)."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.held = k, [[] for _ in range(items)]
        self.least = np.maximum(1, floor)

    def take(self, scores: np.ndarray, ids: list) -> None:
        docs, items = np.nonzero(scores >= self.least)
        for d, q, s in zip(docs.tolist(), items.tolist(), scores[docs, items].tolist(), strict=True):
            held = self.held[q]
            held.append((-int(s), ids[d] is None, ids[d] or 0))
            if len(held) >= 4 * self.k:
                self.cut(q)
        for q in np.unique(items).tolist():
            self.cut(q)

    def cut(self, q: int) -> None:
        self.held[q] = sorted(self.held[q])[: self.k]
        if len(self.held[q]) == self.k:
            self.least[q] = max(self.least[q], -self.held[q][-1][0])


def search_batch(q: Queries, best: Best, batch: pa.RecordBatch, m: np.ndarray) -> int:
    """Scores the batch's documents by descending bound until no bound reaches a threshold; how many were scored."""
    bounds = q.bounds(batch, m)
    ids = batch.column("doc_id").to_pylist()
    left, scored = np.arange(batch.num_rows), 0
    while len(left):
        reach = bounds[left] >= best.least
        left = left[reach.any(1)]
        if not len(left):
            break
        open_bounds = np.where(bounds[left] >= best.least, bounds[left], -1)
        k = min(best.k, len(left))
        # the documents with the highest bounds of any item
        top = np.argpartition(-open_bounds, k - 1, axis=0)[:k]
        top = np.unique(top[np.take_along_axis(open_bounds, top, 0) >= 0])
        rows = left[top]
        some = batch.take(pa.array(rows))
        best.take(q.scores(some, m[rows]), [ids[r] for r in rows.tolist()])
        left, scored = np.delete(left, top), scored + len(top)
    return scored


FOUND = "part int, q int, doc_id bigint, score bigint"


def searcher(shared, name: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        q, floor, documents, total = per_worker("ranked", name, lambda: shared.value)
        best = Best(q.n, k, floor.copy())
        for batch in batches:
            if batch.num_rows:
                search_batch(q, best, batch, lengths(batch.column("n"), documents, total))
        rows = [(i, None if none else doc, -s) for i, held in enumerate(best.held) for s, none, doc in held]
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(rows), part, np.int32)), pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
            ],
            ["part", "q", "doc_id", "score"],
        )

    return run


def frequencies(index: DataFrame, q: Queries) -> np.ndarray:
    """How many documents hold each asked term: one sum for each term and task reaches the exchange, one for each term the driver."""
    shared = index.sparkSession.sparkContext.broadcast(q.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            terms = flat(batch.column("terms"))[0].view(np.uint64)
            if len(vocabulary) and len(terms):
                at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                df += np.bincount(at[vocabulary[at] == terms], minlength=len(vocabulary))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["v", "n"])

    out = np.zeros(len(q.vocabulary), np.int64)
    for r in index.select("terms").mapInArrow(run, "v bigint, n bigint").groupBy("v").agg(F.sum("n").alias("n")).collect():
        out[r.v] = r.n
    return out


def search_part(index: DataFrame, items: list, form: str, k: int, documents: int, total: int, sample: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one part of the items."""
    spark = index.sparkSession
    q = Queries([r.text for r in items])
    q.weigh(frequencies(index, q), documents)
    first = Best(q.n, k, np.zeros(q.n, np.int64))
    for batch in hash_sample(index, sample, documents, "doc_id", "n").select("doc_id", "n", "terms", "tfs").toArrow().to_batches():
        first.take(q.scores(batch, lengths(batch.column("n"), documents, total)), batch.column("doc_id").to_pylist())
    floor = np.array([-h[-1][0] if len(h) == k else 0 for h in first.held], np.int64)
    shared = spark.sparkContext.broadcast((q, floor, documents, total))
    found = index.mapInArrow(searcher(shared, uuid.uuid4().hex, k), FOUND)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["q", "part"], ["q"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, r.item_id) for n, r in enumerate(items)], f"q int, item_id {form}")
    return found.join(names, "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, pass_bytes: int = PASS_BYTES, sample: int = SAMPLE, index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above zero.

    An index written before (build_index) may be searched instead of building one.
    """
    spark = docs.sparkSession
    index = build_index(docs) if index is None else index
    documents, total, size = (index.agg(F.count("*"), F.sum("n")).first() or (0, 0)) + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0,)
    form = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {form}, rank int, doc_id bigint, score bigint")
    if not documents:
        return out
    n = 1 + size // pass_bytes
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for p in range(n):  # one part of the items is in the driver at a time
        own = items.select("item_id", "text").filter(part == p).collect()
        if own:
            one = search_part(index, own, form, k, documents, total, sample)
            out = one if n == 1 else out.union(materialise(one, f"ranked-{p}"))
    return out


def ranked_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """search() with production parameters."""
    return search(docs, items)
