"""Mixing sources to target token counts by entropy balancing.

Every document gets a rate, how often the mix takes it. Of all rates between zero and
the cap that give each source its target of tokens, entropy balancing takes those with
the least divergence from taking each document once. Their form is an exponential tilt,
rate = min(cap, exp(lambda * size)), with one lambda for each source; the lambdas are the
maximum of a convex dual whose gradient is what a source's rates still miss of its
target, and are found by Newton iterations, kept inside a bracket where the cap makes the
dual flat. Each iteration is one aggregation over the written counts of documents by
source and size, with a number or two for each source going to the driver and back. The
sums are exact decimals of rounded rates, so reruns agree however rows are dealt.

Rates are then rounded into copies. The copies of all documents of one source and size are
a whole number, the nearest to what their rates, and what larger sizes of the source have
left over, ask for; what is missed at the end is what a source's smallest documents cannot
make up, in general a few words. Which of equal documents get one copy more is decided by their
hash: they are dealt into buckets first, so one size of one source may hold any share of
all rows. The size counts of a source stream through one task in order of size; there are
at most about the square root of twice its tokens, as the sizes differ.

Sources by code point, null last, weigh WEIGHTS in turn. Defined results: null texts have
size zero; documents of size zero, and sources of them alone, are taken zero times;
repeated rows are documents of their own; without documents there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmerge.llm.common import materialise

#: Weights of the sources in order, repeated.
WEIGHTS = (3, 1, 2)
#: The mix's size, in hundredths of all tokens, and how often a document is taken at most.
SHARE = 150
CAP = 2
#: Iterations at most, and the part of a target by which its rates may miss it before they are rounded.
ROUNDS = 100
MISS = 1e-9
#: Steps in which rates are counted.
STEP = 1 << 40
#: Documents of one source and size that are ordered together, about, where they are many; buckets at least.
BUCKET = 1 << 16
BUCKETS = 256

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[int], weights: Sequence[int], share: float, cap: float) -> list[float]:
    """Each source's part of share times all sizes, by weight, at most cap times its size; the excess is dealt by weight again."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), [k for k, s in enumerate(sizes) if s > 0]
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total >= cap * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = float(cap * sizes[k])
        left -= sum(cap * sizes[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


class Dual:
    """One source's side of the dual: lambda, and the bracket that holds its solution."""

    def __init__(self, size: int, target: float, cap: float):
        self.target, self.lam, self.low, self.high = target, 0.0, -math.inf, math.inf
        #: All at the cap, or nothing to take: no lambda is looked for.
        self.done = size <= 0 or target >= cap * size
        if self.done:
            self.lam = math.inf if size > 0 else 0.0

    def step(self, taken: float, slope: float) -> None:
        """Newton's step from what the rates take and how that grows with lambda, or the bracket's middle."""
        miss = taken - self.target
        if abs(miss) <= MISS * self.target:
            self.done = True
            return
        self.low, self.high = (max(self.low, self.lam), self.high) if miss < 0 else (self.low, min(self.high, self.lam))
        new = self.lam - miss / slope if slope > 0 else (math.inf if miss < 0 else -math.inf)
        if not self.low < new < self.high or not math.isfinite(new):
            if math.isfinite(self.low) and math.isfinite(self.high):
                new = (self.low + self.high) / 2
            else:
                new = 2 * self.lam + math.copysign(1e-9, -miss) if self.lam * miss <= 0 else self.lam / 2 if abs(self.lam) > 1e-12 else -math.copysign(1e-9, miss)
        if new == self.lam or not self.low < new < self.high:
            self.done = True
        self.lam = new


def rates(cap: float):
    """The tilted rate of a row with lambda and size."""
    return F.when(F.col("lambda") == math.inf, F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("lambda") * F.col("size"))))


def solve(counts: DataFrame, sizes: Sequence[int], wanted: Sequence[float], cap: float) -> list[float]:
    """The lambdas of the sources 0, 1, ... of counts (k, size, n)."""
    spark = counts.sparkSession
    duals = [Dual(s, t, cap) for s, t in zip(sizes, wanted, strict=True)]
    for _ in range(ROUNDS):
        still = [(k, d.lam) for k, d in enumerate(duals) if not d.done]
        if not still:
            break
        now = counts.join(spark.createDataFrame(still, "k int, lambda double"), "k").withColumn("rate", rates(cap))
        tokens = (F.col("n") * F.col("size")).cast("decimal(19,0)")
        rate = F.floor(F.col("rate") * STEP).cast("decimal(14,0)")
        below = F.when(F.col("rate") < cap, tokens * rate)
        sums = now.groupBy("k").agg(
            F.sum(tokens * rate).cast("double").alias("taken"),
            F.sum((below * F.col("size").cast("decimal(10,0)")).cast("decimal(38,0)")).cast("double").alias("slope"),
        )
        for r in sums.collect():  # a row for each source
            duals[r.k].step(r.taken / STEP, (r.slope or 0.0) / STEP)
    return [d.lam for d in duals]


ROUNDED = "k int, size bigint, n bigint, copies bigint"


def round_copies(cap: int):
    """Rows (k, size, n, rate) by k and falling size: copies of each, what a size leaves over going on to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, over = None, 0.0
        for batch in batches:
            k, size, n, rate = (batch.column(c).to_pylist() for c in ("k", "size", "n", "rate"))
            copies = []
            for source, s, many, r in zip(k, size, n, rate, strict=True):
                if source != now:
                    now, over = source, 0.0
                want = many * r * s + over
                got = min(cap * many, max(0, math.floor(want / s + 0.5))) if s else 0
                over = want - got * s
                copies.append(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("size"), batch.column("n"), pa.array(copies, pa.int64())], ["k", "size", "n", "copies"]
            )

    return run


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, cap: int = CAP, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, size, source, source_size, target, rate, copies) of every row.

    The driver holds a few numbers for each source, as the recipe itself does.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = materialise(rows, "mix-sizes")
    per_size = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    found = per_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("n")).collect()
    found = sorted(((r.source, r["size"], r.n) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [s for _, s, _ in found]
    wanted = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], share / 100, cap)
    form = "k int, name string, source_size bigint, target double"
    sources = spark.createDataFrame([(k, name, s, t) for k, ((name, s, _), t) in enumerate(zip(found, wanted, strict=True))], form)
    same = F.col("source").eqNullSafe(F.col("name"))
    counts = materialise(per_size.join(sources.select("k", "name"), same).select("k", "size", "n"), "mix-counts")
    tilt = spark.createDataFrame(list(enumerate(solve(counts, sizes, wanted, cap))), "k int, lambda double")
    tilted = counts.join(tilt, "k").withColumn("rate", rates(cap))
    order = ["k", F.desc("size")]
    rounded = tilted.repartition("k").sortWithinPartitions(*order).mapInArrow(round_copies(cap), ROUNDED)
    rounded = materialise(rounded.withColumnRenamed("n", "many"), "mix-copies")
    # which of the documents of one source and size get one copy more: the first by hash
    buckets = BUCKETS
    while buckets * bucket < sum(n for _, _, n in found):
        buckets *= 2
    h = F.xxhash64("doc_id", "size")
    placed = rows.join(sources.select("k", "name", "source_size", "target"), same).drop("name")
    placed = materialise(placed.withColumn("h", h).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int")), "mix-placed")
    held = placed.groupBy("k", "size", "bucket").agg(F.count("*").alias("n")).join(rounded, ["k", "size"])
    upto = F.sum("n").over(Window.partitionBy("k", "size").orderBy("bucket"))
    more = F.col("copies") % F.col("many")
    cut = lambda c: F.floor(c.cast("decimal(19,0)") * more.cast("decimal(19,0)") / F.col("many").cast("decimal(19,0)")).cast("bigint")
    held = held.withColumn("upto", upto).select(
        "k", "size", "bucket", F.floor(F.col("copies") / F.col("many")).cast("int").alias("each"), (cut(F.col("upto")) - cut(F.col("upto") - F.col("n"))).alias("more")
    )
    nth = F.row_number().over(Window.partitionBy("k", "size", "bucket").orderBy("h", "doc_id"))
    out = placed.withColumn("nth", nth).join(held, ["k", "size", "bucket"]).join(tilt, "k")
    copies = F.col("each") + (F.col("nth") <= F.col("more")).cast("int")
    return out.select("doc_id", "size", "source", "source_size", "target", rates(cap).alias("rate"), copies.alias("copies"))


def mixing_report(docs: DataFrame) -> DataFrame:
    """The contract's rows: how many words the mix takes of each document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def expanded(docs: DataFrame, **recipe) -> DataFrame:
    """The mix itself: documents with an id once for each copy, numbered from 1 in column copy_no, other columns kept.

    Rows that repeat an id, source and text are told apart by nothing, so each takes the copies of one of them.
    """
    known = docs.filter(F.col("doc_id").isNotNull())
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    mixed = mix(known, **recipe).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0")
    keys = mixed.select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size"), "copies")
    same = (known["doc_id"] == keys["mix_id"]) & known["source"].cast("string").eqNullSafe(keys["mix_source"]) & (size == keys["mix_size"])
    joined = known.join(keys, same)
    return joined.select(*[known[c] for c in known.columns], F.explode(F.sequence(F.lit(1), keys["copies"])).alias("copy_no"))
