"""Exact top-k inner products as a Voronoi join.

Pivots, drawn from a bounded sample, split the vectors into cells; there are about
as many as chunks, up to ``PIVOTS``, and a vector finds its own in two steps, by
coarse pivots first. A cell's summary is its count, its radius and the distances of the few vectors nearest
its pivot, each vec_id counted once over all cells. For a query q and a cell with pivot p and radius r no product exceeds
q.p + |q| r, and a vector at distance d from p reaches at least q.p - |q| d; the
k-th highest of these floors, over all summaries, is a score that q's answer
surely reaches. So q is sent only to the cells whose ceiling reaches it; queries
are the smaller side, so they are what is replicated, and each vector crosses
the shuffle once for every ``QUERY_BLOCK`` queries that its own cell is needed for,
and not at all if no query needs it. Cells are dealt out in chunks of bounded size, whatever their
own size; a chunk is solved block by block, and its best k per query are merged.

Components become floor(256 x); products are exact integers. Defined results:
vectors that are null, or hold null or non-finite components or ones whose 256-fold
is beyond a double, and rows without a vec_id take no part; shorter vectors are
filled up with zeros; equal scores go to the smaller vec_id; rows that repeat a
query's vec_id are not its candidates and are one query, that of the least vector;
scores beyond a long are ranked exactly and shown as the nearest long; a lone vector
gives no rows; nor does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmerge.llm.common import hash_sample, materialise

K = 5
EVERY = 50
SCALE = 256
#: Vectors that each pivot is drawn from; pivots of a small table, and of any, at most; rounds that centre them.
SAMPLE = 16
FEW_PIVOTS = 128
PIVOTS = 4096
ROUNDS = 4
#: Vectors in a chunk of a cell, about; queries solved together; vectors compared at once.
CHUNK = 8192
QUERY_BLOCK = 8192
BLOCK = 2048
#: Numbers in a block of bounds.
BOUNDS = 1 << 22
#: Room for rounding in bounds, which are floating point.
SLACK = 1e-6


def quantised(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of floor(256 x), zero-filled to width, and which rows take part."""
    n = len(column)
    size = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((n, width))
    out[row, at] = flat
    good = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~np.isfinite(flat)], minlength=n) == 0)
    return out, good


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def vector_list(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.reshape(-1)))


def choose_pivots(vectors: DataFrame, n: int, width: int, most: int = PIVOTS) -> np.ndarray:
    """Centres of a bounded sample: the root of a small table's size, as many as chunks in a larger one."""
    k = max(1, min(most, max(n // CHUNK, min(FEW_PIVOTS, int(np.sqrt(n) / 2)))))
    rows = hash_sample(vectors, SAMPLE * k, n, "vec_id").toArrow().combine_chunks()
    x, good = quantised(rows.column("embedding").combine_chunks(), width)
    x = np.unique(x[good], axis=0) if good.any() else np.zeros((1, width))
    p = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(ROUNDS):
            own = nearest(x, p)[0]
            count = np.bincount(own, minlength=len(p))
            total = np.zeros_like(p)
            np.add.at(total, own, x)
            p = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], p)
    return np.nan_to_num(p)


def nearest(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each vector, and its distance to the pivot, rounded up a little.

    Any cell is right as long as the distance is to its own pivot; numbers too large to square are at no known distance.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        square = np.nan_to_num((p**2).sum(1)[None, :] - 2 * (x @ p.T), nan=np.inf)
        cell = square.argmin(1)
        return cell, np.nan_to_num(np.sqrt(((x - p[cell]) ** 2).sum(1)), nan=np.inf) * (1 + SLACK)


class Coarse:
    """Pivots in groups: a vector looks at the pivots of its nearest group only."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        n = len(pivots)
        self.lead = pivots[np.linspace(0, n - 1, max(1, int(np.sqrt(n)))).astype(int)]
        group = nearest(pivots, self.lead)[0]
        self.groups = [np.flatnonzero(group == j) for j in range(len(self.lead))]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pivots) <= FEW_PIVOTS:
            return nearest(x, self.pivots)
        own = nearest(x, self.lead)[0]
        cell, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
        for j in np.unique(own).tolist():
            at = own == j
            among = self.groups[j] if len(self.groups[j]) else np.array([0])
            near, dist[at] = nearest(x[at], self.pivots[among])
            cell[at] = among[near]
        return cell, dist


def assign(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(vec_id, cell, dist, v) of the vectors that take part, cleaned and written once."""
    coarse = Coarse(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = quantised(batch.column("embedding"), width)
            if good.any():
                x = x[good]
                cell, dist = coarse.cells(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").filter(pa.array(good)), pa.array(cell.astype(np.int32)), pa.array(dist), vector_list(x)],
                    ["vec_id", "cell", "dist", "v"],
                )

    return materialise(vectors.mapInArrow(run, "vec_id bigint, cell int, dist double, v array<double>"), "knn-cells")


class Summary:
    """What is known of every cell: as many rows as there are pivots."""

    def __init__(self, assigned: DataFrame, pivots: np.ndarray, k: int):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[int, float]] = {}
            for batch in batches:
                cell, dist = batch.column("cell").to_numpy(), batch.column("dist").to_numpy()
                for c in np.unique(cell).tolist():
                    d = dist[cell == c]
                    n, far = held.get(c, (0, 0.0))
                    held[c] = n + len(d), max(far, float(d.max()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.int32()),
                    pa.array([v[0] for v in held.values()], pa.int64()),
                    pa.array([v[1] for v in held.values()], pa.float64()),
                ],
                ["cell", "n", "far"],
            )

        def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                cell, dist = batch.column("cell").to_numpy(), batch.column("dist").to_numpy()
                for c in np.unique(cell).tolist():
                    held[c] = np.sort(np.append(held.get(c, []), dist[cell == c]))[: k + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))],
                ["cell", "near"],
            )

        parts = assigned.select("cell", "dist").mapInArrow(partial, "cell int, n bigint, far double")
        rows = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()
        # one row of each vec_id: at most one floor is a query's own, whatever the number of its rows
        once = assigned.groupBy("vec_id").agg(F.min(F.struct("dist", "cell")).alias("m")).select("m.cell", "m.dist")
        lists = once.mapInArrow(closest, "cell int, near array<double>").groupBy("cell")
        nearby = lists.agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
        self.k, self.pivots = k, pivots
        self.count = np.zeros(len(pivots), np.int64)
        self.far = np.full(len(pivots), -np.inf)
        self.near = np.full((len(pivots), k + 1), np.inf)
        for r in rows:
            self.count[r.cell], self.far[r.cell] = r.n, r.far
        for r in nearby:
            self.near[r.cell, : len(r.near)] = r.near
        self.chunks = np.maximum(1, -(-self.count // CHUNK))

    def needed(self, q: np.ndarray) -> np.ndarray:
        """Which cells each query must see."""
        size = max(1, BOUNDS // self.near.size)
        with np.errstate(over="ignore", invalid="ignore"):
            return np.concatenate([self.needed_by(q[k : k + size]) for k in range(0, max(1, len(q)), size)])

    def needed_by(self, q: np.ndarray) -> np.ndarray:
        at_pivot = q @ self.pivots.T
        norm = np.sqrt((q**2).sum(1))[:, None]
        slack = SLACK * (1 + norm * np.sqrt((self.pivots**2).sum(1))[None, :])
        floors = (at_pivot - slack)[:, :, None] - norm[:, :, None] * self.near[None]
        # one more than k: the query's own vec_id has one floor at most
        floors = np.sort(np.where(np.isnan(floors), -np.inf, floors).reshape(len(q), -1), axis=1)[:, ::-1]
        reach = floors[:, self.k] if floors.shape[1] > self.k else np.full(len(q), -np.inf)
        ceiling = np.where(self.count > 0, at_pivot + slack + norm * self.far[None, :], -np.inf)
        # a bound that overflowed says nothing, so the cell is seen
        return ~(ceiling < reach[:, None]) & (self.count > 0)[None, :]


DEALT = "cell int, chunk int, part int, kind int, vec_id bigint, v array<double>"


def parts_of(s: Summary, queries: DataFrame) -> np.ndarray:
    """Into how many parts the queries that need a cell are dealt: none, if no query does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(s.pivots), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += s.needed(matrix(batch.column("v"))).sum(0)
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["cell", "n"])

    parts = np.zeros(len(s.pivots), np.int64)
    for r in queries.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        parts[r.cell] = -(-r.n // QUERY_BLOCK)
    return parts


def deal(s: Summary, parts: np.ndarray, queries: bool):
    """Rows by (cell, chunk, part of the cell's queries): a query goes to all chunks of its cells, a vector to one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            if queries:
                row, cell = np.nonzero(s.needed(matrix(batch.column("v")))) if len(ids) else (ids, ids)
                n = s.chunks[cell]
                row, cell = np.repeat(row, n), np.repeat(cell, n)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                part = mixed[row] % parts[cell].astype(np.uint64)
            else:
                cell = batch.column("cell").to_numpy()
                n = parts[cell]
                row, cell = np.repeat(np.arange(len(ids)), n), np.repeat(cell, n)
                chunk = mixed[row] % s.chunks[cell].astype(np.uint64)
                part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(row)
            for a in range(0, len(row), 4096):
                few = at.slice(a, 4096)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x[a : a + 4096].astype(np.int32)) for x in (cell, chunk, part)),
                        pa.array(np.full(len(few), 0 if queries else 1, np.int32)),
                        batch.column("vec_id").take(few),
                        batch.column("v").take(few),
                    ],
                    ["cell", "chunk", "part", "kind", "vec_id", "v"],
                )

    return run


def best(q_ids, q, ids, x, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's k best, highest first, ties to the smaller id; missing ones have id -1 and no score."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    n = len(ids)
    with np.errstate(over="ignore"):
        top = max(1.0, float(np.abs(q).max(initial=0))) * max(1.0, float(np.abs(x).max(initial=0))) * q.shape[1]
    if top * (n + 1) < 2**62 and top < 2**53:
        key = (q @ x.T).astype(np.int64) * n + (n - 1 - np.arange(n))[None, :]
    else:  # numbers that only Python's integers hold
        key = np.array([[int(a) for a in r] for r in q], object) @ np.array([[int(a) for a in r] for r in x], object).T
        key = key * n + (n - 1 - np.arange(n))[None, :]
    own = q_ids[:, None] == ids[None, :]
    scores, found = [], []
    for r in range(len(q)):
        keep = np.nonzero(~own[r])[0] if own[r].any() else np.arange(n)
        row = key[r][keep]
        if len(row) > k:
            row = np.partition(row, len(row) - k)[len(row) - k :] if row.dtype != object else np.sort(row)[-k:]
        row = np.sort(row)[::-1]
        scores.append([int(v) // n for v in row])
        found.append([int(ids[n - 1 - int(v) % n]) for v in row])
    return scores, found


def beyond(score: int) -> str | None:
    """For scores that a long cannot hold: a text that sorts as they do."""
    if -(2**63) < score < 2**63 - 1:
        return None
    digits = str(abs(score)).rjust(700, "0")
    return "1" + digits if score > 0 else "0" + digits.translate(str.maketrans("0123456789", "9876543210"))


SOLVED = "query_id bigint, score bigint, beyond string, vec_id bigint"


def solve(k: int):
    """Rows sorted by (cell, chunk, part, kind): each query's best of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_ids, q, top = None, [], [], {}

        def finish():
            rows = [(i, s, v) for i, best_of in top.items() for s, v in best_of]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([min(max(r[1], -(2**63)), 2**63 - 1) for r in rows], pa.int64()),
                    pa.array([beyond(r[1]) for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.int64()),
                ],
                ["query_id", "score", "beyond", "vec_id"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("cell", "chunk", "part", "kind")], axis=1)
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            cuts = np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                place, kind = tuple(key[a, :3].tolist()), key[a, 3]
                if place != now:
                    if top:
                        yield finish()
                    now, q_ids, q, top = place, [], [], {}
                if kind == 0:
                    q_ids.append(ids[a:b])
                    q.append(x[a:b])
                elif q:
                    queries, who = np.concatenate(q), np.concatenate(q_ids)
                    q, q_ids = [queries], [who]
                    for c in range(a, b, BLOCK):
                        d = min(b, c + BLOCK)
                        for e in range(0, len(who), BLOCK):
                            found = best(who[e : e + BLOCK], queries[e : e + BLOCK], ids[c:d], x[c:d], k)
                            for i, s, v in zip(who[e : e + BLOCK].tolist(), *found, strict=True):
                                held = top.get(i, []) + list(zip(s, v, strict=True))
                                top[i] = sorted(held, key=lambda t: (-t[0], t[1]))[:k]
        if top:
            yield finish()

    return run


def knn_join(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of every row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    form = "query_id bigint, rank int, vec_id bigint, score bigint"
    vectors = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    )
    n, width = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = max(1, width or 0)
    if n < 2:
        return spark.createDataFrame([], form)
    pivots = choose_pivots(vectors, n, width)
    assigned = assign(vectors, pivots, width)
    summary = Summary(assigned, pivots, k)
    every_one = assigned.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = every_one.groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("m")).select("vec_id", "m.cell", "m.v")
    parts = parts_of(summary, queries)
    sent = queries.mapInArrow(deal(summary, parts, True), DEALT)
    data = assigned.select("vec_id", "cell", "v").mapInArrow(deal(summary, parts, False), DEALT)
    place = ["cell", "chunk", "part"]
    dealt = sent.union(data).repartition(*place).sortWithinPartitions(*place, "kind")
    partial = dealt.mapInArrow(solve(k), SOLVED)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
