"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments. Two fingerprints that differ in few bits differ in
at most one bit in some segment, so every fingerprint looks up, in each segment's
table, the ball of radius one around its segment. Of two segments that differ in one
bit, the one that has the bit set finds the other, so only set bits are turned over.
Complete distances are then verified.

Two kinds are built from this. ``near_duplicates`` keeps a fixed contract: 64 bits over
three-word shingles, two segments of 32 bits, three bits or fewer; by the pigeonhole
principle no link is lost. ``similar_groups``, which the pipeline uses, is for a
Jaccard similarity of 0.8 over five-word shingles: 192 bits, eight segments of 24
bits, ``WIDE.distance`` bits or fewer, which is what texts of such a similarity differ
in; there both sides turn bits off, so segments meet that differ in one bit or in two,
one set on either side, and of eight segments nearly always some meet. What meets so is
only proposed: a link counts if the shingles themselves are that similar. First each
row's nearest and as few links as connect a group are proposed; then, of the rows for
which that left some out, every pair that meets and is not in one group yet, so none is
lost to those limits. Texts whose shingles are the same, repeats included, are one node.

Equal fingerprints are one node. The rows under one table key are compared inside a
task, which returns links that connect what the verified links connect, fewer than
rows, however dense the group. A key with more than ``LIMIT`` rows, found by counts
before any row is dealt, is not solved as one: its rows are dealt by the parts of the
rest of the fingerprint too, again with balls of radius one; that is exact for three
bits, not for the wide kind, where the second look deals such keys into blocks and
compares every two of them. In a large group what has been reached once is not compared
again, so a dense one costs little more than its rows.

Defined results: null texts and texts without words have fingerprint zero and link like
others; a text with fewer words than a shingle is one shingle; repeated rows share one
node; a null doc_id never becomes a component's id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmerge.llm.common import in_text_batches, materialise
from shelfmerge.llm.components import components
from shelfmerge.llm.words import find_words, mix, text_bytes

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Rows under one table key that are solved at once.
LIMIT = 4096
WIDE_LIMIT = 1 << 16
#: Rows from which a group is searched from node to node.
LARGE = 1024
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Pairs of rows compared at once.
PAIRS = 1 << 21

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Whatever is neither an ASCII letter, a digit nor part of another letter parts words of similar_groups.
PARTING = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


@dataclass(frozen=True)
class Scheme:
    """How fingerprints are cut and compared."""

    bits: int
    width: int
    distance: int
    #: Whether rows meet at what both reach by turning bits off, or only at one's own segment.
    both: bool
    #: Bits of a part by which the rows of large keys are dealt again.
    part: int
    #: Links of each row of a small group to its nearest; 0: as few as connect it.
    nearest: int = 0


NARROW = Scheme(64, 32, DISTANCE, False, 16)
WIDE = Scheme(192, 24, 32, True, 24, 8)
#: Jaccard similarity of the shingles that a link of similar_groups needs.
SIMILAR = 0.8


def shingle_hashes(data: bytes | None, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, repeats included, chunk by chunk."""
    import xxhash

    found = (data or b"").translate(LOWER).split()
    if not found:
        return
    h, joined = xxhash.xxh64_intdigest, b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    width = min(width, len(found))
    first, last = start[: len(found) - width + 1].tolist(), end[width - 1 :].tolist()
    for k in range(0, len(first), CHUNK):
        yield np.array(
            [h(joined[a:b], SEED) for a, b in zip(first[k : k + CHUNK], last[k : k + CHUNK], strict=True)], np.uint64
        )


def fingerprint(data: bytes | None) -> int:
    """64 majority bits; zero without words."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(data):
        n += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(sum(1 << b for b in range(64) if 2 * ones[b] > n))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the 64 bits, highest byte first."""
    return in_text_batches(docs.select("doc_id", "text"), fingerprint_rows, "doc_id bigint, fp binary")


def fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t).to_bytes(8, "big") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.binary())], ["doc_id", "fp"])


#: The bits of a byte as eight bytes of zero or one.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
#: Shingles whose spread bits can be added without a carry.
ADDED = 255


def filled_words(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the words of all texts in order and the text of each; and how many texts there are.

    A short text's words come again until they fill one shingle, with its length in them.
    """
    data, bounds = text_bytes(pc.utf8_lower(texts))
    w = find_words(data, bounds, PARTING)
    n = len(bounds) - 1
    many = np.diff(np.searchsorted(w.text, np.arange(n + 1)))
    short = np.flatnonzero((many > 0) & (many < width))
    first = np.searchsorted(w.text, np.arange(n))
    h, text = w.hash, w.text
    if len(short):
        at = np.concatenate([first[k] + np.arange(width) % many[k] for k in short.tolist()])
        extra = h[at] + np.repeat(many[short].astype(np.uint64), width)
        keep = ~np.isin(text, short)
        h, text = np.concatenate([h[keep], extra]), np.concatenate([text[keep], np.repeat(short, width)])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    return h, text, n


def word_shingles(h: np.ndarray, text: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text) of the shingles of width words within one text, chunk by chunk."""
    for k in range(0, len(h), CHUNK):
        piece, own = h[k : k + CHUNK + width - 1], text[k : k + CHUNK + width - 1]
        m = len(piece) - width + 1
        if m < 1:
            break
        a = piece[:m]
        for j in range(1, width):
            a = mix(a * np.uint64(0x9E3779B97F4A7C15) + piece[j : j + m])
        inside = own[:m] == own[width - 1 :]
        if inside.any():
            yield a[inside], own[:m][inside]


def wide_fingerprints(texts: pa.Array, width: int = 5) -> np.ndarray:
    """192 majority bits of each text's shingles, as (texts, 24) bytes; zero without words."""
    return wide_marks(texts, width)[0]


def wide_marks(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """wide_fingerprints(), and the sum of each text's shingle hashes, which is one for the same shingles in any order."""
    h, text, n = filled_words(texts, width)
    ones, total, sums = np.zeros((n, 192), np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for a, own in word_shingles(h, text, width):
        more = [mix(a ^ np.uint64(x)) for x in (0xC2B2AE3D27D4EB4F, 0xE7037ED1A0B428DB)]
        all_bits = np.stack([a, *more], axis=1).view(np.uint8).reshape(len(a), 24)
        place = np.arange(len(own))
        begin = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], place, 0))
        starts = np.flatnonzero((place - begin) % ADDED == 0)
        added = np.add.reduceat(SPREAD[all_bits], starts, axis=0)
        np.add.at(ones, own[starts], added.view(np.uint8).reshape(len(starts), 192))
        np.add.at(total, own[starts], np.diff(np.r_[starts, len(own)]))
        np.add.at(sums, own[starts], np.add.reduceat(more[0], starts))
    return np.packbits(2 * ones > total[:, None], axis=1), sums.view(np.int64)


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, s): the different shingles of each text, by 32 bits of their hash."""
    for batch in batches:
        h, text, n = filled_words(batch.column("text"), 5)
        found = [(own << 32) | (a >> np.uint64(32)).astype(np.int64) for a, own in word_shingles(h, text, 5)]
        every = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]))
        at = np.searchsorted(every >> 32, np.arange(n + 1)).astype(np.int32)
        low = (every & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.ListArray.from_arrays(pa.array(at), pa.array(low))], ["text_key", "s"])


def wide_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, sums = wide_marks(batch.column("text"))
        offsets = pa.array(np.arange(len(fp) + 1, dtype=np.int32) * 24).buffers()[1]
        column = pa.Array.from_buffers(pa.binary(), len(fp), [None, offsets, pa.py_buffer(fp.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), column, pa.array(sums)], ["doc_id", "text_key", "fp", "sums"])


def balls(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, probe, fp): each table entry (probe false), and its ball of set bits turned off.

    The key is the segment's number above its bits.
    """
    rows = nodes.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(scheme.bits // scheme.width - 1))))
    return with_ball(rows, scheme.width).select(F.col("made").alias("key"), F.col("off").alias("probe"), *nodes.columns)


def with_ball(rows: DataFrame, size: int) -> DataFrame:
    """rows with made, part seg of fp, of ``size`` bits, below its number; once as it is, and with each set bit turned off."""
    value = F.conv(F.hex(F.substring("fp", F.col("seg") * (size // 8) + 1, size // 8)), 16, 10).cast("bigint")
    rows = rows.withColumn("value", value).withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(size - 1))))
    rows = rows.filter("bit < 0 or getbit(value, greatest(bit, 0)) = 1")
    flip = F.when(F.col("bit") < 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftleft(1L, bit)"))
    made = F.col("value").bitwiseXOR(flip).bitwiseOR(F.shiftleft(F.col("seg").cast("bigint"), size))
    return rows.withColumns({"made": made, "off": F.col("bit") >= 0})


def dealt_again(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """The rows of keys over the limit, dealt by (key, part of the fingerprint outside the key's segment) with its ball.

    Where both sides turn bits off, only later segments: what meets in two segments meets under the earlier one.
    """
    size = scheme.part
    rows = rows.withColumn("seg", F.explode(F.sequence(F.lit(0), F.lit(scheme.bits // size - 1))))
    own, there = F.shiftright("key", scheme.width), F.floor(F.col("seg") * size / scheme.width)
    spread = with_ball(rows.filter(there > own if scheme.both else there != own), size)
    return spread.select("key", F.col("made").alias("sub"), (F.col("probe") | F.col("off")).alias("probe"), "fp")


def solve_groups(group: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int, both: bool, nearest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows u, v whose links connect, within each group, what the links of the scheme connect.

    group: sorted numbers; fp: rows of 64-bit words. A link has a table entry on one
    side at least, unless both. With nearest, small groups give each row's links to so
    many nearest rows besides, as links may fail a later check; and a row that has more
    is given with itself.
    """
    n = len(group)
    end = np.searchsorted(group, group, "right")
    start = np.searchsorted(group, group)
    fan = end - np.arange(n) - 1
    if not both:  # entries come first in their group; a probe starts no pair
        fan = np.where(probe, 0, fan)
    large = end - start > LARGE
    some = [spread_from(np.arange(a, end[a]), probe, fp, distance, both) for a in np.unique(start[large]).tolist()]
    fan[large] = 0
    upto, at = np.cumsum(fan), 0
    more = [(x, x) for x in (np.unique(np.concatenate(s)) for s in some)] if nearest else []
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS)))
        few = fan[at:stop]
        u = np.repeat(np.arange(at, at + len(few)), few)
        v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(few) - few, few)
        apart = np.bitwise_count(fp[u] ^ fp[v]).sum(1, np.int64)
        near = apart <= distance
        u, v, apart = u[near], v[near], apart[near]
        some.append(tree(u, v))
        if nearest:
            kept = first_links(u, v, apart, nearest)
            short = np.unique(np.concatenate([u[~kept], v[~kept]]))
            more += [(u[kept], v[kept]), (short, short)]
        at = stop
    found = tree(*(np.concatenate(x) for x in zip(*some))) if some else tree(fan, fan)
    return tuple(np.concatenate(x) for x in zip(found, *more))


def first_links(u: np.ndarray, v: np.ndarray, apart: np.ndarray, n: int) -> np.ndarray:
    """Which links are among the n nearest of either end."""
    end, link = np.concatenate([u, v]), np.tile(np.arange(len(u)), 2)
    order = np.lexsort((np.tile(apart, 2), end))
    end, link = end[order], link[order]
    kept = np.zeros(len(u), bool)
    kept[link[np.arange(len(end)) - np.searchsorted(end, end) < n]] = True
    return kept


def across(group: np.ndarray, root: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within a group that are near and have different roots, some at a time; rows are sorted by group and root."""
    end = np.searchsorted(group, group, "right")
    run = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (root[1:] != root[:-1])])
    other = np.searchsorted(run, run, "right")
    fan = end - other
    upto, at = np.cumsum(fan), 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS)))
        few = fan[at:stop]
        u = np.repeat(np.arange(at, at + len(few)), few)
        v = np.repeat(other[at:stop] - np.cumsum(few) + few, few) + np.arange(len(u))
        near = np.bitwise_count(fp[u] ^ fp[v]).sum(1, np.int64) <= distance
        yield u[near], v[near]
        at = stop


def tree(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from every node to the least node of its component: as many as nodes at most."""
    if not len(u):
        return u, v
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def spread_from(rows: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of a large group, found from node to node: what has been reached is not compared again."""
    left, out_u, out_v = rows, [], []
    while len(left):
        todo, left = left[:1], left[1:]
        while len(todo) and len(left):
            some, todo = todo[: max(1, PAIRS // len(left))], todo[max(1, PAIRS // len(left)) :]
            near = np.bitwise_count(fp[some][:, None] ^ fp[left][None]).sum(2, np.int64) <= distance
            if not both:
                near &= ~probe[some][:, None] | ~probe[left][None]
            hit = near.any(0)
            if hit.any():
                out_u.append(some[near[:, hit].argmax(0)])
                out_v.append(left[hit])
                todo, left = np.concatenate([todo, left[hit]]), left[~hit]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_u, out_v))


#: Rows solved together; a group ends where they do.
SOLVED = 1 << 16


def numbered_groups(part: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The number of each row's group, rows with equal keys standing together."""
    change = np.zeros(part.num_rows, bool)
    for k in keys:
        c = part.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def fp_words(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("fp").to_pylist()), "<u8").reshape(part.num_rows, -1)


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str], solve) -> Iterator[pa.RecordBatch]:
    """What solve() yields of rows that come sorted by keys, many groups at a time, each of them whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < SOLVED:
            continue
        part = pa.concat_batches(held)
        same = np.ones(part.num_rows, bool)
        for k in keys:
            c = part.column(k).to_numpy()
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield from solve(part.slice(0, cut))
        held = [part.slice(cut)]
    if held:
        yield from solve(pa.concat_batches(held))


def solver(keys: list[str], scheme: Scheme, both: bool):
    """Links (u, v) of the rows, which come sorted by key and probe."""

    def solve(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        probe = part.column("probe").to_numpy(zero_copy_only=False)
        u, v = solve_groups(numbered_groups(part, keys), probe, fp_words(part), scheme.distance, both, scheme.nearest)
        u, v = (part.column("fp").take(pa.array(x)) for x in (u, v))
        out = pa.RecordBatch.from_arrays([u, v], ["u", "v"])
        yield out if scheme.nearest else out.filter(pc.not_equal(u, v))

    return lambda batches: in_groups(batches, keys, solve)


def links_between(nodes: DataFrame, limit: int = LIMIT, scheme: Scheme = NARROW) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp, binary) that give the same components as all links.

    A scheme with nearest gives (u, u) too, of each row that may have links besides.
    """
    dealt = balls(nodes, scheme)
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("entries"))
    large = materialise(counts.filter((F.col("n") > limit) & ((F.col("entries") > 0) | F.lit(scheme.both))).select("key"), "simhash-large")
    if large.isEmpty():
        return solved(dealt, ["key"], scheme, scheme.both)
    small = solved(dealt.join(large, "key", "left_anti"), ["key"], scheme, scheme.both)
    theirs = dealt.join(large, "key", "left_semi")
    found = small.union(solved(dealt_again(theirs, scheme), ["key", "sub"], scheme, True))
    return found.union(theirs.select("fp", "fp")) if scheme.nearest else found


def links_across(nodes: DataFrame, limit: int, scheme: Scheme) -> DataFrame:
    """(u, v): all pairs of nodes (fp, node, root) that meet and have different roots.

    Keys with one root alone have none. The rows of a key over the limit are dealt into
    blocks, and every two blocks are a group, so that no pair is lost and none is large.
    """
    dealt = balls(nodes, scheme).drop("probe")
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"))
    blocks = F.when(F.col("n") <= limit, 1).otherwise(F.ceil(2 * F.col("n") / limit)).cast("int")
    rows = dealt.join(counts.filter("a < b").select("key", blocks.alias("blocks")), "key")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("other")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = (F.least(own, other).cast("bigint") * F.col("blocks") + F.greatest(own, other)).alias("sub")
    keys = ["key", "sub"]
    rows = rows.select("key", pair, "root", "node", "fp").repartition(*keys).sortWithinPartitions(*keys, "root")

    def solve(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node = part.column("node")
        for u, v in across(numbered_groups(part, keys), part.column("root").to_numpy(), fp_words(part), scheme.distance):
            yield pa.RecordBatch.from_arrays([node.take(pa.array(u)), node.take(pa.array(v))], ["u", "v"])

    found = rows.mapInArrow(lambda batches: in_groups(batches, keys, solve), "u bigint, v bigint")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def solved(rows: DataFrame, keys: list[str], scheme: Scheme, both: bool) -> DataFrame:
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "probe")
    return dealt.mapInArrow(solver(keys, scheme, both), "u binary, v binary")


def rooted(nodes: DataFrame, limit: int, scheme: Scheme) -> DataFrame:
    """nodes (distinct fp) with root, the least fingerprint of their component."""
    roots = components(links_between(nodes.select("fp"), limit, scheme)).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    marked = materialise(fingerprints(docs), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    placed = materialise(rooted(nodes, limit, NARROW), "simhash-nodes")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = placed.join(ids, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def similar_links(texts: DataFrame, pairs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (u, v) of text keys whose texts' shingles have a Jaccard similarity of least or more; no words are like no words.

    texts: (text_key, text). Only texts in a pair send their shingles.
    """
    asked = pairs.select(F.col("u").alias("text_key")).union(pairs.select("v")).distinct()
    linked = texts.join(asked, "text_key", "left_semi").dropDuplicates(["text_key"])
    sets = materialise(in_text_batches(linked, shingle_rows, "text_key bigint, s array<int>"), "shingles")
    side = lambda k: sets.select(F.col("text_key").alias(k), F.col("s").alias(f"s_{k}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    common = F.size(F.array_intersect("s_u", "s_v"))
    union = F.size("s_u") + F.size("s_v") - common
    return both.filter(common >= least * union - 1e-9).select("u", "v")


def similar_groups(docs: DataFrame, limit: int = WIDE_LIMIT, least: float = SIMILAR) -> DataFrame:
    """(doc_id, text_key, root): the group of every row over five-word shingles; text_key is the text's hash, root the least one of its group.

    Fingerprints propose links, between texts of the same one and of near ones; only
    those whose shingles are alike count. What the first proposals left out is looked at
    once more, between different groups, so that limits drop no pair that meets.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    of_rows = in_text_batches(rows, wide_rows, "doc_id bigint, text_key bigint, fp binary, sums bigint")
    marked = materialise(of_rows, "fingerprints")
    nodes = materialise(marked.groupBy("fp", "sums").agg(F.min("text_key").alias("node")), "simhash-nodes")
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    links = materialise(links_between(first.select("fp"), limit, WIDE).distinct(), "simhash-links")
    near = links.filter("u <> v")
    named = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"key_{c}"))
    named_links = near.join(named("u"), "u").join(named("v"), "v").select(F.col("key_u").alias("u"), F.col("key_v").alias("v"))
    several = first.filter("n > 1")
    same = nodes.join(several, "fp").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    ordered = lambda pairs: pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialise(ordered(named_links.union(same)), "simhash-pairs")
    texts = rows.select("text_key", "text")
    alike = materialise(similar_links(texts, pairs, least), "simhash-alike")
    roots = components(alike)
    # pairs that were not proposed: of rows with more links, of fingerprints with several nodes, and of their neighbours
    open_fps = links.filter("u = v").select(F.col("u").alias("fp")).union(several.select("fp"))
    beside = near.union(near.select("v", "u")).join(several.select(F.col("fp").alias("u")), "u", "left_semi")
    open_fps = open_fps.union(beside.select("v")).distinct()
    left = nodes.join(open_fps, "fp", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    left = materialise(left.select("fp", "node", "root"), "simhash-left")
    more = materialise(links_across(left, limit, WIDE).join(pairs, ["u", "v"], "left_anti"), "simhash-pairs")
    if not more.isEmpty():
        roots = components(alike.union(similar_links(texts, more, least)))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return marked.join(placed, ["fp", "sums"]).select("doc_id", "text_key", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every group of similar_groups: the least by (doc_id, text hash); rows without an id stay.

    Of rows that repeat its id and text one stays.
    """
    name = "text_key"
    while name in docs.columns:
        name += "_"
    known = docs.filter(docs["doc_id"].isNotNull())
    first = similar_groups(known).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("m"))
    kept = first.select(F.col("m.doc_id").alias("kept_doc_id"), F.col("m.text_key").alias("kept_key"))
    keyed = known.withColumn(name, F.xxhash64("text"))
    same = (keyed["doc_id"].cast("bigint") == kept["kept_doc_id"]) & (keyed[name] == kept["kept_key"])
    once = keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
    return once.unionByName(docs.filter(docs["doc_id"].isNull()))
