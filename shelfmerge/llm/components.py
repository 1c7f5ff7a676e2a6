"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmerge.llm.common import materialise


def star(links: DataFrame, large: bool) -> DataFrame:
    """One star operation. links: (u, v), u > v, each once.

    Large: every node links its larger neighbours to the smallest node it sees.
    Small: every node links its smaller neighbours, and itself, to the smallest.
    """
    seen = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        # a node v smaller than u keeps its link; nodes above u move to the smallest
        moved = links.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select("v", "m")
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def fingerprint_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    links: columns u, v of one orderable type; direction, repeats and loops do not
    matter. Each round writes its links to the shared folder; the number of rounds
    grows with the logarithm of the longest chain.
    """
    links = (
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    links = materialise(links, "links")
    state = fingerprint_of(links)
    while state[0]:
        after = materialise(star(star(links, large=True), large=False), "links")
        now = fingerprint_of(after)
        links = after
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
