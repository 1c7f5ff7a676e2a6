"""Long texts held once: rows carry a reference in a text's place, and (ref, text) is a table of its own.

Where many rows share a text, what is written and shuffled grows with the rows and with
the different texts, not with both multiplied. References sort as their texts do, and a
blank or null value stands for itself; so operators that look at whether a text is
missing, or take the greatest, work on references as on texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmerge.functions.text import is_blank


def numbered(rows: DataFrame, text: str) -> DataFrame:
    """rows, of different or repeated texts, with ref; to be written before it is used, as numbers depend on how rows lie.

    Texts that are equal have references of their own, which sort next to each other.
    """
    place = F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    return rows.orderBy(text).withColumn("ref", F.when(is_blank(F.col(text)), F.col(text)).otherwise(place))


def met(df: DataFrame, column: str, side: DataFrame) -> DataFrame:
    """df with the columns of side (ref, ...), null where there is no such reference; blank ones are dealt by the row's other values."""
    plain = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    none = F.concat(F.lit("-"), F.xxhash64(*plain).cast("string"))
    keyed = df.withColumn("_ref", F.when(is_blank(F.col(column)), none).otherwise(F.col(column)))
    return keyed.join(side.withColumnRenamed("ref", "_ref"), "_ref", "left").drop("_ref")


def with_texts(df: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """df with the texts that a column refers to in its place; texts: (ref, text)."""
    found = met(df, column, texts.select("ref", F.col("text").alias("_text")))
    return found.select(*[F.coalesce("_text", F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def bounds_passed(key: Column, bounds: Column, n: int) -> Column:
    """How many of n bounds, an array in order, are no greater than key; by halves, so a row is compared with few of them."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(n.bit_length()))])
    passed = lambda at, step: F.coalesce(F.get(bounds, at + step - 1) <= key, F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(passed(at, step), at + step).otherwise(at))


#: Rows for each part of an ordered table that are looked at for the parts' bounds.
LOOKED_AT = 50
#: Bytes of texts that are handed to every executor whole; of more each range of an order gets its own.
HANDED = 64 << 20


def are_few(texts: DataFrame) -> bool:
    """Whether the texts, with what a row of them takes besides, have at most HANDED bytes; a small action."""
    size = texts.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n
    return (size or 0) <= HANDED


def ordered_with_texts(df: DataFrame, texts: DataFrame, column: str, order: list[str], parts: int | None = None) -> DataFrame:
    """with_texts() of df ordered by string columns, where a text crosses the shuffle once for each part it is needed in, or not at all.

    Rows are sorted while they hold references. Few texts, unless parts are named, are
    broadcast to the sorted rows, which leaves them as they lie. Else rows are dealt into ranges of the order by bounds from a bounded sample, chosen by
    hash, and sorted while they hold references; each range is then met by its own
    texts, in a hash join, which leaves the rows as they lie.
    """
    spark = df.sparkSession
    chosen = lambda rows: rows.select(*[F.coalesce("_text", F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
    if parts is None and are_few(texts):
        known = texts.select(F.col("ref").alias("_ref"), F.col("text").alias("_text"))
        rows = df.withColumn("_ref", F.when(~is_blank(F.col(column)), F.col(column))).orderBy(*[f"`{c}`" for c in order])
        rows = rows.withColumn("_place", F.monotonically_increasing_id()).filter("_place >= 0")  # as below
        return chosen(rows.join(F.broadcast(known), "_ref", "left"))
    parts = max(2, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"k{i}") for i, c in enumerate(order)])
    sample = df.select(key.alias("k"), F.xxhash64(*df.columns).alias("h")).orderBy("h").select("k").limit(parts * LOOKED_AT)
    at = sorted({tuple(r.k) for r in sample.collect()}, key=lambda k: [x.encode() for x in k])
    bounds = [at[len(at) * i // parts] for i in range(1, parts)] if len(at) >= parts else at[1:]
    if not bounds:  # all rows looked at are equals
        return with_texts(df, texts, column).orderBy(*[f"`{c}`" for c in order])
    part = bounds_passed(key, F.array(*[F.struct(*[F.lit(x).alias(f"k{i}") for i, x in enumerate(b)]) for b in bounds]), len(bounds))
    ref = F.when(~is_blank(F.col(column)), F.col(column))
    dealt = df.withColumns({"_part": part, "_ref": ref})
    asked = dealt.select("_part", "_ref").filter("_ref IS NOT NULL").distinct()
    own = asked.join(texts.select(F.col("ref").alias("_ref"), F.col("text").alias("_text")), "_ref").repartitionById(parts, "_part")
    # the place in the order is kept in use, else the optimizer takes the sort before the join for needless
    rows = dealt.repartitionById(parts, "_part").sortWithinPartitions(*[f"`{c}`" for c in order])
    rows = rows.withColumn("_place", F.monotonically_increasing_id()).filter("_place >= 0")
    return chosen(rows.join(own.hint("shuffle_hash"), ["_part", "_ref"], "left"))


def counted(texts: DataFrame, count: Column, name: str) -> DataFrame:
    """(ref, name): what is worked out of each text, once."""
    return texts.select("ref", count.alias(name))
