"""Writing tables, exports and worklists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmerge.operators.reports import EXPORT, scan_all
from shelfmerge.operators.worklist import chunk_worklist, combine_sources


def plain(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, as CSV needs them."""
    nested = ("array", "map", "struct", "variant")
    return df.select(*[(F.to_json(c) if t.startswith(nested) else F.col(f"`{c}`")).alias(c) for c, t in df.dtypes])


def write_union_csv(path: str, *dfs: DataFrame) -> None:
    """Rows of all sources under the union of their columns."""
    combine_sources(*[plain(d) for d in dfs]).write.mode("overwrite").option("header", True).csv(path)


def standard_columns(df: DataFrame, full: bool = False) -> DataFrame:
    """The standard columns; in full, any others after them, sorted."""
    std = list(EXPORT.values())
    missing = [F.lit("").alias(c) for c in std if c not in df.columns]
    out = df.select("*", *missing)
    return out.select(*std, *(sorted(c for c in df.columns if c not in std) if full else []))


def write_standard(df: DataFrame, path: str, mode: str = "append", full: bool = False) -> None:
    plain(standard_columns(df, full)).write.mode(mode).option("header", True).csv(path)


def export_by_isbn(std: DataFrame, isbns: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """The listed numbers' rows under the export names, ordered; texts as in scan_all()."""
    return scan_all(std.join(isbns.select("isbn").distinct(), "isbn", "left_semi"), texts)


def export_master(master: DataFrame, path: str) -> None:
    master.write.mode("overwrite").option("header", True).csv(path)


def write_worklist(df: DataFrame, path: str, column: str = "raw") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_chunks(df: DataFrame, path: str, n: int = 50, column: str = "raw") -> None:
    """A folder for each n lines."""
    chunks = chunk_worklist(df, n).select(F.col(column).alias("value"), "chunk")
    chunks.repartition("chunk").sortWithinPartitions("chunk").write.mode("overwrite").partitionBy("chunk").text(path)
