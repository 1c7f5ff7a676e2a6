"""What the operators share: table access, shared scratch tables, word rules."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch for columns of whole texts: bounds a worker's memory.
TEXT_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a local master (tests on one machine) gets a
    temporary folder, set as the context's checkpoint folder; any other master has
    executors with disks of their own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/shelfmerge/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df as a shared Parquet table and rereads it: cuts the lineage, and
    the rows survive the loss of executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """About the n first of total rows by the hash of their keys, at most n.

    Nearly all others are dropped where they are read, so what reaches the driver
    does not grow with the number of partitions.
    """
    span, order = 1 << 40, F.xxhash64(*keys)
    few = df.filter(F.pmod(order, F.lit(span)) < min(span, 2 * n * span // max(1, total) + 1))
    return few.orderBy(F.pmod(order, F.lit(span)), *keys).limit(n)


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to TEXT_BATCH, as batches carry whole texts.

    Spark reads the setting when a plan runs, not when it is made, so it stays lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH:
        spark.conf.set(name, str(TEXT_BATCH))


def in_text_batches(df: DataFrame, run: Callable, schema: Any) -> DataFrame:
    """df.mapInArrow(run, schema) over batches small enough for whole texts."""
    text_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def per_worker(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """What make() returns, kept for the later tasks of this Python worker; of each kind the last one alone."""
    kept = sys.modules.setdefault("_shelfmerge_worker", types.ModuleType("_shelfmerge_worker")).__dict__
    held = kept.setdefault("held", {})
    if held.get(kind, (None,))[0] != (key,):
        held.pop(kind, None)
        held[kind] = ((key,), make())
    return held[kind][1]
