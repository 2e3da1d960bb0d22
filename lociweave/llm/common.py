"""What the operators of this subpackage share: table access, scratch space, batch helpers, hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is hot when it holds more than this share of all rows; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 1000
ROOT = str(Path(__file__).resolve().parents[2])
#: Arrow batches are cut at this many bytes, so long texts don't pile up in a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> None:
    """Cuts Arrow batches by bytes too, and lets Python workers on a shared disk import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *paths] if x)


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names; one of our own only where that is unset and all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='lociweave-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lociweave-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from a table written in the shared folder: cuts the lineage, survives lost executors."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def groups_of(items: list[str], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each; a longer text is alone."""
    start = total = 0
    for i, x in enumerate(items):
        if total and total + len(x) > most:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(items):
        yield start, len(items)


def left_join_hot(rows: DataFrame, key: str, side: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``rows`` left-joined with ``side`` (one row per key) on ``key``, without sending a hot key to one task.

    ``counts``: (key, n), for the keys of ``side`` at least. Keys with more than HOT_SHARE of ``total`` rows,
    at most 1 / HOT_SHARE of them, are broadcast; the rest is shuffled, rows of hot keys being spread evenly.
    """
    least = max(100, int((total or 0) * HOT_SHARE))
    hot = counts.where(F.col("n") > least).select(F.col(key).alias("_hot")).limit(int(1 / HOT_SHARE) + 1)
    values = [c for c in side.columns if c != key]
    big = side.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")))
    big = big.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_b_{c}") for c in values], F.lit(True).alias("_big"))
    rest = side.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left_anti")
    rest = rest.select(F.col(key).alias("_key2"), *[F.col(c).alias(f"_r_{c}") for c in values], F.lit(0).alias("_salt2"))
    out = rows.join(F.broadcast(big), F.col(key).eqNullSafe(F.col("_key")), "left")
    out = out.withColumn("_salt", F.when(F.col("_big"), F.floor(F.rand(7) * 1e6).cast("int") + 1).otherwise(F.lit(0)))
    out = out.join(rest, F.col(key).eqNullSafe(F.col("_key2")) & (F.col("_salt") == F.col("_salt2")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_b_{c}", f"_r_{c}").alias(c) for c in values])
