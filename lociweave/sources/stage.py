"""Tables between stages, in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def prepared(spark: SparkSession) -> None:
    """Lets Python workers on a shared disk import this package."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in [ROOT, *paths] if x)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='lociweave-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The same rows from a parquet table in the shared folder: no lineage, and a statistics base for the next stage."""
    path = f"{shared_folder(df.sparkSession)}/lociweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
