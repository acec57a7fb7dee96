"""Intermediate results in the session's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders of sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only on one machine and where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        name = spark.sparkContext.applicationId
        found = _own_folders.setdefault(name, _own_folders.get(name) or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return found.rstrip("/")


def stored(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """df written to the session's shared folder and read again: reused by several phases without being worked out again.

    Of more than `most` rows, counted as they are written, joins shuffle it: Spark would judge it by its files, which hold repeated values
    once, and send hundreds of times the size that it looks for to the driver and from there to all.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    return kept.hint("merge") if rows.get["n"] > most else kept
