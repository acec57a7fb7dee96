"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        name = spark.sparkContext.applicationId
        found = _own_folders.setdefault(name, _own_folders.get(name) or f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return found.rstrip("/")


#: The paths that each open scratch has to delete, the innermost last.
_scratches: list[list[str]] = []
#: Where each frame that `keep` gave is.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def keep(df: DataFrame, name: str, codec: str = "snappy", result: bool = False, large: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives lost executors.

    `large` rows, of up to some MB each, are cut into small row groups, whose size is else first looked at after 100 rows.
    Within a scratch it is deleted at the scratch's end; a `result` is left to the scratch around it, if any.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_scratches) > result:
        _scratches[-1 - result].append(path)
    more = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1} if large else {}
    df.write.option("compression", codec).options(**more).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    _places[kept] = path
    return kept


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths of the shared folder, and the shuffle files of frames that nothing refers to any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark._jvm.System.gc()  # Spark's cleaner removes the shuffles of collected frames


def forget(*kept: DataFrame) -> None:
    """Delete what was kept, before the end of any scratch: nothing that is still to be read may come from it."""
    delete(kept[0].sparkSession, [_places.pop(df) for df in kept])


#: What bounds a task's memory: bytes of a batch that goes to Python, of a split that it reads, of a row group that it holds to write.
BATCH, SPLIT, ROW_GROUP = 8 << 20, 32 << 20, 8 << 20


@contextmanager
def bounded(spark: SparkSession) -> Iterator[None]:
    """What is run and kept inside moves in bounded batches, whatever the size of the input; the session's settings come back at the end."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH, "spark.sql.files.maxPartitionBytes": SPLIT}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, most in wanted.items():
            spark.conf.set(name, str(most))
        yield
    finally:
        for name, old in before.items():
            spark.conf.unset(name) if old is None else spark.conf.set(name, old)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is kept inside is deleted at the end, shuffle files of frames that nothing refers to any more as well."""
    _scratches.append([])
    try:
        yield
    finally:
        delete(spark, _scratches.pop())


def remainder(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns alone, so that further columns cannot clash."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *map(F.col, more))


def slices(texts: Sequence[str], limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with at most `limit` characters, or one longer text; bounds a task's arrays."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def spread_join(left: DataFrame, right: DataFrame, key: str, spread: str, share: int = 256, salts: int = 32) -> DataFrame:
    """left joined to the right's row of the same key, if any; left is stored, right has one row for a key.

    Keys that hold more than 1 / share of the left's rows, fewer than `share` of them, are spread over several tasks.
    """
    hot = left.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(1, left.count() // share)).select(key, F.lit(True).alias("__hot"))
    hot = F.broadcast(keep(hot, "hot-keys"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    there = right.join(hot, key, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(hot, key, "left").withColumn("__salt", salt).drop("__hot").join(there, [key, "__salt"], "left").drop("__salt")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
