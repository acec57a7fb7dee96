"""Incremental library refresh: what a new listing changes of an old snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T


def snapshot_diff(old: DataFrame, listing: DataFrame) -> DataFrame:
    """path and status (reused, changed, added, deleted) of old and new (path, size, mtime), by normalised path.

    A file whose old state was never recorded is reused.
    """
    a = old.select(T.norm_path(F.col("path")).alias("key"), F.col("path").alias("old_path"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("was"))
    b = listing.select(T.norm_path(F.col("path")).alias("key"), F.col("path").alias("new_path"), "size", "mtime", F.lit(True).alias("now"))
    both = a.join(b, "key", "full_outer")
    unknown = F.col("old_size").isNull() & F.col("old_mtime").isNull()
    same = unknown | K.same_stat(F.col("old_size"), F.col("old_mtime"), F.col("size"), F.col("mtime"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(same, "reused").otherwise("changed")
    return both.select(F.coalesce("new_path", "old_path").alias("path"), "size", "mtime", status.alias("status"))


def refresh(old_tracks: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next snapshot: the reused tracks and the freshly read ones."""
    kept = old_tracks.join(diff.where("status = 'reused'").select("path"), "path", "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def deleted(old: DataFrame, listing: DataFrame) -> DataFrame:
    gone = listing.select(T.norm_path(F.col("path")).alias("__key")).distinct()
    return old.join(gone, T.norm_path(F.col("path")) == F.col("__key"), "left_anti")
