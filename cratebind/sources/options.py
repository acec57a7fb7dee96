"""Options kept between runs, the choice of playlists, and clearing what a store remembers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from .playlists import discover


@dataclass
class Options:
    folder_path: str = ""
    playlist_path: str = ""
    batch_playlists_root: str = ""
    include_subdirs: bool = True
    dest_mode: str = "same"
    dest_folder: str = ""
    keep_structure: bool = False
    threshold: int = 70
    open_manual_during_batch: bool = False


def read_options(spark: SparkSession, path: str) -> Options:
    """Options from a JSON object; what is missing, unknown or of another type has its default."""
    try:
        found = json.loads(spark.read.option("wholetext", "true").text(path).first()["value"])
    except Exception:  # noqa: BLE001 - an unreadable file is as good as none
        return Options()
    plain = Options()
    known = {f.name: type(getattr(plain, f.name)) for f in fields(Options)}
    return Options(**{k: v for k, v in found.items() if k in known and isinstance(v, known[k])} if isinstance(found, dict) else {})


def write_options(spark: SparkSession, options: Options, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(options)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def selected_playlists(spark: SparkSession, options: Options, explicit: list[str] | None = None) -> DataFrame:
    """path of the playlists to work on: those named, else those below the batch folder, else the single one."""
    if explicit:
        return spark.createDataFrame([(p,) for p in explicit], "path string")
    if options.batch_playlists_root:
        return discover(spark, options.batch_playlists_root, options.include_subdirs)
    return spark.createDataFrame([(options.playlist_path,)] if options.playlist_path else [], "path string")


def purge(spark: SparkSession, *paths: str) -> list[str]:
    """Delete state files and folders; those that were there."""
    gone = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True):
            gone.append(path)
    return gone
