"""The library: file listing, tags from file names, snapshots and their index."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.normalise import token_postings
from ..operators.snapshot import refresh, snapshot_diff
from .playlists import AUDIO
from .tags import read_tags

INDEX_SCHEMA = "path string, tags struct<title:string,artist:string,duration:double,bitrate:int,auto_tags:boolean>, stat struct<size:bigint,mtime:double>"
INDEX_VERSION = "2"


def list_audio(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, mtime of the audio files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").rlike(r"\.(" + "|".join(e[1:] for e in AUDIO) + ")$")).select("path", F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"))


def tags_of_name(path: Column, title: Column, artist: Column) -> tuple[Column, Column, Column]:
    """Title, artist and whether they were derived, for a file's own tags: from its name if it has none, from its title if only the
    artist lacks."""
    name = T.collapse(F.regexp_replace(T.stem(T.basename(path)), "_+", " "))
    name = F.regexp_replace(F.trim(name), r"\s*[\[\(].*?[\]\)]\s*", "")
    parts, two = F.split(name, " - ", 2), F.instr(name, " - ") > 0
    bare = (T.text(title) == "") & (T.text(artist) == "")
    named = artist.isNull() & (F.instr(T.text(title), " - ") > 0)
    own = F.split(title, " - ", 2)
    who, what = F.trim(own[0]), F.trim(own[1])
    rest = F.when(F.startswith(F.lower(what), F.lower(who)), F.trim(F.regexp_replace(what.substr(F.length(who) + 1, F.length(what)), "^[-: ]+", ""))).otherwise(what)
    new_title = F.when(bare, F.when(two, F.trim(parts[1])).otherwise(F.trim(name))).when(named, rest).otherwise(title)
    new_artist = F.when(bare, F.when(two, F.trim(parts[0]))).when(named, who).otherwise(artist)
    return new_title, new_artist, bare | named


def tracks_of_files(files: DataFrame) -> DataFrame:
    """files(path, title, artist, duration, bits_per_second, size, mtime), tags null where unread, as tracks."""
    title, artist, derived = tags_of_name(F.col("path"), F.col("title"), F.col("artist"))
    return files.select("path", title.alias("title"), artist.alias("artist"), "duration", F.bround(F.col("bits_per_second") / 1000, 0).cast("int").alias("bitrate"), derived.alias("auto_tags"), "size", "mtime")


def numbered(tracks: DataFrame) -> DataFrame:
    """Tracks with an id that follows from the path, so that refreshes keep it."""
    return tracks.withColumn("track_id", F.xxhash64("path"))


def read_json_index(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of records with tags and stat, or with `lines` a record a line, as tracks; those without tags are left out."""
    rows = spark.read.schema(INDEX_SCHEMA).option("multiLine", str(not lines).lower()).json(path).where("tags is not null")
    return rows.select("path", "tags.*", F.col("stat.size").alias("size"), F.col("stat.mtime").alias("mtime"))


def write_json_index(tracks: DataFrame, folder: str) -> None:
    """Tracks as JSON records with tags and stat, one a line, in the layout that read_json_index takes."""
    tags, stat = F.struct("title", "artist", "duration", "bitrate", "auto_tags"), F.struct("size", "mtime")
    tracks.select("path", tags.alias("tags"), stat.alias("stat")).write.mode("overwrite").json(folder)


def ready(spark: SparkSession, version: str) -> bool:
    """Whether a snapshot is of this version of the format and holds tracks and postings."""
    if not version.rstrip("/").rpartition("/")[2].startswith(f"v{INDEX_VERSION}-"):
        return False
    try:
        return bool(spark.read.parquet(f"{version}/tracks").take(1)) and bool(spark.read.parquet(f"{version}/postings").take(1))
    except AnalysisException:
        return False


def write_snapshot(tracks: DataFrame, folder: str) -> str:
    """Write tracks and their postings as a new version below folder; its path. Readers of the former version go on."""
    version = f"{folder.rstrip('/')}/v{INDEX_VERSION}-{uuid.uuid4().hex}"
    tracks.write.parquet(f"{version}/tracks")
    stored = tracks.sparkSession.read.parquet(f"{version}/tracks")
    token_postings(stored).repartition("token_type", "token").sortWithinPartitions("token").write.partitionBy("token_type").parquet(f"{version}/postings")
    return version


def read_snapshot(spark: SparkSession, version: str) -> tuple[DataFrame, DataFrame]:
    """Tracks and postings of a snapshot of this version of the format."""
    if not version.rstrip("/").rpartition("/")[2].startswith(f"v{INDEX_VERSION}-"):
        raise ValueError(f"{version} is not of version {INDEX_VERSION}")
    return spark.read.parquet(f"{version}/tracks"), spark.read.parquet(f"{version}/postings")


def refresh_library(spark: SparkSession, folder: str, store: str, former: str | None = None) -> str:
    """Bring the snapshot of a music folder up to date; only new and changed files are read."""
    listing = list_audio(spark, folder)
    if former is None:
        return write_snapshot(numbered(tracks_of_files(read_tags(listing))), store)
    old = spark.read.parquet(f"{former}/tracks")
    diff = snapshot_diff(old, listing)
    if not diff.where("status <> 'reused'").take(1):
        return former
    fresh = numbered(tracks_of_files(read_tags(diff.where("status in ('added', 'changed')").select("path", "size", "mtime"))))
    return write_snapshot(refresh(old, diff, fresh), store)
