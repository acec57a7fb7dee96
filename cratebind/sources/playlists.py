"""Playlist text: discovery, parsing into ordered entries, and writing."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import text as T
from .files import put

# fixed values: file endings of media lines
MEDIA = [".mp3", ".mp4", ".m4a", ".flac", ".wav", ".wma", ".aac", ".webm", ".ogg", ".mkv", ".avi"]
# fixed values: endings of library files
AUDIO = [".mp3", ".flac", ".wav", ".m4a"]
# fixed values: the mark of metadata lines, and the names of generated playlists
META = "#EXTVDJ:"
GENERATED = r"(?i)_actualizada(_actualizada)?\.(m3u8?|m3u)$"


def is_media_line(line: Column) -> Column:
    """A service address, or a path that ends like media and holds no markup."""
    low = F.lower(T.strip(line))
    ending = F.lit(False)
    for e in MEDIA:
        ending |= F.endswith(low, F.lit(e))
    return (low != "") & ~F.startswith(low, F.lit("#")) & (F.startswith(low, F.lit("netsearch://")) | (ending & ~low.rlike("[<>]")))


def is_path_line(line: Column) -> Column:
    return (T.strip(line) != "") & ~F.startswith(T.strip(line), F.lit("#"))


def is_generated(path: Column) -> Column:
    return T.basename(path).rlike(GENERATED)


def base_name(path: Column) -> Column:
    """A playlist's name without ending and without what generation adds."""
    return F.regexp_replace(T.stem(T.basename(path)), "(?i)(_actualizada)+$", "")


def without_scheme(path: Column | str) -> Column:
    """A path without the scheme and host of its file system; drive letters stay."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?(?=/)", "")


def output_path(path: Column, root: str | None = None, relative_to: str | None = None) -> Column:
    """Where a repaired playlist goes: beside its source, or below root, there optionally in its own folder.

    Folders are compared without their schemes; a list that is not below relative_to goes straight into root.
    """
    name = F.concat(base_name(path), F.lit("_actualizada.m3u"))
    folder = F.regexp_replace(path, r"[^/\\]*$", "")
    if root is None:
        return F.concat(folder, name)
    root = root.rstrip("/") + "/"
    if relative_to is None:
        return F.concat(F.lit(root), name)
    above = re.sub(r"/+", "/", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]+:(//[^/]*)?(?=/)", "", relative_to)).rstrip("/") + "/"
    plain = F.regexp_replace(without_scheme(folder), "/+", "/")
    own = F.when(F.startswith(plain, F.lit(above)), plain.substr(F.lit(len(above) + 1), F.length(plain))).otherwise("")
    return F.concat(F.lit(root), own, name)


def discover(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Paths of the playlists below root that are not generated ones; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path")
    return files.where(F.lower("path").rlike(r"\.m3u8?$") & ~is_generated(F.col("path"))).distinct().orderBy("path")


def tags(line: Column) -> Column:
    """The `<key>value</key>` pairs of a metadata line as a map: lower-case keys, the last of a key wins."""
    pattern = F.lit(r"(?i)<([^>]+)>(.*?)</\1>")
    names = F.transform(F.regexp_extract_all(line, pattern, F.lit(1)), lambda k: F.lower(T.strip(k)))
    values = F.transform(F.regexp_extract_all(line, pattern, F.lit(2)), lambda v: T.strip(v))
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: x["k"] != "")
    last = F.filter(F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))), lambda x: ~F.exists(F.slice(pairs, x["i"] + 2, 1_000_000), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))


def entries_of_lines(lines: DataFrame) -> DataFrame:
    """lines(playlist, line_no, line) as ordered entries.

    A media line takes the last metadata line since the media line before it; other lines between do not clear it.
    """
    clean = lines.select("playlist", "line_no", T.strip(F.regexp_replace("line", "\ufeff", "")).alias("line"))
    media, meta = is_media_line(F.col("line")), F.startswith("line", F.lit(META))
    used = clean.select("*", (media & ~meta).alias("media"), F.when(meta, F.col("line")).alias("meta")).where("media or meta is not null")
    before = Window.partitionBy("playlist").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    grouped = used.withColumn("pos", F.coalesce(F.count_if("media").over(before), F.lit(0)).cast("int"))
    rows = grouped.groupBy("playlist", "pos").agg(F.max_by("meta", F.when(F.col("meta").isNotNull(), F.col("line_no"))).alias("meta"), F.max(F.when(F.col("media"), F.col("line"))).alias("raw_path"))
    parsed = rows.where("raw_path is not null").withColumn("m", F.when(F.col("meta").isNotNull(), tags(F.col("meta"))))
    m = lambda k: F.try_element_at("m", F.lit(k))
    known = ["title", "artist", "remix", "songlength", "filesize", "lastplaytime"]
    return parsed.select(
        "playlist", "pos", "raw_path", m("title").alias("title"), T.repaired_artist(m("artist"), m("title")).alias("artist"), m("remix").alias("remix"),
        m("songlength").try_cast("double").alias("duration"), m("filesize").try_cast("double").cast("long").alias("filesize"), m("lastplaytime").try_cast("double").cast("long").alias("lastplaytime"),
        F.map_filter("m", lambda k, v: ~k.isin(known)).alias("extra"), (F.size("m") > 0).alias("has_meta"),
    )


def file_path() -> Column:
    """The path of the file that a row was read from, as it reads: Spark tells it with its blanks and such encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def lines_of(whole: DataFrame) -> DataFrame:
    """(playlist, line_no, line) of whole texts (playlist, value), without bytes that are no text."""
    return whole.select("playlist", F.posexplode(F.split(F.translate("value", "\ufffd", ""), r"\r\n|\n|\r")).alias("line_no", "line"))


def read_texts(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """(playlist, value): the texts of the playlists at or below paths, generated ones left out where folders are read through."""
    found = spark.read.option("wholetext", "true")
    if recursive:
        found = found.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{m3u,m3u8,M3U,M3U8}")
    texts = found.text(paths).select(file_path().alias("playlist"), "value")
    return texts.where(~is_generated(F.col("playlist"))) if recursive else texts


def read_playlists(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Entries of playlist files, each with its file and position; bytes that are no text are left out."""
    return entries_of_lines(lines_of(read_texts(spark, paths, recursive)))


def media_lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(playlist, line_no, line): the media lines of playlists, of finished ones too."""
    return lines_of(read_texts(spark, paths)).where(is_media_line(F.col("line")))


def meta_line(filesize: Column, lastplaytime: Column, artist: Column, title: Column, remix: Column, duration: Column) -> Column:
    """A metadata line of what is known, in fixed order."""

    def tag(name: str, value: Column, shown: Column) -> Column:
        return F.when(value, F.concat(F.lit(f"<{name}>"), shown, F.lit(f"</{name}>"))).otherwise("")

    texts = [tag(n, T.text(c) != "", c) for n, c in (("artist", artist), ("title", title), ("remix", remix))]
    numbers = [tag(n, c.isNotNull(), c.cast("long").cast("string")) for n, c in (("filesize", filesize), ("lastplaytime", lastplaytime))]
    return F.concat(F.lit(META), *numbers, *texts, tag("songlength", duration.isNotNull(), F.format_string("%.3f", duration)))


def output_rows(entries: DataFrame, results: DataFrame, tracks: DataFrame) -> DataFrame:
    """playlist, pos, meta and path of every resolved entry: library tags over the entry's, play time from the entry.

    results(playlist, pos, path); the join is by position, so repeated paths with different outcomes stay apart.
    """
    e = entries.select("playlist", "pos", "title", "artist", "remix", "duration", "filesize", "lastplaytime").join(results.where("path is not null").select("playlist", "pos", "path"), ["playlist", "pos"])
    t = tracks.select(F.col("path").alias("path"), F.col("title").alias("t_title"), F.col("artist").alias("t_artist"), F.col("duration").alias("t_duration"), *(["size"] if "size" in tracks.columns else [F.lit(None).cast("long").alias("size")]))
    over = lambda a, b: F.when(T.text(a) != "", F.col(a)).otherwise(F.col(b))
    line = meta_line(F.coalesce("size", "filesize"), F.col("lastplaytime"), over("t_artist", "artist"), over("t_title", "title"), F.col("remix"), F.coalesce("t_duration", "duration"))
    return e.join(t, "path", "left").select("playlist", "pos", line.alias("meta"), "path")


def playlist_texts(rows: DataFrame) -> DataFrame:
    """playlist and its text; a playlist is one file, so its lines meet in one row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "meta", "path"))), lambda x: F.concat(x["meta"], F.lit("\n"), x["path"], F.lit("\n")))
    return rows.groupBy("playlist").agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(lines, "")).alias("text"))


class PlaylistWriter(DataSourceWriter):
    """Writes each row's text to its output path, on the executors. A file is moved into place when it is whole.

    A task that is run again writes the same files again; what a failed write left hidden is never read.
    """

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        mark = uuid.uuid4().hex
        for row in iterator:
            put(row["output"], mark, row["text"].encode("utf-8", "ignore"))
        return WriterCommitMessage()


class PlaylistFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "playlist_files"

    def schema(self) -> str:
        return "output string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PlaylistWriter()


def write_playlists(rows: DataFrame, folder: str | None = None, relative_to: str | None = None, playlists: DataFrame | None = None) -> DataFrame:
    """One text file for each playlist at its output path, written by the executors; the paths as playlist, output.

    playlists(playlist) are to have a file even where they have no rows. Two playlists with one output path are an error, before
    anything is written: relative_to keeps their folders apart.
    """
    spark = rows.sparkSession
    every = (rows.select("playlist") if playlists is None else playlists.select("playlist")).distinct()
    named = every.select("playlist", output_path(F.col("playlist"), folder, relative_to).alias("output"))
    twice = named.groupBy("output").agg(F.count("*").alias("n")).where("n > 1").take(1)
    if twice:
        raise ValueError(f"several playlists would be written to {twice[0]['output']}")
    texts = named.join(playlist_texts(rows), "playlist", "left").select("output", F.coalesce("text", F.lit("#EXTM3U\n")).alias("text"))
    spark.dataSource.register(PlaylistFiles)
    texts.repartition("output").write.format("playlist_files").mode("append").save()
    return named
