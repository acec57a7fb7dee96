"""Playlist repair from end to end: read, refresh the library, match, remember, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import caches, normalise
from ..operators.storage import stored
from ..sources import library, playlists
from ..sources.options import Options
from ..sources.store import Memory
from .cascade import match, on_disk


def preview(entries: DataFrame, tracks: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """playlist, pos, raw_path, route_valid, bitrate and label, before anything is matched.

    A route is valid if its file is in listing(path), where one is given, else if it is in the library.
    """
    there = on_disk(tracks.select(F.col("path").alias("t_path"), F.coalesce("bitrate", F.lit(0)).alias("t_bitrate")), listing)
    both = entries.join(there, T.norm_path(F.col("raw_path")) == F.col("__path"), "left")
    return both.select("playlist", "pos", "raw_path", F.col("__path").isNotNull().alias("route_valid"), F.coalesce("bitrate", F.lit(0)).alias("bitrate"), T.entry_label(F.col("artist"), F.col("title"), F.col("raw_path")).alias("label"))


def repair(
    spark: SparkSession, playlist_paths: str | list[str], snapshot: str, out: str | None, manual: DataFrame | None = None, learned: DataFrame | None = None,
    relative_to: str | None = None, recursive: bool = False, memory: Memory | None = None, **options,
) -> tuple[DataFrame, DataFrame]:
    """Write the repaired playlists below `out`, or beside their sources; the matches and the new table of remembered matches.

    Every playlist gets a file, also one of which nothing was found. A memory gives what is not given here of remembered matches, choices
    and aliases, and takes in what was found.
    """
    if memory is not None:
        manual = memory.manual.read() if manual is None else manual
        learned = memory.learned.read() if learned is None else learned
        options.setdefault("aliases", memory.aliases.read())
    tracks, postings = library.read_snapshot(spark, snapshot)
    texts = playlists.read_texts(spark, playlist_paths, recursive)
    entries = stored(playlists.entries_of_lines(playlists.lines_of(texts)), "playlist-entries")
    results = stored(match(entries, tracks, postings, manual, learned, **options), "matches")
    playlists.write_playlists(playlists.output_rows(entries, results, tracks), out, relative_to, texts.select("playlist"))
    forms = normalise.normalise_entries(entries).select("eid", "raw_path", "artist_norm", "canon", "duration")
    said = entries.select("playlist", "pos", normalise.entry_id().alias("eid")).join(results.where("found").select("playlist", "pos", "path", "bitrate"), ["playlist", "pos"])
    resolved = said.join(forms, "eid")
    new = caches.learned_rows(resolved)
    if memory is not None:
        memory.remember(new, ["playlist", "pos"])
    old = learned if learned is not None else spark.createDataFrame([], "key string, path string, bitrate int")
    return results, caches.upsert(old, new, ["playlist", "pos"])


def repair_as_set(spark: SparkSession, options: Options, snapshot: str, manual: DataFrame | None = None, learned: DataFrame | None = None, **more) -> tuple[DataFrame, DataFrame]:
    """repair, of the playlists that the options name, to the place and with the threshold that they give."""
    whole = options.batch_playlists_root
    source = whole or options.playlist_path
    if not source:
        raise ValueError("the options name no playlist")
    out = options.dest_folder.strip() if options.dest_mode != "original" and options.dest_folder.strip() else None
    structure = whole if whole and out and options.keep_structure else None
    return repair(spark, source, snapshot, out, manual, learned, structure, bool(whole) and options.include_subdirs, threshold=float(options.threshold), **more)
