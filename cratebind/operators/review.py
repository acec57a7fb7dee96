"""What people decide after matching: how well a chosen path fits, whether a pick needs confirmation, and the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from .scoring import name_score, tag_score


def score_choice(chosen: DataFrame, tracks: DataFrame) -> DataFrame:
    """eid, path, score, track_id of entries in their forms, each with the `path` chosen for it; 0 for a path that is no track's.

    Entries with tags are scored as the tag phase scores them, others by their file names; to two places.
    """
    there = tracks.withColumn("__key", T.norm_path(F.col("t_path")))
    both = chosen.withColumn("__key", T.norm_path(F.col("path"))).join(there, "__key", "left")
    tagged, named = tag_score(both.where("has_tags and track_id is not null")), name_score(both.where("not has_tags and track_id is not null"))
    gone = both.where("track_id is null").withColumn("score", F.lit(0.0))
    shown = ["eid", "path", F.round(F.coalesce("score", F.lit(0.0)), 2).alias("score"), "track_id"]
    return tagged.select(*shown).unionByName(named.select(*shown)).unionByName(gone.select(*shown))


def needs_confirmation(raw_path: Column, path: Column, least: float = 60.0) -> Column:
    """Whether a file chosen by hand is so unlike the entry's own file that it should be confirmed: by both names, endings included."""
    return S.rough_similarity(T.basename(raw_path), T.basename(path)) < least


def resolve(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """results(playlist, pos, raw_path, phase, found, path, ...) after decisions(playlist, pos, action, path).

    `choose` takes the decision's path, `valid` keeps the entry's own, `skip` leaves it missing; the last of a place counts by
    `order`, where there is such a column. Places without a decision stay as they are.
    """
    last = F.struct("order", "action", "path") if "order" in decisions.columns else F.struct("action", "path")
    said = decisions.groupBy("playlist", "pos").agg(F.max(last).alias("__d"))
    d = F.col("__d")
    action = d["action"]
    path = F.when(action == "choose", d["path"]).when(action == "valid", F.col("raw_path")).when(action == "skip", F.lit(None)).otherwise(F.col("path"))
    phase = F.when(action == "choose", "manual").when(action == "valid", "valid_path").when(action == "skip", "skipped").otherwise(F.col("phase"))
    both = results.join(said, ["playlist", "pos"], "left").withColumns({"path": path, "phase": phase})
    return both.withColumn("found", F.col("path").isNotNull()).select(*results.columns)


def in_order(results: DataFrame) -> DataFrame:
    """Results in the order of their playlists."""
    return results.orderBy("playlist", "pos")
