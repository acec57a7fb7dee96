"""Decisions by hand after a run: results, playlists and memory follow in one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.review import resolve
from ..operators.storage import stored
from ..sources import playlists
from ..sources.store import Memory


def decide(entries: DataFrame, results: DataFrame, decisions: DataFrame, tracks: DataFrame, memory: Memory | None = None, out: str | None = None, relative_to: str | None = None) -> DataFrame:
    """The results after decisions(playlist, pos, action, path), with the playlists that these touch written anew.

    `choose` is also remembered, under the keys of the entry's path. Playlists without a decision are neither read nor written, and one
    whose last entry was skipped keeps its header.
    """
    after = stored(resolve(results, decisions), "decided")
    touched = stored(decisions.select("playlist").distinct(), "touched")
    some = lambda df: df.join(touched, "playlist", "left_semi")
    rows = playlists.output_rows(some(entries), some(after).select("playlist", "pos", "path"), tracks)
    if memory is not None:
        chosen = decisions.where("action = 'choose' and path is not null").join(entries.select("playlist", "pos", F.col("raw_path").alias("label")), ["playlist", "pos"])
        if chosen.take(1):
            memory.choose(chosen.select("label", "path", *(["order"] if "order" in decisions.columns else [])))
    playlists.write_playlists(rows, out, relative_to, some(entries.select("playlist").distinct()))
    return after
