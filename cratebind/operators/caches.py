"""Manual choices and remembered matches: priority lookups and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from .scoring import memory_score
from .storage import stored


MINE, THEIRS = ["has_tags", "title_norm", "own_artist", "name_norm", "name_tokens"], ["t_title_norm", "t_artist_norm", "t_name_norm", "t_name_tokens"]


def first_valid(asked: DataFrame, entries: DataFrame, manual: DataFrame, tracks: DataFrame, good: Column, *shown: str) -> DataFrame:
    """eid, track_id, t_path, t_bitrate, score and the columns shown of the first of asked(eid, prio, chosen, ...) that is a track and fits.

    The paths of the table meet the tracks once, and what entries say each track once; only then do entries come in.
    """
    paths = manual.select(F.col("path").alias("chosen")).distinct().withColumn("__path", T.norm_path(F.col("chosen")))
    there = paths.join(tracks.withColumn("__path", T.norm_path(F.col("t_path"))), "__path")
    extra = ["__file"] if "__file" in tracks.columns else []
    known = stored(there.select("chosen", "track_id", "t_path", "t_bitrate", *THEIRS, *extra), "chosen-tracks")
    said = F.md5(F.to_json(F.struct(*MINE)))
    mine = entries.select("eid", *MINE).withColumn("said", said)
    want = stored(asked.join(mine.select("eid", "said"), "eid"), "asked-choices")
    pairs = want.select("said", "chosen").distinct().join(mine.drop("eid").dropDuplicates(["said"]), "said").join(known, "chosen")
    pairs = pairs.where("__file is null or not has_tags") if extra else pairs
    scored = stored(memory_score(pairs).select("said", "chosen", "has_tags", "track_id", "t_path", "t_bitrate", "score", "plain_name"), "scored-choices")
    row = F.struct("prio", "track_id", "t_path", "t_bitrate", "score", *shown)
    best = want.join(scored, ["said", "chosen"]).where(good).groupBy("eid").agg(F.min(row).alias("x"))
    return best.select("eid", *(F.col("x")[c].alias(c) for c in ("track_id", "t_path", "t_bitrate", "score", *shown)))


def manual_lookup(entries: DataFrame, manual: DataFrame, tracks: DataFrame, least: float = 50.0, listing: DataFrame | None = None) -> DataFrame:
    """eid with the track of its first manual choice that exists and still fits; manual(key, path).

    Of a label's keys only the first that is known counts, as a choice is looked up label by label. A file of listing(path) that is no
    track can be the choice of an entry without tags, which is held against its name; it has no track_id and a bitrate of 0.
    """
    labels = entries.select("eid", F.posexplode(K.manual_labels(F.col("raw_path"), F.col("artist"), F.col("title"))).alias("label_no", "label"))
    keyed = labels.select("eid", "label_no", F.posexplode(K.manual_keys(F.col("label"))).alias("key_no", "key")).join(manual.select("key", F.col("path").alias("chosen")), "key")
    named = keyed.groupBy("eid", "label_no").agg(F.min(F.struct("key_no", "chosen")).alias("x")).select("eid", "label_no", F.col("label_no").alias("prio"), "x.chosen")
    if listing is not None:
        files = listing.select(F.col("path").alias("t_path"), T.norm_path(F.col("path")).alias("__key")).dropDuplicates(["__key"])
        known = tracks.select(T.norm_path(F.col("t_path")).alias("__key")).distinct()
        name = T.norm(T.basename(F.col("t_path")))
        more = files.join(known, "__key", "left_anti").select("t_path", F.lit(0).alias("t_bitrate"), name.alias("t_name_norm"), T.words_of(name).alias("t_name_tokens"), F.lit("").alias("t_title_norm"), F.lit("").alias("t_artist_norm"), F.lit(True).alias("__file"))
        tracks = tracks.unionByName(more, allowMissingColumns=True)
    return first_valid(named, entries, manual, tracks, F.when(F.col("has_tags"), F.col("score") >= least).otherwise(F.col("plain_name") >= least), "label_no")


def learned_lookup(entries: DataFrame, learned: DataFrame, tracks: DataFrame, least_learned: float = 60.0, least_exact: float = 80.0) -> DataFrame:
    """eid with the track remembered under its first known key, if it still fits; learned(key, path).

    The exact digest counts only where no other key is known; `by` says which it was.
    """
    keys = F.concat(K.learned_keys(F.col("raw_path"), F.col("artist_norm"), F.col("canon"), F.col("duration"), F.col("name_norm")), F.array(F.col("eid")))
    asked = entries.select("eid", F.posexplode(keys).alias("prio", "key")).join(learned.select("key", F.col("path").alias("chosen")), "key")
    first = asked.groupBy("eid").agg(F.min(F.struct("prio", "key", "chosen")).alias("x")).select("eid", "x.prio", "x.chosen", F.when(F.col("x.key") == F.col("eid"), "exact").otherwise("learned").alias("by"))
    return first_valid(first, entries, learned, tracks, F.col("score") >= F.when(F.col("by") == "exact", least_exact).otherwise(least_learned), "by")


def upsert(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """old and new (key, path, bitrate and the order columns) with the last row of each key; new rows are later than old."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = F.struct("__new", *order)
    return both.groupBy("key").agg(F.max_by("path", last).alias("path"), F.max_by("bitrate", last).alias("bitrate"))


def last_learned(matches: DataFrame, tags: DataFrame, names: DataFrame) -> DataFrame:
    """learned_rows of matches(eid, path, bitrate, place, title, artist, duration, name) with, for each key, the row of the greatest place alone.

    Places differ from match to match. Of each name, and of each title, artist and duration, the last place is found first, where numbers
    alone are kept, then that of their keys; its path comes last. tags(title, artist, artist_norm, canon), names(name, name_norm).
    """
    last = F.max("place").alias("place")
    none = F.lit("")
    by_name = matches.groupBy("name").agg(last).join(names, "name")
    by_tags = matches.groupBy(F.col("title").alias("of_title"), F.col("artist").alias("of_artist"), "duration").agg(last)
    by_tags = by_tags.join(tags, F.col("of_title").eqNullSafe(F.col("title")) & F.col("of_artist").eqNullSafe(F.col("artist")))
    keys = [
        by_name.select(F.explode(K.learned_keys(none, none, none, F.lit(None).cast("double"), F.col("name_norm"))).alias("key"), "place"),
        by_tags.select(F.explode(K.learned_keys(none, F.col("artist_norm"), F.col("canon"), F.col("duration"), none)).alias("key"), "place"),
    ]
    known = keys[0].unionByName(keys[1]).groupBy("key").agg(last)
    rows = matches.select("place", "path", "bitrate")
    return matches.select(F.col("eid").alias("key"), "path", "bitrate", "place").unionByName(known.join(rows, "place").select("key", "path", "bitrate", "place"))


def manual_rows(choices: DataFrame) -> DataFrame:
    """choices(label, path, ...) as one row for each key of the label."""
    return choices.select("path", F.explode(K.manual_keys(F.col("label"))).alias("key"))


def learned_rows(matches: DataFrame) -> DataFrame:
    """What is to be remembered of resolved entries(eid, raw_path, artist_norm, canon, duration, path, bitrate)."""
    name = F.col("name_norm") if "name_norm" in matches.columns else None
    keys = F.concat(F.array(F.col("eid")), K.learned_keys(F.col("raw_path"), F.col("artist_norm"), F.col("canon"), F.col("duration"), name))
    return matches.select(F.explode(keys).alias("key"), "path", "bitrate", *[c for c in ("playlist", "pos") if c in matches.columns])
