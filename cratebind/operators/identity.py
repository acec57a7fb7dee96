"""Joins on what a recording is: the best track of an identity, similar tags, aliases, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys as K
from ..functions import text as T
from .blocking import set_id
from .scoring import best_bitrate, prefer

KEY = ["k_artist", "k_canon", "k_bucket", "k_remix"]


def exploded(df: DataFrame, keys: Column, *columns: str) -> DataFrame:
    found = df.select(*columns, F.posexplode(keys).alias("k_no", "k"))
    return found.select(*columns, "k_no", F.col("k.artist").alias("k_artist"), F.col("k.canon").alias("k_canon"), F.col("k.bucket").alias("k_bucket"), F.col("k.remix").alias("k_remix"))


def identity_best(tracks: DataFrame) -> DataFrame:
    """The highest bitrate track of each identity key, the first on ties; once among all, once among real tags."""
    keys = K.identity_keys(F.col("t_fallback"), F.col("t_pure_canon"), F.col("t_pure_remix"), F.col("t_duration"), 0)
    rows = exploded(tracks, keys, "track_id", "t_bitrate", "t_auto")
    # by bitrate first, where numbers alone are kept; a key then has as many rows as it has bitrates
    rated = rows.groupBy(*KEY, "t_bitrate").agg(F.min("track_id").alias("any"), F.min(F.when(~F.col("t_auto"), F.col("track_id"))).alias("real"))
    best = rated.groupBy(*KEY).agg(F.max_by("any", "t_bitrate").alias("best_all"), F.max_by("real", F.when(F.col("real").isNotNull(), F.col("t_bitrate"))).alias("best_real"))
    return best


def similar_tags(tolerance: float = 3.0) -> Column:
    """Whether a track has an entry's title and artist, and both durations are known and near."""
    own = T.artists_compatible(F.col("artist_norm"), F.col("t_artist_norm"), F.col("parts"), F.col("t_parts"))
    near = F.abs(F.col("duration") - F.col("t_duration")) <= tolerance
    return (F.col("canon") != "") & (F.col("canon") == F.col("t_canon")) & own & F.coalesce(near, F.lit(False))


def identity_match(entries: DataFrame, tracks: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """eid and its track of the first identity key that holds one that fits: real tags before all, keys in order.

    Entries that say the same of their recording are looked up once.
    """
    best = identity_best(tracks) if best is None else best
    named = entries.where("has_tags").withColumn("said", F.md5(F.to_json(F.struct("artist_norm", "parts", "canon", "pure_remix", "duration"))))
    once = named.select("said", "artist_norm", "parts", "canon", "pure_remix", "duration").dropDuplicates(["said"])
    keys = K.identity_keys(F.col("artist_norm"), F.col("canon"), F.col("pure_remix"), F.col("duration"), 3)
    asked = exploded(once, keys, "said", "artist_norm", "parts", "canon", "duration")
    found = asked.join(best, KEY)
    both = found.select("*", F.posexplode(F.array("best_real", "best_all")).alias("tier", "track_id")).where("track_id is not null")
    fits = both.join(tracks.select("track_id", "t_path", "t_bitrate", "t_canon", "t_artist_norm", "t_parts", "t_duration"), "track_id").where(similar_tags())
    order = Window.partitionBy("said").orderBy("tier", "k_no")
    chosen = fits.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("said", "track_id", "t_path", "t_bitrate")
    return named.select("eid", "said").join(chosen, "said").select("eid", "track_id", "t_path", "t_bitrate")


def alike(pairs: DataFrame) -> DataFrame:
    """The best of an entry's candidates with similar tags: real tags, no remix, bitrate."""
    return best_bitrate(pairs.where(similar_tags()), "eid", ~F.col("t_auto"), ~F.col("t_remix"))


def alias_fits(tolerance: float) -> Column:
    """Whether a track has an entry's title and its artist, by tag or by file name, within the duration if known."""
    by_tag = (T.text("t_artist") != "") & T.artists_compatible(F.col("artist_norm"), F.col("t_artist_norm"), F.col("parts"), F.col("t_parts"))
    gap = F.abs(F.col("duration") - F.col("t_duration"))
    known = (F.col("canon") != "") & (F.col("artist_norm") != "")
    return known & (F.col("canon") == F.col("t_canon")) & (by_tag | F.contains(F.col("t_name_norm"), F.col("artist_norm"))) & (gap.isNull() | (gap <= tolerance))


def alias_best(pairs: DataFrame, tolerance: float = 3.0) -> DataFrame:
    return best_bitrate(pairs.where(alias_fits(tolerance)), "eid", ~F.col("t_auto"), ~F.col("t_remix"))


def derived_equal(pairs: DataFrame) -> DataFrame:
    """The best of an entry's candidates whose tags are what its file name says: eid, track_id."""
    good = (F.col("t_title_norm") == F.col("said_title")) & ((F.col("said_artist") == "") | (F.col("t_artist_norm") == F.col("said_artist")))
    kept = prefer(pairs.where(good), "eid", ~F.col("t_auto"))
    return best_bitrate(kept, "eid", F.col("name_remix") | ~F.col("t_remix"))


def derived_match(entries: DataFrame, tracks: DataFrame, postings: DataFrame) -> DataFrame:
    """The derived_equal choice of every entry among its name candidates: eid, track_id, t_path, t_bitrate.

    Entries whose names say the same are looked up once: by title and artist where the artist is said, by title alone else; ids
    alone are held to the blocks, and the tracks' columns come last.
    """
    say = ["said_title", "said_artist", "name_remix", "sid"]
    named = entries.withColumn("sid", set_id("name_tokens")).select("eid", "name_tokens", *say)
    once = named.select(*say).distinct()
    there = tracks.select("track_id", F.col("t_title_norm").alias("said_title"), F.col("t_artist_norm").alias("said_artist"))
    by_both = once.where("said_artist <> ''").join(there, ["said_title", "said_artist"]).select("track_id", *say)
    by_title = once.where("said_artist = ''").join(there.drop("said_artist"), "said_title").select("track_id", *say)
    equal = by_both.unionByName(by_title)
    sets = named.select("sid", "name_tokens").dropDuplicates(["sid"]).where(F.size("name_tokens") > 0)
    wanted = equal.select("sid", "track_id").distinct().join(sets.select("sid", F.explode(F.array_distinct("name_tokens")).alias("token")), "sid")
    known = postings.where(F.col("token_type").isin("name", "title")).select("token", "track_id").distinct()
    held = equal.join(wanted.join(known, ["token", "track_id"]).select("sid", "track_id").distinct(), ["sid", "track_id"])
    key = F.md5(F.to_json(F.struct(*say)))
    pairs = held.join(tracks.select("track_id", "t_path", "t_bitrate", "t_auto", "t_remix", "t_title_norm", "t_artist_norm"), "track_id").withColumn("eid", key)
    best = derived_equal(pairs).select(F.col("eid").alias("key"), "track_id", "t_path", "t_bitrate")
    return named.select("eid", key.alias("key")).join(best, "key").drop("key")


def similar_join(entries: DataFrame, tracks: DataFrame, tolerance: int = 3) -> DataFrame:
    """Entries and all tracks with similar tags, as an equality join on title and duration cell with a residual.

    A cell is as wide as the tolerance and an entry asks its own and both neighbours, so no pair is missed or doubled.
    """
    cell = F.floor(F.col("duration") / tolerance)
    asked = entries.where("canon <> '' and duration is not null").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    there = tracks.where("t_canon <> '' and t_duration is not null").withColumn("cell", F.floor(F.col("t_duration") / tolerance))
    return asked.join(there.withColumn("canon", F.col("t_canon")), ["canon", "cell"]).where(similar_tags(tolerance)).drop("cell")


SAID, TAGS = ["canon", "artist_norm", "parts", "duration"], ["t_canon", "t_artist_norm", "t_parts", "t_duration"]


def similar_sayings(entries: DataFrame, kinds: DataFrame, *found: Column) -> DataFrame:
    """eid and what is found, by aggregates, among the kinds(TAGS, ...) with similar tags; what entries say meets kinds once."""
    asked = entries.where("canon <> '' and duration is not null").withColumn("said", F.md5(F.to_json(F.struct(*SAID))))
    once = asked.select("said", *SAID).dropDuplicates(["said"])
    met = similar_join(once, kinds).groupBy("said").agg(*found)
    return asked.select("eid", "said").join(met, "said").drop("said")


def similar_counts(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """eid, pairs, best_bitrate: how many tracks have similar tags, and their highest bitrate."""
    kinds = tracks.groupBy(*TAGS).agg(F.count("*").alias("n"), F.max("t_bitrate").alias("t_bitrate"))
    return similar_sayings(entries, kinds, F.sum("n").alias("pairs"), F.max("t_bitrate").alias("best_bitrate"))


def similar_best(entries: DataFrame, tracks: DataFrame) -> DataFrame:
    """eid, track_id, t_bitrate of the best track with similar tags: real tags, no remix, bitrate, the first."""
    best = F.max(F.struct((~F.col("t_auto")).alias("real"), (~F.col("t_remix")).alias("plain"), F.col("t_bitrate").alias("t_bitrate"), (-F.col("track_id")).alias("first")))
    kinds = tracks.groupBy(*TAGS).agg(best.alias("best"))
    return similar_sayings(entries, kinds, F.max("best").alias("x")).select("eid", (-F.col("x.first")).alias("track_id"), "x.t_bitrate")
