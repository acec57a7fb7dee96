"""Blocking joins on the inverted index.

Entries are blocked by their distinct token sets; the intersection of groups is joined first, and the union is built
only for the sets that have no intersection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SETS = ["title_tokens", "artist_tokens"]


def set_id(*tokens: str) -> Column:
    return F.md5(F.concat_ws("|", *(F.array_join(F.array_sort(F.array_distinct(c)), " ") for c in tokens)))


def token_join(wanted: DataFrame, postings: DataFrame, keys: list[str], share: int = 64, salts: int = 64, least: int = 1000) -> DataFrame:
    """wanted joined to the postings of its tokens; the postings of a heavy token are dealt out over several tasks.

    Heavy are tokens that hold more than 1 / share of the postings, so fewer than `share` of them, and at least `least` postings. Each
    of their postings goes to one salt and what asks for them to all.
    """
    often = postings.groupBy(*keys).agg(F.count("*").alias("n"))
    total = postings.count()
    heavy = stored(often.where(F.col("n") >= max(least, total // share + 1)).select(*keys, F.lit(True).alias("heavy")), "heavy-tokens")
    if not heavy.take(1):
        return wanted.join(postings, keys)
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("track_id"), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    few = F.broadcast(heavy)  # fewer than `share` rows
    asked = wanted.join(few, keys, "left").withColumn("salt", F.explode(every)).drop("heavy")
    return asked.join(postings.join(few, keys, "left").withColumn("salt", salt).drop("heavy"), [*keys, "salt"]).drop("salt")


def hits(sets: DataFrame, column: str, kinds: list[str], postings: DataFrame) -> DataFrame:
    """Distinct (sid, track_id) whose postings of the given types hold a token of the column."""
    wanted = sets.select("sid", F.explode(F.array_distinct(column)).alias("token"))
    found = token_join(wanted, postings.where(F.col("token_type").isin(kinds)).select("token", "track_id"), ["token"])
    return found.select("sid", "track_id").distinct()


def track_kinds(postings: DataFrame) -> DataFrame:
    """track_id, kind, title_id, artist_id, title, artist: tracks of the same title and artist tokens are of a kind."""
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("token_type") == k, F.col("token")))).alias(k)
    index = postings.where(F.col("token_type").isin("title", "artist")).groupBy("track_id").agg(of("title"), of("artist"))
    ids = index.withColumns({"title_id": F.md5(F.array_join("title", " ")), "artist_id": F.md5(F.array_join("artist", " "))})
    return ids.withColumn("kind", F.concat("title_id", "artist_id"))


def tag_kinds(entries: DataFrame, index: DataFrame) -> DataFrame:
    """(sid, kind): the kinds of tracks hit by title and artist tokens; by either, where there are none or a set is empty.

    Distinct sets of title tokens meet distinct titles, and artists artists; tracks do not come in.
    """
    own = {c: F.md5(F.array_join(F.array_sort(F.array_distinct(c)), " ")) for c in SETS}
    sets = stored(entries.select(set_id(*SETS).alias("sid"), *SETS).dropDuplicates(["sid"]).withColumns({"title_set": own[SETS[0]], "artist_set": own[SETS[1]]}), "token-sets")
    kinds = stored(index.select("kind", "title_id", "artist_id", "title", "artist").dropDuplicates(["kind"]), "track-kinds")

    def reach(column: str, key: str, words: str, there: str) -> DataFrame:
        wanted = sets.select(key, column).dropDuplicates([key]).select(key, F.explode(F.array_distinct(column)).alias("token"))
        held = kinds.select(there, words).dropDuplicates([there]).select(F.explode(words).alias("token"), F.col(there).alias("track_id"))
        return stored(token_join(wanted, held, ["token"]).select(key, F.col("track_id").alias(there)).distinct(), f"{words}-hits")

    titles, artists = reach("title_tokens", "title_set", "title", "title_id"), reach("artist_tokens", "artist_set", "artist", "artist_id")
    asked, slim = sets.select("sid", "title_set", "artist_set"), kinds.select("kind", "title_id", "artist_id")
    both = stored(asked.join(titles, "title_set").join(slim, "title_id").join(artists, ["artist_set", "artist_id"], "left_semi").select("sid", "kind"), "both-hits")
    alone = asked.join(both.select("sid").distinct(), "sid", "left_anti")
    either = alone.join(titles, "title_set").join(slim, "title_id").select("sid", "kind").unionByName(alone.join(artists, "artist_set").join(slim, "artist_id").select("sid", "kind"))
    return both.unionByName(either.distinct())


def tag_blocks(entries: DataFrame, postings: DataFrame) -> DataFrame:
    """(sid, track_id): the tracks of the kinds that an entry's tokens hit."""
    index = stored(track_kinds(postings), "index")
    return tag_kinds(entries, index).join(index.select("track_id", "kind"), "kind").select("sid", "track_id")


def tag_candidates(entries: DataFrame, tracks: DataFrame, postings: DataFrame) -> DataFrame:
    """Entries with tags and each of their candidate tracks."""
    asked = entries.where("has_tags").withColumn("sid", set_id(*SETS))
    blocks = tag_blocks(asked, postings)
    return asked.join(blocks, "sid").join(tracks, "track_id").drop("sid")


def name_candidates(entries: DataFrame, tracks: DataFrame, postings: DataFrame) -> DataFrame:
    """Entries and the tracks whose name or title shares a token with their file name.

    An entry whose name has no token would have to meet every track; such pairs share no token, score 0 and can never be
    chosen, so they are not made.
    """
    asked = entries.withColumn("sid", set_id("name_tokens"))
    sets = asked.select("sid", "name_tokens").dropDuplicates(["sid"]).where(F.size("name_tokens") > 0)
    return asked.join(hits(sets, "name_tokens", ["name", "title"], postings), "sid").join(tracks, "track_id").drop("sid")
