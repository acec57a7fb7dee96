"""Entries and library tracks with all their matching forms, worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from .storage import stored

ENTRY = ["raw_path", "title", "artist", "duration"]


def with_alias(df: DataFrame, column: str, aliases: DataFrame | None) -> DataFrame:
    """Replace artists in matching form by what aliases(variant, canonical) calls them; the sizes decide how it is joined."""
    if aliases is None:
        return df
    known = aliases.select(F.trim(F.lower(T.ascii_fold(F.col("variant")))).alias("__v"), F.trim(F.lower(T.ascii_fold(F.col("canonical")))).alias("__c"))
    known = known.where("__v <> '' and __c <> ''").groupBy("__v").agg(F.max("__c").alias("__c"))
    return df.join(known, F.col(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__c", column)).drop("__v", "__c")


def entry_id() -> Column:
    return K.exact_key(F.col("raw_path"), F.col("artist"), F.col("title"), F.col("duration"))


def distinct_entries(entries: DataFrame, *found: Column) -> DataFrame:
    """eid, ENTRY and name of every distinct entry, and what is found of its rows by aggregates.

    Rows are grouped by what they say, so that texts are keys and Spark hashes them; ids are worked out for what is left. Grouping takes
    -0.0 for 0.0, which the id tells apart.
    """
    zero = F.when(F.col("duration") == 0, F.col("duration").cast("string")).alias("__zero")
    once = entries.groupBy(*ENTRY, zero).agg(*found) if found else entries.select(*ENTRY, zero).distinct()
    kind = entries.schema["duration"].dataType
    told = once.withColumn("duration", F.coalesce(F.col("__zero").cast(kind), F.col("duration"))).drop("__zero")
    return told.select(entry_id().alias("eid"), "*", T.basename(T.text("raw_path")).alias("name"))


def normalise_entries(entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row for each distinct entry, named by eid; like entries of a playlist are matched once.

    Forms are worked out for distinct tags and for distinct file names, of which there are far fewer than entries.
    """
    key = lambda *c: F.sha1(F.to_json(F.struct(*c)))
    once = stored(distinct_entries(entries).withColumns({"__tags": key("title", "artist"), "__name": key("name")}), "distinct-entries")
    tags = tag_forms(once.groupBy("__tags", "title", "artist").agg(F.lit(1)).select("__tags", "title", "artist"), aliases).drop("title", "artist")
    names = name_forms(once.groupBy("__name", "name").agg(F.lit(1)).select("__name", "name")).drop("name")
    service = T.is_service_id(T.text("raw_path")).alias("service")
    whole = once.join(stored(tags, "tag-forms"), "__tags").join(stored(names, "name-forms"), "__name")
    return whole.select("eid", *ENTRY, "has_tags", "pure", "artist_norm", "own_artist", "name", *[c for c in TAG_FORMS if c not in ("has_tags", "pure", "artist_norm", "own_artist")], *NAME_FORMS, service)


TAG_FORMS = ["has_tags", "pure", "artist_norm", "own_artist", "pure_norm", "title_norm", "canon", "title_tokens", "artist_tokens", "parts", "remix", "pure_remix"]
NAME_FORMS = ["name_norm", "name_tokens", "name_remix", "said_artist", "said_title"]


def tag_forms(texts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """texts(title, artist, ...) with the forms of tags."""
    title, artist = F.col("title"), F.col("artist")
    has_tags = (T.text("title") != "") | (T.text("artist") != "")
    forms = texts.select("*", has_tags.alias("has_tags"), T.pure_title(title).alias("pure"), T.artist_with_fallback(artist, title).alias("artist_norm"), T.norm(artist).alias("own_artist"))
    forms = with_alias(with_alias(forms, "artist_norm", aliases), "own_artist", aliases)
    forms = forms.withColumns({"pure_norm": T.norm(F.col("pure")), "title_norm": T.norm(title)})
    return forms.withColumns({
        "canon": T.canon_title(F.col("pure")),
        "title_tokens": T.words_of(F.col("pure_norm")),
        "artist_tokens": T.words_of(F.col("artist_norm")),
        "parts": T.artist_parts(F.col("artist_norm")),
        "remix": T.is_remix(title),
        "pure_remix": T.is_remix(F.col("pure")),
    })


def name_forms(names: DataFrame) -> DataFrame:
    """names(name, ...) with the forms of file names."""
    name = F.col("name")
    return names.withColumn("name_norm", T.norm(name)).withColumns({
        "name_tokens": T.words_of(F.col("name_norm")),
        "name_remix": T.is_remix(name),
        "said_artist": T.norm(T.split_name(name)[0]),
        "said_title": T.norm(T.split_name(name)[1]),
    })


def foremost(tracks: DataFrame) -> DataFrame:
    """Of tracks that agree in all that matching sees (tags, file name, duration), the one of highest bitrate, the first on ties, and `alike`, their number.

    A choice by bitrate and track_id takes no other of them, so that candidates need not be made for each copy. Only numbers are
    kept while the tracks are grouped; paths come last.
    """
    kind = ["title", "artist", "__name", "duration", "auto_tags"]
    rows = tracks.select("track_id", "title", "artist", T.basename(T.text("path")).alias("__name"), "duration", F.coalesce("auto_tags", F.lit(False)).alias("auto_tags"), F.coalesce("bitrate", F.lit(0)).cast("int").alias("bitrate"))
    by_rate = rows.groupBy(*kind, "bitrate").agg(F.min("track_id").alias("track_id"), F.count("*").alias("alike"))
    best = by_rate.groupBy(*kind).agg(F.max_by(F.struct("track_id", "bitrate"), F.struct("bitrate", -F.col("track_id"))).alias("x"), F.sum("alike").alias("alike"))
    known = best.select("x.track_id", "title", "artist", "duration", "x.bitrate", "auto_tags", "alike")
    return known.join(tracks.select("track_id", "path"), "track_id").select("track_id", "path", "title", "artist", "duration", "bitrate", "auto_tags", "alike")


def normalise_tracks(tracks: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """tracks(track_id, path, title, artist, duration, bitrate, auto_tags) with t_ columns.

    Forms are worked out for distinct tags and distinct file names, as for entries.
    """
    key = lambda *c: F.sha1(F.to_json(F.struct(*c)))
    rows = tracks.withColumn("t_name", T.basename(T.text("path"))).withColumns({"__tags": key("title", "artist"), "__name": key("t_name")})
    tags = stored(track_forms(rows.select("__tags", "title", "artist").distinct(), aliases).drop("title", "artist"), "track-tag-forms")
    named = rows.select("__name", "t_name").distinct().withColumn("t_name_norm", T.norm(F.col("t_name")))
    names = stored(named.select("__name", "t_name_norm", T.words_of(F.col("t_name_norm")).alias("t_name_tokens")), "track-name-forms")
    base = rows.select(
        "track_id", F.col("path").alias("t_path"), F.col("title").alias("t_title"), F.col("artist").alias("t_artist"), F.col("duration").alias("t_duration"),
        F.coalesce("bitrate", F.lit(0)).cast("int").alias("t_bitrate"), F.coalesce("auto_tags", F.lit(False)).alias("t_auto"), "t_name", "__tags", "__name",
    )
    return base.join(tags, "__tags").join(names, "__name").drop("__tags", "__name")


def track_forms(texts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """texts(title, artist, ...) with the forms of a track's tags."""
    title, artist = F.col("title"), F.col("artist")
    forms = texts.withColumns({"t_title_norm": T.norm(title), "t_artist_norm": T.norm(artist), "t_pure": T.pure_title(title), "t_fallback": T.artist_with_fallback(artist, title)})
    forms = with_alias(with_alias(forms, "t_artist_norm", aliases), "t_fallback", aliases)
    return forms.withColumns({
        "t_canon": T.canon_title(title),
        "t_pure_canon": T.canon_title(F.col("t_pure")),
        "t_title_tokens": T.words_of(F.col("t_title_norm")),
        "t_artist_tokens": T.words_of(F.col("t_artist_norm")),
        "t_parts": T.artist_parts(F.col("t_artist_norm")),
        "t_remix": T.is_remix(title),
        "t_pure_remix": T.is_remix(F.col("t_pure")),
    })


def token_postings(tracks: DataFrame) -> DataFrame:
    """The inverted index: token, token_type (title, artist, name), track_id."""
    kinds = {"title": F.col("title"), "artist": F.col("artist"), "name": T.stem(T.basename(T.text("path")))}
    lists = F.array(*(F.struct(F.lit(k).alias("token_type"), T.index_tokens(c).alias("tokens")) for k, c in kinds.items()))
    typed = tracks.select("track_id", F.explode(lists).alias("x"))
    return typed.select(F.explode("x.tokens").alias("token"), F.col("x.token_type").alias("token_type"), "track_id")
