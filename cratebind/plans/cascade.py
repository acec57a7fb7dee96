"""The match cascade: each phase sees only the entries that the ones before left open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocking, caches, identity, normalise, scoring
from ..operators.storage import stored

CHOICE = "struct<track_id:bigint,path:string,bitrate:int,remix:boolean,artist:string>"


def choice() -> Column:
    return F.struct("track_id", F.col("t_path").alias("path"), F.col("t_bitrate").alias("bitrate"), F.col("t_remix").alias("remix"), F.col("t_artist_norm").alias("artist"))


def upgraded(found: DataFrame, better: DataFrame) -> DataFrame:
    """found(eid, path, bitrate) with the better(eid, path, bitrate) where its bitrate is strictly higher."""
    b = better.select("eid", F.col("path").alias("__path"), F.col("bitrate").alias("__bitrate"))
    up = F.coalesce(F.col("__bitrate") > F.col("bitrate"), F.lit(False))
    both = found.join(b, "eid", "left")
    return both.select(*[c for c in found.columns if c not in ("path", "bitrate")], F.when(up, F.col("__path")).otherwise(F.col("path")).alias("path"), F.when(up, F.col("__bitrate")).otherwise(F.col("bitrate")).alias("bitrate"))


def same_title(once: DataFrame, tracks: DataFrame) -> DataFrame:
    """Sayings and the tracks of the same title, with what the refinements look at; titles meet by equality."""
    mine = once.where("canon <> ''").select("said", "sid", "canon", "artist_norm", "parts", "duration")
    theirs = tracks.select("track_id", F.col("t_canon").alias("canon"), "t_canon", "t_artist", "t_artist_norm", "t_parts", "t_name_norm", "t_duration", "t_auto", "t_remix", "t_bitrate", "t_path")
    return mine.join(theirs, "canon").where(identity.similar_tags() | identity.alias_fits(15.0))


def in_blocks(pairs: DataFrame, once: DataFrame, postings: DataFrame) -> DataFrame:
    """Those of pairs(sid, track_id, ...) that are of the sid's block, without making the blocks.

    A track that title and artist tokens lead to is in the block; one that either leads to is, if no track has both, which is looked
    up for such sets alone.
    """
    index = stored(blocking.track_kinds(postings), "index")
    sets = once.select("sid", "title_tokens", "artist_tokens").dropDuplicates(["sid"])
    held = pairs.join(sets, "sid").join(index.select("track_id", "kind", "title", "artist"), "track_id").withColumns({"both": F.arrays_overlap("title_tokens", "title") & F.arrays_overlap("artist_tokens", "artist"), "one": F.arrays_overlap("title_tokens", "title") | F.arrays_overlap("artist_tokens", "artist")})
    held = stored(held.where("one").drop("title_tokens", "artist_tokens", "title", "artist", "one"), "same-title")
    unsure = sets.join(held.where("not both").select("sid").distinct(), "sid", "left_semi")
    placed = blocking.tag_kinds(unsure, index)
    return held.where("both").unionByName(held.where("not both").join(placed, ["sid", "kind"], "left_semi")).drop("both", "kind")


def finest(pairs: DataFrame, name: str) -> DataFrame:
    """said and the best of its pairs as `name`: real tags, no remix, bitrate, the first."""
    order = F.struct(~F.col("t_auto"), ~F.col("t_remix"), "t_bitrate", -F.col("track_id"))
    return pairs.groupBy("said").agg(F.max_by(choice(), order).alias(name))


def alias_best(entries: DataFrame, tracks: DataFrame, postings: DataFrame, tolerance: float) -> DataFrame:
    """eid, track_id, t_bitrate: the best of an entry's blocked candidates that have its title and an alias of its artist."""
    said = F.md5(F.to_json(F.struct("sid", "canon", "artist_norm", "duration")))
    asked = entries.where("has_tags").withColumn("sid", blocking.set_id(*blocking.SETS)).withColumn("said", said)
    once = stored(asked.select("said", "sid", *blocking.SETS, "canon", "artist_norm", "parts", "duration").dropDuplicates(["said"]), "sayings")
    best = finest(in_blocks(same_title(once, tracks).where(identity.alias_fits(tolerance)), once, postings), "x")
    return asked.select("eid", "said").join(best, "said").select("eid", "x.track_id", F.col("x.bitrate").alias("t_bitrate"))


def similar_best(entries: DataFrame, tracks: DataFrame, postings: DataFrame, best: DataFrame) -> DataFrame:
    """eid, path, bitrate: the track of the entry's identity, else the best of its blocked candidates with similar tags."""
    own = identity.identity_match(entries, tracks, best).select("eid", F.col("t_path").alias("path"), F.col("t_bitrate").alias("bitrate"), F.lit(1).alias("__p"))
    said = F.md5(F.to_json(F.struct("sid", "canon", "artist_norm", "duration")))
    asked = entries.where("has_tags").withColumn("sid", blocking.set_id(*blocking.SETS)).withColumn("said", said)
    once = stored(asked.select("said", "sid", *blocking.SETS, "canon", "artist_norm", "parts", "duration").dropDuplicates(["said"]), "sayings")
    alike = finest(in_blocks(same_title(once, tracks).where(identity.similar_tags()), once, postings), "near")
    near = asked.select("eid", "said").join(alike, "said").select("eid", "near.path", "near.bitrate", F.lit(0).alias("__p"))
    return own.unionByName(near).groupBy("eid").agg(F.max_by(F.struct("path", "bitrate"), "__p").alias("x")).select("eid", "x.path", "x.bitrate")


def tag_phase(entries: DataFrame, tracks: DataFrame, postings: DataFrame, whole: DataFrame) -> DataFrame:
    """eid, path, bitrate, candidates of the entries that their tags resolve; tracks are one of each kind, whole all of them.

    The choice by score may give way to a similar track of higher bitrate, a remix to another version, and a
    track below 320 kbps or of another artist to an alias of the artist. All of it is worked out for sayings, not for entries.
    """
    asked = entries.where((F.size("title_tokens") > 0) | (F.size("artist_tokens") > 0))
    sayings = scoring.Sayings(asked, tracks, postings)
    scored = stored(sayings.best(), "best-by-tags")
    shown = whole.select("track_id", "t_path", "t_bitrate", "t_remix", "t_artist_norm", "t_parts", "t_name_norm", "t_auto")
    first = scored.where("fits").select("said", "track_id").join(shown, "track_id").select("said", choice().alias("now"))
    # an entry of a service whose tags lead to nothing may have one of the most similar titles
    open_ = sayings.entries.where("service").join(scored, "said", "left_anti")
    soft = open_.select("eid", "said", "artist_norm", "artist_tokens", "parts", "remix").join(scoring.soft_top(open_, whole).select("eid", "track_id"), "eid").dropDuplicates(["said", "track_id"]).join(shown, "track_id")
    fit = scoring.prefer(soft, "said", ~F.col("t_auto")).where(scoring.expected_artist())
    first = first.unionByName(scoring.best_bitrate(fit, "said", F.col("remix") | ~F.col("t_remix")).select("said", choice().alias("now")))
    pairs = same_title(sayings.once, tracks).join(sayings.kinds, "track_id").join(sayings.reached, ["sid", "kind"], "left_semi")
    pairs = stored(pairs.drop("kind"), "same-title")
    for name, fits in (("near", identity.similar_tags()), ("wide", identity.alias_fits(15.0)), ("tight", identity.alias_fits(3.0))):
        first = first.join(finest(pairs.where(fits), name), "said", "left")
    now, near, wide, tight = (F.col(c) for c in ("now", "near", "wide", "tight"))
    step = first.join(sayings.once.select("said", "sid", "artist_norm", "remix"), "said").withColumn("now", F.when(near["bitrate"] > now["bitrate"], near).otherwise(now))
    step = step.withColumn("now", F.when(~F.col("remix") & now["remix"] & ~wide["remix"] & (wide["bitrate"] >= now["bitrate"]), wide).otherwise(now))
    other = (F.col("artist_norm") != "") & (now["artist"] != F.col("artist_norm"))
    step = step.withColumn("now", F.when(((now["bitrate"] < 320) | other) & ((tight["bitrate"] > now["bitrate"]) | (tight.isNotNull() & other)), tight).otherwise(now))
    sizes = sayings.kinds.join(tracks.select("track_id", "alike"), "track_id").groupBy("kind").agg(F.sum("alike").alias("alike"))
    counted = sayings.reached.join(sizes, "kind").groupBy("sid").agg(F.sum("alike").alias("candidates"))
    done = step.join(counted, "sid", "left").select("said", "now.path", "now.bitrate", F.coalesce("candidates", F.lit(0)).alias("candidates"))
    return sayings.of(done)


def name_phase(entries: DataFrame, tracks: DataFrame, postings: DataFrame, threshold: float) -> DataFrame:
    """eid, path, bitrate, candidates of the entries that their file names resolve; equal tags of higher bitrate win.

    Names are compared as distinct texts; candidates are counted for distinct sets of tokens.
    """
    best = stored(scoring.match_by_name(entries, tracks, postings, threshold), "best-by-name")
    first = best.join(tracks.select("track_id", "t_path", "t_bitrate"), "track_id").select("eid", F.col("t_path").alias("path"), F.col("t_bitrate").alias("bitrate"))
    found = stored(entries.join(best.select("eid"), "eid", "left_semi").withColumn("sid", blocking.set_id("name_tokens")), "found-by-name")
    equal = identity.derived_match(found.drop("sid"), tracks, postings).select("eid", F.col("t_path").alias("path"), F.col("t_bitrate").alias("bitrate"))
    sets = found.select("sid", "name_tokens").dropDuplicates(["sid"]).where(F.size("name_tokens") > 0)
    # tracks of the same tokens are counted together
    held = postings.where(F.col("token_type").isin("name", "title")).groupBy("track_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    alike = stored(held.join(tracks.select("track_id", "alike"), "track_id").groupBy("tokens").agg(F.min("track_id").alias("track_id"), F.sum("alike").alias("alike")), "alike-names")
    few = alike.select("track_id", F.lit("name").alias("token_type"), F.explode("tokens").alias("token"))
    counted = blocking.hits(sets, "name_tokens", ["name"], few).join(alike.select("track_id", "alike"), "track_id").groupBy("sid").agg(F.sum("alike").alias("candidates"))
    return upgraded(first, equal).join(found.select("eid", "sid"), "eid").join(counted, "sid").drop("sid")


def on_disk(lib: DataFrame, listing: DataFrame | None) -> DataFrame:
    """__path, bitrate: the files that exist, by normalised path, with the library's bitrate or 0.

    What exists is listing(path), a listing of files as a side of the join; without one, what is in the library.
    """
    known = lib.select(T.norm_path(F.col("t_path")).alias("__path"), F.col("t_bitrate")).groupBy("__path").agg(F.max("t_bitrate").alias("bitrate"))
    if listing is None:
        return known
    return listing.select(T.norm_path(F.col("path")).alias("__path")).distinct().join(known, "__path", "left").fillna(0, ["bitrate"])


def match(
    entries: DataFrame, tracks: DataFrame, postings: DataFrame, manual: DataFrame | None = None, learned: DataFrame | None = None,
    aliases: DataFrame | None = None, overrides: DataFrame | None = None, threshold: float = 70.0, only_low_bitrate: bool = False, least_bitrate: int = 320,
    listing: DataFrame | None = None,
) -> DataFrame:
    """playlist, pos, raw_path, phase, found, path, bitrate, candidates of every entry.

    entries(playlist, pos, raw_path, title, artist, duration); an entry whose file exists stands, unless only_low_bitrate asks to
    better those below least_bitrate; overrides(playlist, path, bitrate) tell a playlist's own bitrates. listing(path) says what
    exists; without it, that is the library.
    """
    lib = stored(normalise.normalise_tracks(tracks, aliases), "tracks")
    # what chooses by bitrate and track_id takes one track of each kind; paths, remembered ones and the most similar titles are of all
    kinds = stored(lib.join(normalise.foremost(tracks).select("track_id", "alike"), "track_id"), "kinds")
    postings = stored(postings.join(kinds.select("track_id"), "track_id", "left_semi").select(*postings.columns), "postings")
    forms = stored(normalise.normalise_entries(entries, aliases), "entries")
    best = stored(identity.identity_best(kinds), "identities")
    there = on_disk(lib, listing)
    # a path is worked out once, and before rows are sorted by it: many entries have the same, and a sort asks for its key at each comparison
    known = forms.where("not service").select("raw_path").distinct().withColumn("__path", T.norm_path(F.col("raw_path"))).join(there, "__path").select("raw_path", "bitrate")
    done = stored(forms.where("not service").select("eid", "raw_path").join(known, "raw_path").select("eid", F.col("raw_path").alias("path"), "bitrate"), "valid-paths")
    at = stored(entries.select("playlist", "pos", "raw_path", normalise.entry_id().alias("eid")), "positions")
    pinned = None
    if overrides is not None:
        own = overrides.select("playlist", T.norm_path(F.col("path")).alias("__o"), F.col("bitrate").alias("__b")).groupBy("playlist", "__o").agg(F.max("__b").alias("__b"))
        told = at.withColumn("__o", T.norm_path(F.col("raw_path"))).join(own, ["playlist", "__o"]).drop("__o")
        told = told.where("__b <> 0").join(done.select("eid", "path"), "eid").withColumn("stands", (F.col("__b") >= least_bitrate) | F.lit(not only_low_bitrate))
        pinned = stored(told.select("playlist", "pos", "raw_path", "eid", "path", F.col("__b").alias("bitrate"), "stands"), "pinned")  # these places alone have other bitrates
    if only_low_bitrate:
        done = done.where(F.col("bitrate") >= least_bitrate)
    out = [done.select("eid", F.lit("valid_path").alias("phase"), "path", "bitrate", F.lit(0).cast("long").alias("candidates"))]
    stands = done.select("eid") if pinned is None else done.select("eid").join(pinned.where("not stands"), "eid", "left_anti")
    left = stored(forms.join(stands, "eid", "left_anti"), "open")

    def settle(found: DataFrame, phase: Column) -> None:
        nonlocal left
        kept = stored(found.select("eid", phase.alias("phase"), "path", "bitrate", (F.col("candidates") if "candidates" in found.columns else F.lit(0)).cast("long").alias("candidates")), "phase")
        out.append(kept)
        left = stored(left.join(kept, "eid", "left_anti"), "open")

    for memory, how in ((manual, "manual"), (learned, "learned")):
        if memory is not None:
            hit = caches.manual_lookup(left, memory, lib, listing=listing) if how == "manual" else caches.learned_lookup(left, memory, lib)
            hit = stored(hit.select("eid", F.col("t_path").alias("path"), F.col("t_bitrate").alias("bitrate"), (F.col("by") if how == "learned" else F.lit("manual")).alias("by")), "memory")
            said = left.select("eid", "has_tags", *blocking.SETS, "canon", "artist_norm", "parts", "pure_remix", "duration")
            better = similar_best(stored(said.join(hit, "eid", "left_semi"), "remembered"), kinds, postings, best)
            settle(upgraded(hit, better), F.concat(F.lit("memory_"), "by"))
    own = identity.identity_match(left, kinds, best)
    settle(own.select("eid", F.col("t_path").alias("path"), F.col("t_bitrate").alias("bitrate")), F.lit("identity"))
    settle(tag_phase(left.where("has_tags"), kinds, postings, lib), F.lit("tags"))
    by_name = left.where("not (service and has_tags)")
    settle(name_phase(by_name, kinds, postings, threshold), F.lit("name"))
    misses = left.select("eid", F.when(F.col("service") & F.col("has_tags"), "service_unmatched").otherwise("unmatched").alias("phase"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("bitrate"), F.lit(0).cast("long").alias("candidates"))
    matched = misses
    for df in out[1:]:
        matched = matched.unionByName(df)

    def placed(where: DataFrame, what: DataFrame) -> DataFrame:
        return where.select("playlist", "pos", "raw_path", "eid").join(what, "eid").select("playlist", "pos", "raw_path", "phase", F.col("path").isNotNull().alias("found"), "path", "bitrate", "candidates")

    if pinned is None:
        return placed(at, out[0].unionByName(matched))
    free = at.join(pinned, ["playlist", "pos"], "left_anti")
    own = pinned.where("stands").select("playlist", "pos", "raw_path", F.lit("valid_path").alias("phase"), F.lit(True).alias("found"), "path", "bitrate", F.lit(0).cast("long").alias("candidates"))
    results = placed(free, out[0]).unionByName(placed(free.join(out[0], "eid", "left_anti"), matched))
    return results.unionByName(placed(pinned.where("not stands"), matched)).unionByName(own)
