"""Mining of artist aliases: variants of one signature, their canonical form and how sure the pair is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import similarity as S
from ..functions import text as T


def variants(tracks: DataFrame) -> DataFrame:
    """Artist mentions: variant, raw form, title, rounded duration, signature and position."""
    rows = tracks.select("track_id", F.col("artist").alias("raw"), T.norm_alias(F.col("artist")).alias("variant"), T.norm_alias(F.col("title")).alias("title"), F.bround(F.coalesce("duration", F.lit(0.0)), 0).cast("long").alias("seconds"))
    return rows.where("variant <> ''").withColumn("signature", T.signature(F.col("variant")))


def display_forms(rows: DataFrame) -> DataFrame:
    """variant and its most frequent raw form, the first seen on ties."""
    forms = rows.groupBy("variant", "raw").agg(F.count("*").alias("n"), F.min("track_id").alias("at"))
    return forms.groupBy("variant").agg(F.max_by("raw", F.struct("n", -F.col("at"))).alias("display"))


def canonical(rows: DataFrame) -> DataFrame:
    """signature, variant, occurrences and the group's canonical variant, for signatures of several variants.

    The canonical one is the most frequent; on ties the one whose display form has more letters beyond ASCII, more words,
    and was seen first.
    """
    counts = rows.where("signature <> ''").groupBy("signature", "variant").agg(F.count("*").alias("occurrences"), F.min("track_id").alias("at"))
    shown = counts.join(display_forms(rows), "variant")
    foreign = F.length(F.regexp_replace("display", r"[\x00-\x7F]", ""))
    words = F.size(F.filter(F.split(F.trim("display"), r"\s+"), lambda w: w != ""))
    order = F.struct("occurrences", foreign, words, -F.col("at"))
    best = shown.groupBy("signature").agg(F.max_by("variant", order).alias("canonical"), F.max_by("display", order).alias("canonical_display"), F.count("*").alias("n")).where("n > 1")
    return shown.join(best, "signature").select("signature", "variant", "display", "occurrences", "canonical", "canonical_display")


def co_occurring(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The (variant, canonical) pairs that share a title of one duration."""
    at = rows.where("title <> ''").select("variant", "title", "seconds").distinct()
    mine = pairs.select("variant", "canonical").join(at, "variant")
    theirs = at.select(F.col("variant").alias("canonical"), "title", "seconds")
    return mine.join(theirs, ["canonical", "title", "seconds"], "left_semi").select("variant", "canonical").distinct()


def examples(rows: DataFrame, k: int = 3) -> DataFrame:
    """variant and its k most frequent titles, the first seen on ties."""
    titles = rows.where("title <> ''").groupBy("variant", "title").agg(F.count("*").alias("n"), F.min("track_id").alias("at"))
    order = Window.partitionBy("variant").orderBy(F.desc("n"), "at")
    top = titles.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k)
    return top.groupBy("variant").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "title"))), lambda x: x["title"]).alias("examples"))


def suggestions(tracks: DataFrame) -> DataFrame:
    """Alias suggestions, best first by confidence and occurrences."""
    rows = variants(tracks)
    pairs = canonical(rows).where("variant <> canonical")
    seen = co_occurring(pairs, rows).withColumn("together", F.lit(True))
    a, b = F.col("variant"), F.col("canonical")
    both = pairs.join(seen, ["variant", "canonical"], "left").join(examples(rows), "variant", "left")
    scored = both.withColumns({"ratio": S.ratio(a, b), "overlap": S.jaccard(a, b), "small": S.is_diminutive(a, b), "together": F.coalesce("together", F.lit(False))})
    total = F.least(F.lit(0.6), F.col("ratio") * 0.6) + F.least(F.lit(0.3), F.col("overlap") * 0.3) + F.when(F.col("small"), 0.07).otherwise(0.0) + F.when(F.col("together"), 0.08).otherwise(0.0)
    reasons = F.filter(F.array(
        F.when(F.col("ratio") >= 0.92, "similar letters"), F.when(F.col("overlap") >= 0.8, "similar words"),
        F.when(F.col("small"), "diminutive"), F.when(F.col("together"), "shared titles"),
    ), lambda r: r.isNotNull())
    out = scored.select(
        F.col("display").alias("variant"), a.alias("variant_norm"), F.col("canonical_display").alias("canonical"), b.alias("canonical_norm"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"), reasons.alias("reasons"), "occurrences", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )
    return out.withColumn("confidence", F.round("score", 3)).orderBy(F.desc("confidence"), F.desc("occurrences"), "variant_norm")


def pending(found: DataFrame, applied: DataFrame, least: float = 0.9, query: str = "") -> DataFrame:
    """Suggestions to review: sure enough, not applied(variant, canonical) yet, holding the query."""
    known = applied.select(T.norm_alias_unicode(F.col("variant")).alias("__v"), T.norm_alias_unicode(F.col("canonical")).alias("__c")).distinct()
    pair = (T.norm_alias_unicode(F.col("variant")) == F.col("__v")) & (T.norm_alias_unicode(F.col("canonical")) == F.col("__c"))
    rows = found.where(F.col("confidence") >= least).join(known, pair, "left_anti")
    named = F.contains(F.lower(F.concat_ws(" ", "variant", "canonical")), F.lit(query.lower()))
    return rows.where(named).withColumn("preselected", F.col("confidence") >= 0.97)


def apply_aliases(config: DataFrame, accepted: DataFrame) -> DataFrame:
    """The alias table with the accepted(variant, canonical) pairs: no blanks, no equal forms, no pair that is there."""
    v, c = T.norm_alias(F.col("variant")), T.norm_alias(F.col("canonical"))
    new = accepted.select(F.trim("variant").alias("variant"), F.trim("canonical").alias("canonical"), v.alias("__v"), c.alias("__c")).where("variant <> '' and canonical <> '' and __v <> __c")
    known = config.select(v.alias("__v"), c.alias("__c")).distinct()
    fresh = new.join(known, ["__v", "__c"], "left_anti").groupBy("__v", "__c").agg(F.min(F.struct("variant", "canonical")).alias("x"))
    both = config.select("variant", "canonical", F.lit(0).alias("at")).unionByName(fresh.select("x.variant", "x.canonical", F.lit(1).alias("at")))
    return both.groupBy("variant").agg(F.max_by("canonical", F.struct("at", "canonical")).alias("canonical"))


def prune(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """The suggestions without the accepted pairs, compared in normal form."""
    gone = accepted.select(T.norm_alias(F.col("variant")).alias("variant_norm"), T.norm_alias(F.col("canonical")).alias("canonical_norm")).distinct()
    return found.join(gone, ["variant_norm", "canonical_norm"], "left_anti")
