"""Keys: duration buckets, identities, remembered and manual matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def duration_bucket(d: Column) -> Column:
    """The nearest even second, halves to even, as text; empty if unknown."""
    return F.coalesce((F.bround(d / 2, 0) * 2).cast("int").cast("string"), F.lit(""))


def neighbour_buckets(d: Column, tolerance: int = 3) -> Column:
    """Distinct buckets of d moved by -(tolerance + 2) to tolerance + 2 in steps of 2."""
    span = tolerance + 2
    moved = F.transform(F.array(*map(F.lit, range(-span, span + 1, 2))), lambda o: duration_bucket(d + o))
    return F.when(d.isNull(), F.array(F.lit(""))).otherwise(F.array_distinct(moved))


def identity_keys(artist: Column, canon: Column, remix: Column, d: Column, tolerance: int) -> Column:
    """Ordered keys of a recording: for each bucket the one with its artist, if known, then the one without."""

    def of(bucket: Column) -> Column:
        plain = F.struct(F.lit("").alias("artist"), canon.alias("canon"), bucket.alias("bucket"), remix.alias("remix"), F.lit(False).alias("by_artist"))
        named = F.struct(artist.alias("artist"), canon.alias("canon"), bucket.alias("bucket"), remix.alias("remix"), F.lit(True).alias("by_artist"))
        return F.when(artist != "", F.array(named, plain)).otherwise(F.array(plain))

    none = F.array().cast("array<struct<artist:string,canon:string,bucket:string,remix:boolean,by_artist:boolean>>")
    return F.when(canon == "", none).otherwise(F.flatten(F.transform(neighbour_buckets(d, tolerance), of)))


def learned_keys(path: Column, artist: Column, canon: Column, d: Column, name: Column | None = None) -> Column:
    """Ordered keys under which a match is remembered for like entries; `name` is the file name's matching form, where it is known."""
    name, bucket = T.norm(T.basename(T.text(path))) if name is None else name, duration_bucket(d)
    keys = F.array(
        F.when(name != "", F.concat(F.lit("base|"), name)),
        F.when((canon != "") & (artist != ""), F.concat_ws("|", F.lit("at"), artist, canon, bucket)),
        F.when(canon != "", F.concat_ws("|", F.lit("t"), canon, bucket)),
    )
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def exact_key(path: Column, artist: Column, title: Column, d: Column) -> Column:
    """A digest of all that an entry says; lengths keep the fields apart, whatever they hold."""
    fields = (c.cast("string") for c in (artist, d, path, title))
    return F.sha1(F.concat_ws("|", *(F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("~")) for c in fields)))


def manual_labels(path: Column, artist: Column, title: Column) -> Column:
    """What an entry may be called in the manual choices: path, file name, `Artist - Title`."""
    p, named = T.text(path), F.btrim(F.concat(T.text(artist), F.lit(" - "), T.text(title)), F.lit(" -"))
    labels = F.array(F.when(p != "", p), F.when(T.basename(p) != "", T.basename(p)), F.when(named != "", named))
    return F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))


def manual_keys(label: Column) -> Column:
    """A label's exact, file name and normalised key, in order of trust."""
    slashed = F.trim(F.translate(label, "\\", "/"))
    name = F.when(T.basename(slashed) != "", T.basename(slashed)).otherwise(slashed)
    return F.array(F.concat(F.lit("exact|"), F.trim(label)), F.concat(F.lit("base|"), name), F.concat(F.lit("norm|"), F.trim(F.lower(T.strip_accents(name)))))


def folder_hash(path: Column) -> Column:
    return F.md5(path.cast("binary"))


def same_stat(size_a: Column, mtime_a: Column, size_b: Column, mtime_b: Column) -> Column:
    """Whether two file states agree: both unknown, or the same size and time."""
    unknown = size_a.isNull() & mtime_a.isNull() & size_b.isNull() & mtime_b.isNull()
    return unknown | F.coalesce((size_a == size_b) & (F.abs(mtime_a - mtime_b) < 1e-4), F.lit(False))
