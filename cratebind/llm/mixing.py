"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Rules for odd input: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; a table without words gives targets of 0; repeated rows are separate documents; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, keep


def ranked(names: DataFrame) -> DataFrame:
    """names(source, ...) with `place`, its 0-based place by code point, null last.

    Range partitions are numbered apart and shifted by the rows before them, so no task sees all names.
    """
    parts = keep(
        names.withColumn("last", F.col("source").isNull()).repartitionByRange("last", F.encode(F.col("source"), "UTF-8")).withColumn("part", F.spark_partition_id()),
        "mix-sources",
    )
    per_part = parts.groupBy("part").agg(F.count("*").alias("n"))  # one row for each partition
    before = per_part.withColumn("shift", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("last", F.encode(F.col("source"), "UTF-8")))
    return parts.withColumn("inside", inside).join(before.select("part", "shift"), "part").withColumn("place", F.col("inside") - 1 + F.col("shift")).drop("part", "last", "inside", "shift")


def water_fill(sources: DataFrame, total: float, cap: float) -> DataFrame:
    """sources(source, weight, source_size) with `target`.

    A source never exceeds cap times its size. While some source lies above its cap it is clamped there, and what is
    left is shared again by weight among the others. Each round is one small aggregate; it ends after as many rounds
    as there are different clamping levels, at most.
    """
    ceiling = F.col("source_size") * cap
    level, clamped = 0.0, -1
    while True:
        at_cap = ceiling <= F.col("weight") * level
        row = sources.agg(
            F.count(F.when(at_cap, 1)).alias("clamped"),
            F.sum(F.when(at_cap, ceiling).otherwise(0.0)).alias("held"),
            F.sum(F.when(~at_cap, F.col("weight")).otherwise(0)).alias("weights"),
        ).first()
        if row["clamped"] == clamped or not row["weights"]:
            break
        clamped, level = row["clamped"], max(0.0, total - row["held"]) / row["weights"]
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), ceiling))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_epochs: float = 2.0, seed: str = "mix-1", block: int = 256) -> DataFrame:
    """doc_id, text, source, size, source_size, target, taken: how many words of each document the mix takes.

    Each document is taken floor(target / source_size) times whole. The remaining fraction is filled document by document in
    seeded order within blocks of about `block` documents of a source, the last one in part, so every block, however
    large its source, meets its share to a word and no task holds a whole source.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select("doc_id", "text", "source", size.alias("size"))
    # the text stays out of the statistics and the shuffles below that need sizes only
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    placed = ranked(per_source)
    pattern = F.array(*map(F.lit, weights))
    weighted = keep(placed.withColumn("weight", F.element_at(pattern, (F.col("place") % len(weights) + 1).cast("int"))), "mix-weights")
    facts = weighted.agg(F.sum("source_size").alias("words"), F.count("*").alias("n")).first()
    total = facts["words"] or 0
    filled = water_fill(weighted, budget * total, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rules = filled.select(F.col("source").alias("of"), "source_size", "target", epochs.alias("epochs"), F.ceil(F.col("rows") / block).cast("long").alias("blocks"))
    if facts["n"] <= 100_000:  # a checked size
        joined = sized.join(F.broadcast(rules), F.col("source").eqNullSafe(F.col("of")))
    else:  # beyond it a source's documents are dealt out by as many numbers as its rule is repeated for
        salts = 64
        salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int")
        each = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = sized.withColumn("of_salt", salt).join(each, F.col("source").eqNullSafe(F.col("of")) & (F.col("of_salt") == F.col("salt"))).drop("of_salt", "salt")
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    number = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    cut = joined.withColumn("digest", digest).withColumn("block", number % F.col("blocks"))
    own = Window.partitionBy("of", "block")
    order = own.orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.floor("epochs")
    share = F.round((F.col("epochs") - whole) * F.sum("size").over(own), 0)
    part = F.least(F.col("size"), F.greatest(F.lit(0), share.cast("long") - F.coalesce(F.sum("size").over(order), F.lit(0))))
    return cut.withColumn("taken", (whole * F.col("size") + part).cast("long")).select("doc_id", "text", "source", "size", "source_size", "target", "taken")


def with_copies(mixed: DataFrame) -> DataFrame:
    """mixed(text, size, taken, ...) with `copies`, the texts that the mix takes of a document: whole ones, and last the words of a part.

    A cut text keeps the white space between its words. A document of which nothing is taken has none.
    """
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest), ""))).otherwise(F.array().cast("array<string>"))
    return mixed.withColumn("copies", F.concat(F.array_repeat("text", whole), part))


def repetitions(mixed: DataFrame) -> DataFrame:
    """One row for each copy of mixed(...), with its number, its text and the document's other columns."""
    rest = [F.col(f"`{c}`") for c in mixed.columns if c != "text"]
    return with_copies(mixed).select(*rest, F.posexplode("copies").alias("copy", "text"))


def op5(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(concat_ws('|', 'mix-1', coalesce(doc_id::varchar, ''), coalesce(text, ''))) as digest
  from documents),
s as (
  select source, sum(size)::bigint as source_size, count(*) as n,
         ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from d group by source),
fill(clamped, level, step) as (
  select -1::bigint, 0::double, 0
  union all
  select n.c, case when n.w > 0 then greatest(0, 1.5 * n.total - n.held) / n.w else 0 end, fill.step + 1
  from fill, lateral (
    select count(*) filter (where 2.0 * source_size <= weight * fill.level) as c,
           coalesce(sum(2.0 * source_size) filter (where 2.0 * source_size <= weight * fill.level), 0)::double as held,
           coalesce(sum(weight) filter (where 2.0 * source_size > weight * fill.level), 0)::double as w,
           sum(source_size)::double as total from s) n
  where n.c <> fill.clamped and n.w > 0),
t as (
  select s.*, least(weight * (select level from fill order by step desc limit 1), 2.0 * source_size)::double as target from s),
e as (
  select *, case when source_size > 0 then target / source_size else 0 end as epochs, ceil(n / 256.0)::bigint as blocks from t),
x as (
  select d.doc_id, d.size, d.digest, e.*, ('0x' || substr(d.digest, 1, 12))::bigint % e.blocks as block
  from d join e on d.source is not distinct from e.source),
r as (
  select *, round((epochs - floor(epochs)) * sum(size) over (partition by source, block))::bigint as share,
         coalesce(sum(size) over (partition by source, block order by digest, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from x)
select doc_id, size, source_size, target,
       (floor(epochs) * size)::bigint + least(size, greatest(0, share - before))::bigint as taken
from r
"""
