"""Exact deduplication by content-defined chunk recipes.

A text, with A-Z in lower case, is cut where its own characters say so, so that equal passages give equal chunks wherever they
stand. Chunks are deduplicated into a store, each under an identifier that is verified against the stored text; a document then
is its recipe, the ordered list of its chunks' identifiers, and documents are equal when their recipes are. Texts move once, as
distinct chunks, combined before they move; whole documents never do. DataFrame functions only.

Rules for odd input: null counts as empty; empty texts are equal to each other; a null doc_id is smaller than any other; of rows
that repeat doc_id and text one stays; two different chunks of one hash get different identifiers; very long texts are lists of
chunks of at most LONGEST characters; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, spread_join

SHORTEST, LONGEST = 512, 8192
#: A chunk ends after the first white space from SHORTEST characters on that follows one of these pairs of letters.
CUT = rf"(?s).{{{SHORTEST},{LONGEST}}}?[dglr][aosy]\s|.{{1,{LONGEST}}}"


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, all else as it is; the quick way is taken where a text has nothing beyond ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def key_of(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk).bitwiseAND((1 << bits) - 1) if bits < 64 else F.xxhash64(chunk)


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """row, doc_id, text_sha256, recipe of every document; equal recipes mean equal texts. bits: of the chunks' hash."""
    texts = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("text"))
    chunked = keep(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), F.regexp_extract_all("text", F.lit(CUT), F.lit(0)).alias("chunks")), "chunks", "zstd")
    plain = chunked.select("row", "doc_id", "text_sha256", F.transform("chunks", lambda c: F.struct(key_of(c, bits).alias("key"), F.lit(0).alias("no"))).alias("recipe"))
    uses = chunked.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("key", key_of(F.col("chunk"), bits))
    store = uses.select("key", "chunk").distinct()
    clashing = keep(store.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "clashing-chunks")
    if not clashing.take(1):
        return plain  # each key stands for one text, read and compared
    own = Window.partitionBy("key").orderBy("chunk")
    named = store.join(clashing, "key", "left_semi").withColumn("no", F.row_number().over(own))
    told = uses.join(named, ["key", "chunk"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "no"))).alias("nos"))
    known = plain.join(told, "row", "left")
    exact = F.transform("recipe", lambda x, i: F.struct(x["key"].alias("key"), F.coalesce(F.try_element_at("nos", i), F.lit(0)).alias("no")))
    return known.select("row", "doc_id", "text_sha256", exact.alias("recipe"))


def exact_duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document; of equal texts the largest doc_id stays.

    Groups are counted before they move, and rows of groups that hold many of them are spread over several tasks.
    """
    rows = keep(recipes(docs, bits), "recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size")).where("group_size > 1")
    both = spread_join(rows, keep(groups, "copies"), "recipe", "row")
    alone = F.col("top").isNull()
    return both.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.row") == F.col("row"))).alias("kept"), "text_sha256",
    )


def op13(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs)


OP13_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by x) as group_size, row_number() over w = 1 as kept, sha256(x) as text_sha256
from t window w as (partition by x order by doc_id desc nulls last)
"""
