"""Small state files: manual choices, alias configuration, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_map(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """key, value of a JSON object of strings, or of one field of it; anything else has no rows."""
    whole = spark.read.option("wholetext", "true").text(path).select("value")
    found = F.from_json("value", "map<string,string>") if field is None else F.from_json("value", f"struct<`{field}`:map<string,string>>")[field]
    return whole.select(F.explode(found).alias("key", "value"))


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    """Manual choices as (key, path)."""
    return read_map(spark, path).select("key", F.col("value").alias("path"))


def write_manual(rows: DataFrame, path: str) -> None:
    """(key, path) as one JSON object: a state file of what people chose by hand."""
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "path")))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias configuration as (variant, canonical), blanks left out."""
    rows = read_map(spark, path, "artist_alias").select(F.col("key").alias("variant"), F.col("value").alias("canonical"))
    return rows.where("trim(variant) <> '' and trim(canonical) <> ''")


def read_suggestions(spark: SparkSession, path: str, imported: bool = False) -> DataFrame:
    """Suggestions as written here, a JSON object a line; imported ones are one JSON array."""
    schema = "variant string, variant_norm string, canonical string, canonical_norm string, confidence double, reasons array<string>, occurrences bigint, examples array<string>"
    return spark.read.schema(schema).option("multiLine", str(imported).lower()).json(path)


def write_suggestions(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
