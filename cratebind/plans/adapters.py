"""The linkage inputs, derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """
select track_id, 'C:/Music/' || p_brand || '/' || track_id || '/' || coalesce(artist || ' - ', '') || title || '.mp3' as path, title, artist, duration, bitrate, auto_tags
from (
  select p_partkey as track_id, p_brand,
         p_name || case p_size % 7 when 0 then ' (Official Video)' when 1 then ' Remix' when 2 then ' [HD]' else '' end as title,
         case when p_partkey % 10 = 7 then null when p_partkey % 10 = 8 then 'Various' when p_partkey % 10 < 4 then p_type || ' & ' || p_brand else p_type end as artist,
         cast(150 + p_partkey % 20 as double) + cast(p_size % 2 as double) / 2 as duration,
         cast(case p_size % 4 when 0 then 128 when 1 then 192 when 2 then 256 else 320 end as int) as bitrate,
         p_partkey % 5 = 0 as auto_tags
  from part) p0
"""

ENTRIES = f"""
select playlist, cast(row_number() over (partition by playlist order by n, l_partkey, l_suppkey, l_quantity) - 1 as int) as pos,
       case when flag = 'R' then path when flag = 'N' and l_partkey % 3 = 0 then 'netsearch://td' || (100000 + l_partkey)
            else 'D:/old/' || coalesce(e_artist || ' - ', '') || e_title || '.mp3' end as raw_path,
       case when flag = 'A' and l_partkey % 11 = 0 then null else e_title end as title,
       case when flag = 'A' and l_partkey % 11 = 0 then null else e_artist end as artist,
       case when l_partkey % 13 = 0 then null else cast(150 + l_partkey % 20 + n - 3 as double) end as duration
from (
  select l_orderkey as playlist, l_linenumber as n, l_partkey, l_suppkey, l_quantity, l_returnflag as flag, t.path,
         case l_linenumber % 5 when 0 then p_name || ' (Official Video)' when 1 then p_name when 2 then p_type || ' - ' || p_name when 3 then upper(p_name) || ' HD' else p_name || ' remix' end as e_title,
         case l_linenumber % 5 when 2 then null when 3 then p_type || ' feat. ' || p_brand else p_type end as e_artist
  from lineitem join part on l_partkey = p_partkey join ({TRACKS}) t on t.track_id = l_partkey) l0
"""

STATS = """
select event_id as seq, event_type as phase, event_id % 5 <> 0 as found, value as elapsed, event_id % 97 = 0 as full_scan, cast(event_id % 1000 as bigint) as index_size from events
"""


def view(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def met_in_parts(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df; of more than `most` rows, joins shuffle it. Spark estimates a table by its files, which hold repeated values once, and would send
    many times the size that it looks for to the driver and from there to all."""
    return df.hint("merge") if df.count() > most else df


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    view(spark, folder, "part")
    return spark.sql(TRACKS)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    view(spark, folder, "lineitem")
    met_in_parts(spark.read.parquet(f"{folder}/part.parquet")).createOrReplaceTempView("part")
    return spark.sql(ENTRIES)


def stats(spark: SparkSession, folder: str) -> DataFrame:
    view(spark, folder, "events")
    return spark.sql(STATS)
