"""Run metrics: summaries, percentiles, slowest entries, playlist and library statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored


def exact_percentiles(rows: DataFrame, value: str, by: list[str], **shares: float) -> DataFrame:
    """One row for each group of `by` with the named shares' percentiles of a column, between neighbours in proportion; nulls do not count.

    The values are sorted by range over all tasks, and each row has a number that follows the order. Which numbers are asked for is worked
    out from the counts of each group in each task, so no task has to see all values of a group.
    """
    plain = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    placed = plain.repartitionByRange(*by, "__v").sortWithinPartitions(*by, "__v")
    placed = stored(placed.select(*by, "__v", F.spark_partition_id().alias("__task"), F.monotonically_increasing_id().alias("__id")), "sorted-values")
    counts = placed.groupBy(*by, "__task").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"__all": F.sum("__n").over(whole), "__before": F.sum("__n").over(whole.orderBy("__task")) - F.col("__n")})
    position = lambda p: (F.col("__all") - 1) * F.lit(p)
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), edge.cast("long").alias("k"), side.alias("share")) for name, p in shares.items() for edge, side in ((F.floor(position(p)), F.floor(position(p)) + 1 - position(p)), (F.floor(position(p)) + 1, position(p) - F.floor(position(p)))))))
    asked = counts.withColumn("__w", wanted).where((F.col("__w.share") > 0) & (F.col("__w.k") >= F.col("__before")) & (F.col("__w.k") < F.col("__before") + F.col("__n")))
    asked = asked.select((F.col("__first") + F.col("__w.k") - F.col("__before")).alias("__id"), "__w.name", "__w.share")
    met = placed.join(asked, "__id")
    parts = [F.sum(F.when(F.col("name") == name, F.col("__v") * F.col("share"))).alias(name) for name in shares]
    return met.groupBy(*by).agg(*parts)


def run_summary(stats: DataFrame, wall: Column | float | None = None) -> DataFrame:
    """One row over match statistics(phase, found, elapsed, full_scan, index_size)."""
    total = F.sum("elapsed")
    seconds = total if wall is None else (F.lit(wall) if isinstance(wall, (int, float)) else wall)
    head = stats.agg(
        F.count("*").alias("entries"), F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"), F.count_if("full_scan").alias("full_scans"),
        F.count_if(~F.col("full_scan")).alias("scans_avoided"), F.avg("elapsed").alias("mean"), F.max("elapsed").alias("slowest"), F.max("index_size").alias("index_size"),
        F.when(seconds > 0, F.count("*") / seconds).alias("per_second"),
    )
    middle = exact_percentiles(stats.withColumn("__one", F.lit(1)), "elapsed", ["__one"], p50=0.5, p95=0.95)
    both = head.withColumn("__one", F.lit(1)).join(middle, "__one", "left")
    return both.select("entries", "found", "missing", "full_scans", "scans_avoided", "mean", "slowest", "p50", "p95", "index_size", "per_second")


def phase_summary(stats: DataFrame) -> DataFrame:
    head = stats.groupBy("phase").agg(F.count("*").alias("entries"), F.sum("elapsed").alias("total"), F.avg("elapsed").alias("mean"), F.max("elapsed").alias("slowest"))
    high = exact_percentiles(stats, "elapsed", ["phase"], p95=0.95).withColumnRenamed("phase", "__phase")
    return head.join(high, F.col("phase").eqNullSafe(F.col("__phase")), "left").select("phase", "entries", "total", "mean", "p95", "slowest").orderBy("phase")


def report(stats: DataFrame, k: int = 10) -> DataFrame:
    """The lines of a run's report, numbered: its summary, its phases and its slowest entries. Small whatever the run's size."""
    head = run_summary(stats).select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.to_json(F.struct("*")).alias("line"))
    phases = phase_summary(stats).select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy("phase")).alias("n"), F.to_json(F.struct("*")).alias("line"))
    slow = slowest(stats, k).select(F.lit(2).alias("part"), F.row_number().over(Window.orderBy(F.desc("elapsed"), "seq")).alias("n"), F.to_json(F.struct("seq", "phase", "elapsed")).alias("line"))
    return head.unionByName(phases).unionByName(slow)


def write_report(stats: DataFrame, folder: str) -> None:
    report(stats).orderBy("part", "n").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(folder)


def slowest(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("elapsed"), "seq").limit(k)


def library_stats(tracks: DataFrame) -> DataFrame:
    """One row: how many tracks have tags, derived tags, bitrate and duration."""
    tagged = F.col("title").isNotNull() | F.col("artist").isNotNull()
    return tracks.agg(
        F.count("*").alias("total"), F.count_if(tagged).alias("with_tags"), F.count_if(~tagged).alias("without_tags"), F.count_if(F.coalesce("auto_tags", F.lit(False))).alias("auto_tags"),
        F.count_if(F.coalesce("bitrate", F.lit(0)) > 0).alias("with_bitrate"), F.count_if(F.coalesce("duration", F.lit(0.0)) > 0).alias("with_duration"),
    )


def playlist_status(entries: DataFrame) -> DataFrame:
    """Per playlist: entries by status (found, manual, missing, invalid) and progress in percent."""
    done = F.count_if(F.col("status").isin("found", "manual", "missing"))
    return entries.groupBy("playlist").agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("found", "manual", "missing", "invalid")],
        F.floor(done / F.count("*") * 100).cast("int").alias("progress"),
    )


def percent(done: Column, total: Column) -> Column:
    """Rounded percentage within 0 and 100; halves to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(total > 0, F.bround(done / total * 100, 0)).otherwise(0))).cast("int")


def bitrate_label(bitrate: Column) -> Column:
    return F.when(F.coalesce(bitrate, F.lit(0)) > 0, F.concat(bitrate.cast("string"), F.lit(" kbps"))).otherwise("?")


def clock_label(ms: Column) -> Column:
    seconds = F.greatest(F.lit(0), F.floor(ms / 1000))
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("int"), (seconds % 60).cast("int"))
