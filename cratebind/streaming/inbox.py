"""New playlists as a stream: every batch of files runs the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.cascade import match
from ..sources.library import read_snapshot
from ..sources.playlists import entries_of_lines, file_path, lines_of


def watch(spark: SparkSession, inbox: str, snapshot: str, out: str, state: str, **options) -> StreamingQuery:
    """Match the playlists that arrive in `inbox` and append their results as Parquet to `out`, once each."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", "true").load(inbox).select(file_path().alias("playlist"), "value")

    def work(batch: DataFrame, number: int) -> None:
        tracks, postings = read_snapshot(batch.sparkSession, snapshot)
        done = match(entries_of_lines(lines_of(batch)), tracks, postings, **options)
        done.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch replaces itself

    return files.writeStream.foreachBatch(work).option("checkpointLocation", state).trigger(availableNow=True).start()
