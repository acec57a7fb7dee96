"""Percentiles from sorted ranges against numpy."""

import random

import numpy as np
from pyspark.sql import functions as F

from cratebind.operators import metrics


def test_percentiles_are_exact(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([1.5, 2.0, rng.random(), rng.random() * 1e6, -3.0])) for g, n in (("a", 1), ("b", 2), ("c", 500), (None, 77)) for _ in range(n)]
    rows += [("c", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = {"low": 0.0, "some": 0.37, "half": 0.5, "high": 0.95, "top": 1.0}
    found = {r["g"]: r for r in metrics.exact_percentiles(df, "v", ["g"], **shares).collect()}
    assert set(found) == {"a", "b", "c", None}
    for g, r in found.items():
        own = [v for k, v in rows if k == g and v is not None]
        for name, p in shares.items():
            assert abs(r[name] - np.quantile(own, p)) <= 1e-9 * max(1.0, abs(r[name]))


def test_percentiles_have_no_reducer_of_all_values(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("elapsed"), F.lit("p").alias("phase"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange("phase", "elapsed").groupBy(F.spark_partition_id().alias("t")).count().collect()
        assert len(ranged) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in ranged) < 10_000
        assert metrics.exact_percentiles(df, "elapsed", ["phase"], p95=0.95).first()["p95"] == 0.95 * 19_999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_summaries_of_no_statistics(spark):
    none = spark.createDataFrame([], "seq long, phase string, found boolean, elapsed double, full_scan boolean, index_size long")
    r = metrics.run_summary(none).first()
    assert (r["entries"], r["p50"], r["slowest"]) == (0, None, None) and metrics.phase_summary(none).collect() == []
