"""Quantiles of lengths and latencies by mergeable sketches: a sketch a group and shard is kept, and read together later.

A KLL sketch of parameter ``K`` = 200 holds a few hundred numbers however many it has seen, and a quantile read from it is
off by at most ``ERROR`` = 1.65 hundredths of the ranks, with a probability of 0.99; merging costs nothing of that. So a shard is sketched once, when it is
written, and totals are merges of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K, ERROR = 200, 0.0165
WARM_UP = 3


def sketches(rows: DataFrame, by: tuple[str, ...], number: Column, k: int = K) -> DataFrame:
    """``by``, n and sketch, of whole numbers that aren't null."""
    return rows.select(*by, number.cast("bigint").alias("v")).where("v is not null").groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("v", F.lit(k)).alias("sketch"))


def merged(kept: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The sketches of fewer groups, out of those of more."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def quantiles(kept: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """All columns of sketches but the sketch, with a column for each quantile."""
    at = {name: F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)) for name, q in wanted.items()}
    return kept.withColumns(at).drop("sketch")


def latency(runs: DataFrame, by: tuple[str, ...], warm_up: int = WARM_UP) -> DataFrame:
    """``by``, n, p50, p95 and mean in milliseconds of (by, run, microseconds), without each group's first runs."""
    counted = runs.where(F.col("run") >= warm_up)
    means = counted.groupBy(*by).agg((F.avg("microseconds") / 1000).alias("mean_ms"))
    found = quantiles(sketches(counted, by, F.col("microseconds")), {"p50": 0.5, "p95": 0.95})
    return found.join(means, list(by)).select(*by, "n", (F.col("p50") / 1000).alias("p50_ms"), (F.col("p95") / 1000).alias("p95_ms"), "mean_ms")
