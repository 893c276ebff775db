"""Exact ranks of whole numbers within groups, for all groups at once.

No group is sorted. A round counts, for every group and rank asked for, the values between the bounds that are known in at
most ``BINS`` bins of equal width, and goes on with the bin that holds the rank; the number of rounds follows from the
widest group (two for a span of 16 million), is known before the first, and each is one shuffle of counts. So a group with a third of all rows
costs its tasks no more than others: only counts of bins meet. Bounds are a row a group and rank, and are broadcast only where they fit, measured.

Defined cases: nulls don't count; a null group is a group; a group without values, or a rank outside it, gives null;
groups come out once, with ``n``, the number of their values; spans of a group must stay under 2^62.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept, maybe_broadcast

BINS = 4096


def group_ranks(values: DataFrame, by: tuple[str, ...], column: str, ranks: dict[str, Callable[[Column], Column]], bins: int = BINS) -> DataFrame:
    """``by``, n, and the value at each rank (from 1), which is given as a function of n."""
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    rows = kept(values.select(group.alias("g"), F.col(column).cast("bigint").alias("v")), "ranked")
    spans = kept(rows.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "spans")
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), of(F.col("n")).cast("bigint").alias("left")) for name, of in ranks.items()))
    state = spans.select("g", "n", "low", "high", F.inline(wanted)).where("left between 1 and n").drop("n")
    widest = state.agg(F.max(F.col("high") - F.col("low"))).first()[0]
    reach = 1
    while widest is not None and reach <= widest:
        reach *= bins
        width = F.ceil((F.col("high") - F.col("low") + 1) / bins)
        state = kept(state.withColumn("width", width.cast("bigint")), "bounds")
        near = rows.join(maybe_broadcast(state.select("g", "name", "low", "high", "width")), "g").where("v between low and high")
        counts = near.groupBy("g", "name", F.expr("(v - low) div width").alias("bin")).agg(F.count("*").alias("here"))
        upto = F.sum("here").over(Window.partitionBy("g", "name").orderBy("bin"))
        found = counts.withColumn("upto", upto).join(maybe_broadcast(state), ["g", "name"]).where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("here") < F.col("left")))
        begin = F.col("low") + F.col("bin") * F.col("width")
        state = found.select("g", begin.alias("low"), F.least("high", begin + F.col("width") - 1).alias("high"), "name", (F.col("left") - F.col("upto") + F.col("here")).alias("left"))
    at = state.groupBy("g").agg(*(F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks))
    out = spans.select("g", "n").join(at, "g", "left")
    return out.select(*([f"g.{c}" for c in by]), "n", *ranks)


def group_medians(values: DataFrame, by: tuple[str, ...], column: str, q: float = 0.95) -> DataFrame:
    """``by``, n, median (the mean of the middle two) and the nearest-rank percentile; both 0 for a group without values."""
    ranks = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1, "_top": lambda n: F.greatest(F.lit(1), F.ceil(n * F.lit(q) - 1e-9))}
    out = group_ranks(values, by, column, ranks)
    none = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*by, "n", none((F.col("_low") + F.col("_high")) / 2).cast("double").alias("median"), none(F.col("_top")).alias("percentile"))
