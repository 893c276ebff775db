"""Weighted draws from dimension tables: each row's number in [0, 1) falls into the interval of one choice of its group.

Choices of a group (a region's cities, an insurer's schemes, a ward's rates) get intervals as long as their share of the group's
weight; rows meet them by an equi-join on the group and a range on the number. Choices are broadcast only where they fit, measured;
else both sides are dealt by group, and a hot group of rows is split by adaptive execution. Numbers come from hashes, so any part of the rows
can be drawn alone and twice alike.

Defined cases: null groups are a group; a group without choices of a positive weight draws null; null and negative weights are none; rows
whose number is null draw null; equal choices have an interval each, and stand in the order of their values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import maybe_broadcast


def unit(*parts: Column) -> Column:
    """A number in [0, 1) out of 32 bits of an MD5 of the parts, which other engines have as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def intervals(choices: DataFrame, by: tuple[str, ...], values: tuple[str, ...], weight: str) -> DataFrame:
    """(group, values, lower, upper) of the choices that can be drawn."""
    fine = choices.where(F.col(weight) > 0).select(F.struct(*(F.col(b) for b in by)).alias("group") if by else F.struct(F.lit(0).alias("all")).alias("group"), *values, F.col(weight).cast("double").alias("w"))
    group = Window.partitionBy("group")
    upto = F.sum("w").over(group.orderBy(*values).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(group)
    # The last interval ends at one, however the sums round.
    return fine.select("group", *values, ((upto - F.col("w")) / total).alias("lower"), F.when(upto >= total, 1.0).otherwise(upto / total).alias("upper"))


def draw(rows: DataFrame, number: Column, choices: DataFrame, by: tuple[str, ...], values: tuple[str, ...], weight: str = "weight") -> DataFrame:
    """All columns of ``rows`` and the ``values`` of the choice that each row draws; ``by`` are columns of both."""
    named = {v: f"_drawn_{i}" for i, v in enumerate(values)}
    held = intervals(choices, by, values, weight).select("group", *(F.col(v).alias(n) for v, n in named.items()), "lower", "upper")
    group = F.struct(*(F.col(b) for b in by)) if by else F.struct(F.lit(0).alias("all"))
    asked = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), group.alias("group"), number.alias("_number"))
    out = asked.join(maybe_broadcast(held), (asked["group"] == held["group"]) & (F.col("_number") >= F.col("lower")) & (F.col("_number") < F.col("upper")), "left")
    return out.select("_row.*", *(F.col(n).alias(v) for v, n in named.items()))
