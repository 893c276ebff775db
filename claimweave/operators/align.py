"""Where values stand on a page: the best line for each value, by partial likeness.

A value and a line that are alike enough share pairs of letters, so they meet by an equi-join on these within
their page, and only lines that share enough are compared in full. The bound loses nothing: let the shorter of the two have m
letters, the window of the longer that is likest w <= m, and L letters in common. A likeness of 0.75 means 2L >= 0.75 (m + w), so
of the shorter at most 0.625m - 0.375w letters are dropped and 0.625w - 0.375m put in. A letter dropped breaks two of the m - 1 pairs,
one put in breaks one, and w >= 0.6m, so at most 0.8m pairs break: at least 0.2m - 1 are left, counted as often as they occur.
Where that is no pair (m < 6) the two sides of a page meet as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.similarity import partial_ratio
from ..functions.text import casefold, let

FLOOR = 75.0
SHORT = 6


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _pairs(text: Column) -> Column:
    """Pairs of letters, each with the number of times it was there before."""
    every = F.transform(F.sequence(F.lit(1), F.char_length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))
    sorted_pairs = F.sort_array(F.when(F.char_length(text) > 1, every).otherwise(F.array().cast("array<string>")))
    # Equal pairs stand together, so a pair's place less that of its first is its count; F.array_position finds the first.
    return let(sorted_pairs, lambda s: F.transform(s, lambda p, i: F.struct(p.alias("pair"), (i + 1 - F.array_position(s, p)).alias("again"))))


def candidates(values: DataFrame, lines: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, which, top, v, t): values and lines of a page that may be alike by ``FLOOR``; ``values`` has page, which, v, and ``lines`` page, top, t."""
    sized = lambda df, c: df.withColumn(f"n{c}", F.char_length(c))
    values, lines = sized(values.where("v <> ''"), "v"), sized(lines.where("t <> ''"), "t")
    m = F.least("nv", "nt")
    short = values.where(F.col("nv") < SHORT).join(lines, page_col).unionByName(values.where(F.col("nv") >= SHORT).join(lines.where(F.col("nt") < SHORT), page_col))
    long_values, long_lines = values.where(F.col("nv") >= SHORT), lines.where(F.col("nt") >= SHORT)
    spread = lambda df, key, c: df.select(page_col, key, f"n{c}", F.explode(_pairs(F.col(c))).alias("p"))
    met = spread(long_values, "which", "v").join(spread(long_lines, "top", "t"), [page_col, "p"]).groupBy(page_col, "which", "top", "nv", "nt").agg(F.count("*").alias("shared"))
    near = met.where(F.col("shared") >= 0.2 * m - 1).select(page_col, "which", "top")
    whole = near.join(values, [page_col, "which"]).join(lines, [page_col, "top"])
    columns = [page_col, "which", "top", "v", "t"]
    return short.select(*columns).unionByName(whole.select(*columns))


def align_values(values: DataFrame, lines: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, path, value, top, score): the line of the page that holds a value best, from 0.75; the first on a tie.

    ``values`` is (page, path, value), ``lines`` (page, top, text), a row for each top; only the two sides of one page meet. Null and empty
    values and lines align with nothing, equal values have a row each.
    """
    order = Window.partitionBy(page_col).orderBy("path", "value")
    asked = values.where("value <> ''").select(page_col, "path", "value", F.row_number().over(order).alias("which"), casefold(F.col("value")).alias("v"))
    found = candidates(asked.select(page_col, "which", "v"), lines.where("text <> ''").select(page_col, "top", casefold(F.col("text")).alias("t")), page_col)
    scored = found.withColumn("score", _likeness("v", "t")).where(F.col("score") >= FLOOR)
    best = scored.groupBy(page_col, "which").agg(F.max_by(F.struct("top", "score"), F.struct("score", -F.col("top"))).alias("b"))
    return asked.join(best, [page_col, "which"]).select(page_col, "path", "value", F.col("b.top").alias("top"), (F.col("b.score") / 100).alias("score"))


def find_box(values: DataFrame, lines: DataFrame, page_col: str = "page_id") -> DataFrame:
    """The same by substrings alone, natively: the likeness is the share of the longer that the shorter makes up, from 0.5."""
    v, t = F.lower(F.trim("value")), F.lower(F.trim("text"))
    near = values.where("trim(value) <> ''").join(lines.where("trim(text) <> ''"), page_col).where(F.contains(v, t) | F.contains(t, v))
    share = F.least(F.char_length(v), F.char_length(t)) / F.greatest(F.char_length(v), F.char_length(t))
    scored = near.withColumn("score", share).where(F.col("score") >= 0.5)
    best = scored.groupBy(page_col, "path", "value").agg(F.max_by(F.struct("top", "score"), F.struct("score", -F.col("top"))).alias("b"))
    return best.select(page_col, "path", "value", "b.top", "b.score")
