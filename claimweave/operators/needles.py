"""Which texts hold which needles, for tables of needles too large to compile into a test.

Each needle is keyed by the rarest of its q-grams, as often as these are in the texts; a text meets, by an equi-join on its
own q-grams, only the needles whose rarest one it has, and those are then looked for. Needles shorter than ``q`` are keyed by themselves, among the
shorter grams of the texts. Equal texts are looked at once. A needle with a gram that no text has meets nothing.

Defined cases: letters are compared in lower case; null texts and null needles match nothing; an empty needle is in every text
and is left to the caller, as that is no join; texts and needles of any length go in whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept, maybe_broadcast

Q = 3


def grams(text: Column, sizes: list[int]) -> Column:
    """The distinct substrings of these lengths, by one walk over the text for each."""
    of = lambda n: F.regexp_extract_all(text, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1))
    return F.array_distinct(F.concat(*map(of, sizes)))


def holding(texts: DataFrame, needles: DataFrame, text_col: str = "text", needle_col: str = "needle", q: int = Q) -> DataFrame:
    """(text, needle) in lower case, each pair once, of texts that hold a needle."""
    wanted = needles.select(F.lower(needle_col).alias("needle")).where("needle <> ''").distinct()
    said = texts.select(F.lower(text_col).alias("text")).where("text <> ''").distinct()
    size = F.least(F.char_length("needle"), F.lit(q))
    sizes = sorted(r[0] for r in wanted.select(size).distinct().collect())  # q rows at most
    if not sizes:
        return said.select("text", F.lit("").alias("needle")).limit(0)
    spread = said.select("text", F.explode(grams(F.col("text"), sizes)).alias("gram"))
    keys = wanted.select("needle", F.explode(F.filter(grams(F.col("needle"), sizes), lambda g: F.char_length(g) == size)).alias("gram"))
    often = spread.join(maybe_broadcast(keys.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # Written, as it is measured and then sent: the texts would be gone through for either.
    rated = kept(keys.join(often, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")), "needles")
    return spread.join(maybe_broadcast(rated), "gram").where(F.contains("text", F.col("needle"))).select("text", "needle")
