"""Splits, balance, stratified samples and content hashes of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_for(index: Column, layouts: int = 21) -> Column:
    """80 / 10 / 10 by an item's place within its layout, layouts taking turns."""
    place = F.pmod(F.floor(index / layouts), F.lit(10))
    return F.when(place < 8, "train").when(place == 8, "val").otherwise("synth_test")


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count("*").alias("n"))


def class_balance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n) over several columns in one pass."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    return rows.select(F.inline(pairs)).groupBy("key", "value").agg(F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, strata: list[str], n: int, order: Column) -> DataFrame:
    """n rows, the strata taking turns, each in the given order.

    Ranks beyond n can't be in the sample, so each stratum gives n rows at most before they meet.
    """
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(order))
    return rows.withColumn("turn", rank).where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def corpus_hash(hashes: DataFrame, column: str, prefix: int = 2) -> DataFrame:
    """One digest over all hashes, whatever their order: digests of the sorted hashes under each prefix, then of
    those, so no task holds all of them."""
    shard = F.substring(column, 1, prefix)
    parts = hashes.groupBy(shard.alias("shard")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ""), 256).alias("digest"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "digest"))), lambda s: s["digest"]), ""), 256).alias("digest"))


def manifest_hash(hashes: DataFrame, column: str) -> DataFrame:
    """SHA-256 over all sorted hashes in one string, for manifests that fit one task."""
    return hashes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ""), 256).alias("digest"))


def file_hashes(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of a ``binaryFile`` frame."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def folder_size(files: DataFrame) -> DataFrame:
    """Bytes and MB of a ``binaryFile`` frame; null MB when nothing is there."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), (F.sum("length") / 1048576.0).alias("mb"))


def weighted_choice(unit: Column, choices: dict[str, float]) -> Column:
    """The choice whose share of [0, 1) holds ``unit``."""
    out, upper = F.lit(list(choices)[-1]), sum(choices.values())
    for name, weight in reversed(list(choices.items())):
        out = F.when(unit < upper, name).otherwise(out)
        upper -= weight
    return out


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) that hangs on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


#: Shares of page quality.
QUALITY = {"clean": 0.20, "light": 0.35, "medium": 0.30, "heavy": 0.15}


def sample_quality(*parts: Column) -> Column:
    return weighted_choice(hashed_unit(F.lit("quality"), *parts), QUALITY)
