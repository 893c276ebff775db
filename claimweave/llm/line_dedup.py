"""Line dedup by site-relative frequency.

A line (white space at its ends apart) is boilerplate of a site if more than ``ratio`` of
the site's pages hold it, and at least ``min_pages``: on a site of one page every line is on all of its pages,
so a share says something only of lines that repeat. Such lines are dropped from the
pages of that site; all others stay as they are.

Every page gives each of its lines once, as a 128-bit hash; counts are combined in
the tasks before the shuffle, so neither a hot site nor a line on all pages meets in one
task. A site has at most (lines of a page / ratio) boilerplate lines, so the
list of each site is short; lists are broadcast if they fit within ``max_broadcast`` bytes, measured, and
beyond that joined by site and salt. Lists are sorted, and each line of a page is looked up by halving, so a page's cost is its
lines times the logarithm of its site's list.

Defined cases: a null text stays null; blank lines stay and don't count; pages with a null
site are a site of their own; a line twice on a page counts once and is dropped
at both places; repeated rows are pages each; a page may become empty and stays; texts of any length go in
whole; columns of pages keep their values, and counts get another name (a ``_`` more) if theirs is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.text import let

from .common import MAX_BROADCAST_BYTES, fits, private, table, written

#: From shares measured on the tables (see README).
RATIO, MIN_PAGES = 0.005, 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), F.lit("\n"), -1)


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b")))


def _holds(keys: Column, steps: Column, key: Column) -> Column:
    """Whether the sorted array has the key. ``steps`` are the powers of two up to its size, the greatest first."""
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(keys, at + step - 1) <= key, at + step).otherwise(at))
    return let(below, lambda at: F.coalesce(F.get(keys, at - 1) == key, F.lit(False)))


def boilerplate(pages: DataFrame, site: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, line key and number of pages of each boilerplate line."""
    rows = pages.select(F.struct(site.alias("site")).alias("site"), text.alias("text"))
    totals = rows.groupBy("site").agg(F.count("*").alias("pages"))
    keys = F.sort_array(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: k.isNotNull()))
    once = let(keys, lambda k: F.filter(k, lambda one, i: (i == 0) | (one != F.get(k, i - 1))))
    keys = rows.select("site", F.explode(once).alias("key"))
    counts = keys.groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "site").where(F.col("n") > F.col("pages") * F.lit(ratio)).select("site", "key", "n")


def drop_boilerplate(
    pages: DataFrame, site: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, max_broadcast: int = MAX_BROADCAST_BYTES, salts: int = 64, whole: bool = False
) -> DataFrame:
    """All columns of ``pages``, the text without boilerplate, and n_lines and n_dropped.

    With ``whole`` a page of which nothing would be left stays as it is: it is one of many copies, which
    are for near-dedup to take, and their content would be gone with all of them.
    """
    own = {n: private(f"_{n}", pages) for n in ("site", "drop", "steps", "salt", "lines", "kept")}
    counts = [private(n, pages) for n in ("n_lines", "n_dropped")]
    found = written(boilerplate(pages, site, F.col(text_col), ratio, min_pages), "boilerplate")
    lists = found.groupBy("site").agg(F.sort_array(F.collect_list("key")).alias("drop"))
    lists = lists.withColumn("steps", F.transform(F.sequence(F.floor(F.log2(F.size("drop"))).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.lit(2).cast("int") ** b)).withColumn("steps", F.col("steps").cast("array<int>"))
    lists = lists.select(*(F.col(n).alias(own[n]) for n in ("site", "drop", "steps")))
    rows = pages.withColumn(own["site"], F.struct(site.alias("site")))
    if fits(found.select("site", "key"), max_broadcast):
        joined = rows.join(F.broadcast(lists), own["site"], "left")
    else:
        dealt = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(own["salt"]))
        salted = rows.withColumn(own["salt"], F.pmod(F.xxhash64(text_col, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
        joined = salted.join(dealt, [own["site"], own["salt"]], "left")
    lines, drop, steps, kept = (F.col(own[n]) for n in ("lines", "drop", "steps", "kept"))
    keep = lambda line: ~let(_key(line), lambda k: F.when(k.isNull(), False).otherwise(_holds(drop, steps, k)))
    out = joined.withColumn(own["lines"], _lines(F.col(text_col)))
    out = out.withColumn(own["kept"], F.when(drop.isNull(), lines).otherwise(F.filter(lines, keep)))
    if whole:
        left = F.exists(kept, lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "")
        out = out.withColumn(own["kept"], F.when(left, kept).otherwise(lines))
    nothing = F.col(text_col).isNull()
    made = {counts[0]: F.when(nothing, 0).otherwise(F.size(lines)).cast("long"), counts[1]: F.when(nothing, 0).otherwise(F.size(lines) - F.size(kept)).cast("long")}
    return out.withColumns(made).withColumn(text_col, F.when(~nothing, F.array_join(kept, "\n"))).select(*pages.columns, *counts)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(docs, F.col("source"))


OP7_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
l AS (
  SELECT page, doc_id, source, text, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT page, doc_id, source, text, generate_subscripts(a, 1) AS pos, unnest(a) AS line
    FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS a FROM d))),
t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (
  SELECT c.source, bare FROM (SELECT source, bare, count(DISTINCT page) AS n FROM l WHERE bare <> '' GROUP BY ALL) c
  JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > pages * 0.005),
m AS (SELECT l.*, b.bare IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare)
SELECT doc_id, source, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM m GROUP BY page, doc_id, source
"""
