"""Benchmark decontamination by winnowing.

Every window of ``span`` words keeps the least of its k-gram hashes, the rightmost of equal ones, in documents and
in benchmark items alike. Neighbouring windows mostly keep the same k-gram, which is one fingerprint: about
2 of ``span - k + 2`` positions are left. A span of ``span`` words that both sides share keeps the same k-gram on
both. Fingerprints are joined, and a hit is extended word by word from the k-gram to the left and to the right,
as far as a window can reach; extensions of ``span`` words or more are hits. All shared spans of ``span`` words
or more are found, and nothing else. Items of fewer words are one window each and are looked for by their whole
hash, then compared.

Of items only distinct surroundings of fingerprints are joined, each with the set of items that have it, so a
passage that many items hold is one row, and a document gets sets of items, not a row for each. They
are broadcast if they fit within ``max_broadcast`` bytes, measured; then documents are turned into
fingerprints, joined and compared in one pass, and only one row a document and one a hit are shuffled. Beyond that
fingerprints are shuffled with the words around them and compared in the same way.

Defined cases: null or empty texts have no words; items without words are never found; every row gets its own
result, rows that share an id too; rows that repeat id and text get equal ones; items with a null id make hits but are
not listed; items that share an id are listed once; texts of any length go in whole; other columns of documents
and items are neither needed nor returned (``drop_contaminated`` returns those of documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, WORD_SEPARATORS, fits, table, text_key, without, words, written

SPAN, K = 10, 5


def _rightmost(value: Column, grams: list[Column], first: int) -> Column:
    """The offset of the last of ``grams`` that is ``value``; the first one's offset is ``first``."""
    out = F.lit(first)
    for i, gram in enumerate(grams[1:], first + 1):
        out = F.when(gram == value, i).otherwise(out)
    return out


def fingerprints(rows: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """The columns of ``rows``, with at, size, fp and last: a row for each fingerprint of the words w, and for each place
    of windows of ``short`` lengths. One more row for each text has no fingerprint and ``last``."""
    hashed = rows.withColumn("_h", F.transform("w", lambda x: F.xxhash64(x)))
    # What follows runs once a word, as compiled code: functions of arrays would be interpreted.
    placed = hashed.withColumn("_pos", F.explode(F.sequence(F.lit(0), F.size("w"))))
    h = {i: F.get("_h", F.col("_pos") + i) for i in range(-1, span)}  # the word before, and those of the window that begins here
    placed = placed.withColumns({f"_h{i}": x for i, x in h.items()})
    h = {i: F.col(f"_h{i}") for i in h}
    n_grams = span - k + 2  # of the window before and of this one
    placed = placed.select(
        *rows.columns, "_pos", *(F.xxhash64(*(h[i + j] for j in range(k))).alias(f"_g{i + 1}") for i in range(-1, n_grams - 1)),
        *(F.when(F.col("_pos") + n <= F.size("w"), F.xxhash64(F.lit(n), *(h[j] for j in range(n)))).alias(f"_short{n}") for n in short),
    )
    g = [F.col(f"_g{i}") for i in range(n_grams)]
    least = placed.withColumns({"_least": F.least(*g[1:]), "_before": F.least(*g[:-1])})
    offset, before = _rightmost(F.col("_least"), g[1:], 0), _rightmost(F.col("_before"), g[:-1], -1)
    new = (F.col("_pos") + span <= F.size("w")) & ((F.col("_pos") == 0) | (offset != before))
    mark = lambda fp, at, size, last: F.struct(fp.alias("fp"), at.alias("at"), F.lit(size).alias("size"), last.alias("last"))
    marks = [mark(F.when(new, F.col("_least")), F.col("_pos") + offset, span, F.col("_pos") == F.size("w"))]
    marks += [mark(F.col(f"_short{n}"), F.col("_pos"), n, F.lit(False)) for n in short]
    # Rows of an array, not columns: a filter on columns would go below them and compute each again for every use.
    out = least.select(*rows.columns, F.inline(F.array(*marks)))
    return out.where(F.col("fp").isNotNull() | F.col("last")).select(*rows.columns, "at", "size", "fp", "last")


def _around(w: Column, at: Column, size: Column, n: Column, span: int, k: int) -> tuple[Column, Column]:
    """The words that a window through the k-gram at ``at`` can reach, and how many of them precede it."""
    low = F.when(size == span, F.greatest(at - (span - k), F.lit(0))).otherwise(at)
    high = F.when(size == span, F.least(at + span, n)).otherwise(at + size)
    return F.slice(w, low + 1, high - low), at - low


def item_windows(items: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """Distinct (fp, size, around, lead) of all items, with those that have it (ids as text) and a key of that set."""
    rows = items.withColumn("n", F.size("w")).where("n > 0")
    marks = fingerprints(rows, span, k, short).where("not last")
    marks = marks.where(F.when(F.col("n") >= span, F.col("size") == span).otherwise((F.col("size") == F.col("n")) & (F.col("at") == 0)))
    around, lead = _around(F.col("w"), F.col("at"), F.col("size"), F.col("n"), span, k)
    groups = marks.select("fp", "size", around.alias("around"), lead.alias("lead"), F.col("item_id").cast("string").alias("item"))
    groups = groups.groupBy("fp", "size", "around", "lead").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return groups.withColumn("set", F.struct(F.xxhash64("items").alias("a"), F.xxhash64(F.lit(1), "items").alias("b")))


def _extended(m: Column, span: int, k: int) -> Column:
    """The span (begin, end) of the document that matches an item's window through the fingerprint, or null.

    From the k-gram on, words are compared to the left and to the right, as far as a window can reach.
    """
    same = {d: F.coalesce(F.get(m["w"], m["here"] + d) == F.get(m["around"], m["lead"] + d), F.lit(False)) for d in range(k - span, span)}
    left = right = F.lit(span - k)
    for d in reversed(range(span - k)):
        left = F.when(~same[-1 - d], d).otherwise(left)
        right = F.when(~same[k + d], d).otherwise(right)
    core = same[0]
    for d in range(1, k):
        core &= same[d]
    whole = (m["size"] < span) & (F.slice(m["w"], m["here"] + 1, m["size"]) == m["around"])
    long = (m["size"] == span) & core & (left + right >= span - k)
    begin, end = F.when(whole, m["at"]).otherwise(m["at"] - left), F.when(whole, m["at"] + m["size"]).otherwise(m["at"] + k + right)
    return F.when(whole | long, F.struct(begin.alias("begin"), end.alias("end")))


def _judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """A row for each id and text: doc_id, key, copies, n_words, n_hit and item_ids."""
    items = benchmark.select("item_id", words(F.col("text"), WORD_SEPARATORS).alias("w"))
    lengths = items.select(F.size("w").alias("n")).where(f"n > 0 and n < {span}").distinct()
    short = sorted(r["n"] for r in lengths.collect())  # fewer than span numbers
    wins = written(item_windows(items, span, k, short), "windows")
    near = wins.drop("items")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), words(F.col(text_col), WORD_SEPARATORS).alias("w")).withColumn("n", F.size("w"))
    marks = fingerprints(rows, span, k, short)
    near = near.select(F.col("fp").alias("_fp"), F.col("size").alias("_size"), "around", "lead", "set")
    pair = (F.col("fp") == F.col("_fp")) & (F.col("size") == F.col("_size"))
    if fits(near, max_broadcast):
        joined, w, here = marks.join(F.broadcast(near), pair, "left"), F.col("w"), F.col("at")
    else:
        window, before = _around(F.col("w"), F.col("at"), F.col("size"), F.col("n"), span, k)
        carried = marks.where("not last").select("doc_id", "key", "n", "at", "size", "fp", "last", window.alias("w"), before.alias("_here")).join(near, pair)
        ends = rows.select("doc_id", "key", "n", F.lit(True).alias("last"))
        joined, w, here = carried.unionByName(ends, allowMissingColumns=True), F.col("w"), F.col("_here")
    # Only rows that meet a window are compared, in a step of its own: as a function of an array it stays outside
    # the code that runs once a word.
    met = joined.where(F.col("last") | F.col("around").isNotNull())
    match = F.struct(w.alias("w"), here.alias("here"), "around", "lead", "size", "at")
    hits = met.withColumn("found", F.get(F.transform(F.when(~F.col("last"), F.array(match)), lambda m: _extended(m, span, k)), F.lit(0)))
    per_doc = hits.groupBy("doc_id", "key").agg(
        F.count_if("last").alias("copies"), F.max("n").cast("long").alias("n_words"), F.sort_array(F.collect_set("found")).alias("spans"),
        F.collect_set(F.when(F.col("found").isNotNull(), F.col("set"))).alias("sets"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", start, lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["begin"]))).alias("n")), lambda acc: acc["n"])
    per_doc = per_doc.withColumn("n_hit", covered).drop("spans")
    sets = wins.select(F.col("set").alias("_set"), "items").dropDuplicates(["_set"])
    sets = F.broadcast(sets) if fits(wins.select("set", "items"), max_broadcast) else sets
    one = per_doc.withColumn("_set", F.explode_outer("sets")).join(sets, "_set", "left")
    keys = ["doc_id", "key", "copies", "n_words", "n_hit"]
    return one.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("item_ids"))


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) and contaminated, for every row."""
    every = _judged(docs, benchmark, **how).withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
    return every.select("doc_id", "n_words", "n_hit", "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows that share no window with an item."""
    found = _judged(docs, benchmark, id_col, text_col, **how).where("n_hit > 0")
    return without(docs, found.select(F.col("doc_id").alias("id"), "key"), {"id": F.col(id_col), "key": text_key(F.col(text_col))})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
