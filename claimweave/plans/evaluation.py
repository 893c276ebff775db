"""Evaluation queries: the truth is made of orders, predictions are the truth with faults by order number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import assemble as asm
from ..operators import evaluate as ev
from ..operators import taxonomy
from ..operators.documents import field_pairs
from ..schema import RAW_SCHEMA
from ..sources import testdata as td
from .registry import query

K = "o_orderkey"
#: Faults by divisor: no value, printed otherwise, ten times too much, another field's value, a digit off.
NULL, PRINTED, TENFOLD, OTHER, DIGIT = 7, 11, 13, 17, 19


def _orders(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """id, claim, gross and date as printed truth, and the prediction of each."""
    orders = td.table(spark, sf_dir, "orders")
    orders = orders.repartition(K) if dealt else orders
    k = F.col(K)
    gross = F.round("o_totalprice", 2).cast("decimal(18,2)")
    text = gross.cast("string")
    swapped = F.concat(F.when(F.substring(text, 1, 1) == "5", "6").otherwise("5"), F.substring(text, 2, 100))
    said = (
        F.when(k % NULL == 0, None).when(k % PRINTED == 0, money.format_amount(gross, "Rs. ")).when(k % TENFOLD == 0, (gross * 10).cast("decimal(18,2)").cast("string"))
        .when(k % OTHER == 0, F.concat(F.lit("C"), k.cast("string"))).when(k % DIGIT == 0, swapped).otherwise(text)
    )
    date = F.date_format("o_orderdate", "dd/MM/yyyy")
    true_date = F.when(k % 23 != 0, date)
    said_date = F.when(k % 29 == 0, "05|01|2O25").when(k % 31 == 0, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(date)
    return orders.select(K, F.concat(F.lit("C"), k.cast("string")).alias("claim"), text.alias("gross"), said.alias("p_gross"), true_date.alias("date"), said_date.alias("p_date"), "o_orderstatus", "o_orderpriority")


def _raw(claim: Column, gross: Column, date: Column, items: Column | None = None) -> Column:
    """A raw document with three fields."""
    given = {"insurance.claim_number": claim, "totals.gross_amount": gross, "patient.admission_date": date}
    none = F.lit(None).cast("string")
    parts = []
    for f in RAW_SCHEMA:
        if f.name == "line_items":
            parts.append((items if items is not None else F.array()).cast(f.dataType).alias(f.name))
        else:
            parts.append(F.struct(*(given.get(f"{f.name}.{n}", none).alias(n) for n in f.dataType.fieldNames())).alias(f.name))
    return F.struct(*parts)


def _pairs(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """``dealt``: orders are dealt anew, for work that is long for so few bytes of a file."""
    rows = _orders(spark, sf_dir, dealt)
    c = F.col
    return rows.select(
        c(K).alias("doc_id"), _raw(c("claim"), c("p_gross"), c("p_date")).alias("pred"), _raw(c("claim"), c("gross"), c("date")).alias("truth"),
        F.create_map(F.lit("status"), c("o_orderstatus"), F.lit("priority"), c("o_orderpriority")).alias("meta"),
    )


GROSS = ("totals.gross_amount",)
PATHS = ("insurance.claim_number", "totals.gross_amount", "patient.admission_date")


def _fields(spark: SparkSession, sf_dir: str, paths: tuple[str, ...] = PATHS) -> DataFrame:
    """The paths that these documents have; only what is asked for is normalised."""
    return field_pairs(_pairs(spark, sf_dir), paths)


_GROUPED = r"""(CASE WHEN length(d) <= 3 THEN d ELSE ltrim(reverse(regexp_replace(reverse(d[:length(d) - 3]), '(..)', '\1,', 'g')), ',') || ',' || right(d, 3) END)"""
FIELDS_SQL = rf"""
o AS (SELECT o_orderkey AS k, round(o_totalprice * 100)::BIGINT AS c, ((round(o_totalprice * 100)::BIGINT) // 100)::VARCHAR AS d, o_orderdate::DATE AS dt, o_orderstatus, o_orderpriority FROM orders),
o1 AS (SELECT *, d || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS gross FROM o),
f AS (
  SELECT k AS doc_id, 'insurance.claim_number' AS path, 'C' || k AS truth, 'C' || k AS pred, 'C' || k AS ntruth, 'C' || k AS npred, o_orderstatus, o_orderpriority FROM o1
  UNION ALL SELECT k, 'totals.gross_amount', gross,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN 'Rs. ' || {_GROUPED} || '.' || lpad((c % 100)::VARCHAR, 2, '0')
      WHEN k % 13 = 0 THEN (c * 10 // 100) || '.' || lpad((c * 10 % 100)::VARCHAR, 2, '0') WHEN k % 17 = 0 THEN 'C' || k
      WHEN k % 19 = 0 THEN CASE WHEN gross[1] = '5' THEN '6' ELSE '5' END || gross[2:] ELSE gross END,
    c::VARCHAR,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN c::VARCHAR WHEN k % 13 = 0 THEN (c * 10)::VARCHAR WHEN k % 17 = 0 THEN NULL
      WHEN k % 19 = 0 THEN (CASE WHEN gross[1] = '5' THEN '6' ELSE '5' END || c::VARCHAR[2:]) ELSE c::VARCHAR END, o_orderstatus, o_orderpriority FROM o1
  UNION ALL SELECT k, 'patient.admission_date', CASE WHEN k % 23 <> 0 THEN strftime(dt, '%d/%m/%Y') END,
    CASE WHEN k % 29 = 0 THEN '05|01|2O25' WHEN k % 31 = 0 THEN day(dt) || ' ' || strftime(dt, '%b %Y') ELSE strftime(dt, '%d/%m/%Y') END,
    CASE WHEN k % 23 <> 0 THEN dt::VARCHAR END, CASE WHEN k % 29 = 0 THEN NULL ELSE dt::VARCHAR END, o_orderstatus, o_orderpriority FROM o1)""".replace("c::VARCHAR[2:]", "(c::VARCHAR)[2:]")
_CER = "CASE WHEN coalesce(truth, '') = '' THEN CASE WHEN coalesce(pred, '') = '' THEN 0.0 ELSE 1.0 END ELSE least(1.0, levenshtein(coalesce(pred, ''), truth) / length(truth)) END"


@query(
    "field_scores",
    f"""WITH {FIELDS_SQL} SELECT path, count(*) AS n, count_if(coalesce(pred, '') = coalesce(truth, '')) AS n_exact, count_if(npred IS NOT DISTINCT FROM ntruth) AS n_normalized,
    round(avg({_CER}), 9) AS cer, count_if(ntruth IS NOT NULL) AS truth_present, count_if(ntruth IS NOT NULL AND npred IS NULL) AS misses,
    count_if(ntruth IS NULL AND npred IS NOT NULL) AS hallucinations, count_if(ntruth = npred) AS correct_when_present,
    round(count_if(ntruth = npred)::DOUBLE / count_if(ntruth IS NOT NULL), 9) AS accuracy_when_present FROM f GROUP BY path""",
)
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.score_fields(_fields(spark, sf_dir))
    return out.select("path", "n", "n_exact", "n_normalized", F.round("cer", 9).alias("cer"), "truth_present", "misses", "hallucinations", "correct_when_present", F.round("accuracy_when_present", 9).alias("accuracy_when_present"))


@query(
    "formatting_gap",
    f"""WITH {FIELDS_SQL} SELECT path, round(count_if(npred IS NOT DISTINCT FROM ntruth)::DOUBLE / count(*) - count_if(coalesce(pred, '') = coalesce(truth, ''))::DOUBLE / count(*), 9) AS gap FROM f GROUP BY path""",
)
def formatting_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.score_fields(_fields(spark, sf_dir)).select("path", F.round("formatting_gap", 9).alias("gap"))


KIND_SQL = f"""{FIELDS_SQL}, e AS (
  SELECT f.*, CASE WHEN truth IS NOT DISTINCT FROM pred THEN NULL WHEN ntruth IS NOT DISTINCT FROM npred THEN 'formatting_only'
    WHEN pred IS NULL THEN 'missed_field' WHEN truth IS NULL THEN 'hallucinated_field'
    WHEN path = 'totals.gross_amount' AND doc_id % 17 = 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN 'wrong_field'
    WHEN path = 'patient.admission_date' AND npred IS NULL THEN 'date_unparsed'
    WHEN path = 'totals.gross_amount' AND doc_id % 13 = 0 THEN 'magnitude_error'
    WHEN path = 'totals.gross_amount' THEN 'digit_confusion' ELSE 'value_confusion' END AS kind FROM f)"""


@query("error_taxonomy", f"WITH {KIND_SQL} SELECT kind, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY kind")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = taxonomy.error_cases(_fields(spark, sf_dir))
    return cases.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "error_slices",
    f"""WITH {KIND_SQL}, s AS (
      SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'path', path, count(*) FROM e WHERE kind IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'status', o_orderstatus, count(*) FROM e WHERE kind IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM e WHERE kind IS NOT NULL GROUP BY ALL) SELECT * FROM s""",
)
def error_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    cases = taxonomy.error_cases(_fields(spark, sf_dir)).join(pairs.select("doc_id", "meta"), "doc_id")
    return taxonomy.summarise(cases, "meta")


@query(
    "slice_scores",
    f"""WITH {FIELDS_SQL}, d AS (SELECT doc_id, any_value(o_orderstatus) AS st, any_value(o_orderpriority) AS pr, avg((npred IS NOT DISTINCT FROM ntruth)::INT) AS a FROM f GROUP BY doc_id)
    SELECT 'status' AS key, st AS value, count(*) AS n, round(avg(a), 9) AS accuracy, count(*) < 5 AS underpowered FROM d GROUP BY st
    UNION ALL SELECT 'priority', pr, count(*), round(avg(a), 9), count(*) < 5 FROM d GROUP BY pr""",
)
def slice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _fields(spark, sf_dir).groupBy("doc_id").agg(F.avg(F.col("npred").eqNullSafe(F.col("ntruth")).cast("int")).alias("a"))
    rows = docs.join(_pairs(spark, sf_dir).select("doc_id", "meta"), "doc_id")
    return ev.slices(rows, "meta", [F.round(F.avg("a"), 9).alias("accuracy")])


@query("document_strict_match", f"WITH {FIELDS_SQL} SELECT doc_id, bool_and(npred IS NOT DISTINCT FROM ntruth) AS strict FROM f GROUP BY doc_id")
def document_strict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("npred").eqNullSafe(F.col("ntruth"))
    return _fields(spark, sf_dir).groupBy("doc_id").agg(F.bool_and(same).alias("strict"))


@query("tree_accuracy")
def tree_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean strict equality and tree accuracies; the edit distance has no SQL."""
    scores = ev.document_scores(_pairs(spark, sf_dir, dealt=True))
    return ev.score_documents(scores).select("n", F.round("strict", 9).alias("strict"), F.round("ted", 9).alias("ted"), F.round("ted_raw", 9).alias("ted_raw"))


_SYSTEMS = {"A": 7, "B": 11, "C": 13}


def _system_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems that each miss, or misread, the gross of some orders; one prints it with its currency."""
    orders = td.table(spark, sf_dir, "orders").select(K, F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string").alias("v"))
    out = None
    for name, n in _SYSTEMS.items():
        value = F.when(F.col(K) % n == 0, None).when(F.col(K) % n == 1, F.concat("v", F.lit("9"))).otherwise(F.col("v"))
        value = F.concat(F.lit("Rs. "), value) if name == "B" else value
        rows = orders.select(F.lit(name).alias("system"), F.col(K).alias("doc_id"), F.lit("totals.gross_amount").alias("path"), value.alias("value"))
        out = rows if out is None else out.unionAll(rows)
    return out


_CONF = "CASE WHEN count(v) = 0 THEN 0.0 WHEN count(DISTINCT v) > 1 THEN 0.3 WHEN count(v) = count(*) THEN 1.0 ELSE 0.7 END"
CONFIDENCE_SQL = "conf AS (SELECT k AS doc_id, " + _CONF + "::DOUBLE AS score FROM (" + " UNION ALL ".join(
    f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % {n} = 0 THEN NULL WHEN o_orderkey % {n} = 1 THEN 1 ELSE 0 END AS v FROM orders" for n in _SYSTEMS.values()
) + ") GROUP BY k)"


@query("ensemble_confidence", f"WITH {CONFIDENCE_SQL} SELECT doc_id, 'totals.gross_amount' AS path, score FROM conf")
def ensemble_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.ensemble_confidence(_system_values(spark, sf_dir), GROSS)


CURVE_SQL = f"""{FIELDS_SQL}, {CONFIDENCE_SQL},
r AS (SELECT f.doc_id, coalesce(score, 0) AS s, (npred IS NOT DISTINCT FROM ntruth)::INT AS ok FROM f JOIN conf USING (doc_id) WHERE path = 'totals.gross_amount'),
t AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS threshold),
curve AS (SELECT threshold, count_if(s >= threshold) / count(*) AS coverage, CASE WHEN count_if(s >= threshold) = 0 THEN 1.0 ELSE sum(ok) FILTER (s >= threshold) / count_if(s >= threshold) END AS accuracy,
  count_if(s >= threshold) / count(*) AS document_rate FROM r, t GROUP BY threshold)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _fields(spark, sf_dir, GROSS)
    return ev.coverage_curve(fields, ev.ensemble_confidence(_system_values(spark, sf_dir), GROSS))


@query("coverage_curve", f"WITH {CURVE_SQL} SELECT threshold, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy, round(document_rate, 9) AS document_rate FROM curve")
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curve(spark, sf_dir).select("threshold", *(F.round(c, 9).alias(c) for c in ("coverage", "accuracy", "document_rate")))


@query("auto_processing_rate", f"WITH {CURVE_SQL} SELECT threshold, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy FROM curve WHERE coverage > 0 AND accuracy >= 0.6 ORDER BY coverage DESC, threshold LIMIT 1")
def auto_processing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = ev.auto_processing_rate(_curve(spark, sf_dir), 0.6)
    return point.select("threshold", F.round("coverage", 9).alias("coverage"), F.round("accuracy", 9).alias("accuracy"))


def _payables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of non-medical goods are not payable; a prediction loses the first line of every seventh order,
    and every eleventh order has no prediction."""
    item = F.struct("line_index", "amount", (F.col("category") != "non_medical").alias("is_payable"))
    lines = td.line_items(spark, sf_dir).select("doc_id", item.alias("item")).groupBy("doc_id").agg(F.collect_list("item").alias("items"))
    both = td.claims(spark, sf_dir).select("doc_id", "stated_net").join(lines, "doc_id", "left")
    items = F.coalesce("items", F.array().cast(lines.schema["items"].dataType))
    left = F.filter(items, lambda i: (F.col("doc_id") % 7 != 0) | (i["line_index"] != 0))
    document = lambda held: F.struct(held.alias("line_items"), F.struct(F.col("stated_net").alias("net_amount")).alias("totals"))
    sides = both.select("doc_id", document(items).alias("truth"), document(left).alias("pred"))
    cents = lambda c: (c * 100).cast("bigint")
    truth, pred = F.col("truth"), F.col("pred")
    return sides.select(
        "doc_id", cents(ev.net_payable(truth)).alias("true_payable"), F.when(F.col("doc_id") % 11 != 0, cents(ev.net_payable(pred))).alias("pred_payable"),
        cents(ev.deduction_total(truth)).alias("true_deducted"), cents(ev.deduction_total(pred)).alias("pred_deducted"),
    )


PAYABLE_SQL = f"""{td.ITEMS_SQL},
s AS (SELECT doc_id, sum(amt) FILTER (category <> 'non_medical') AS t, sum(amt) FILTER (category <> 'non_medical' AND NOT (doc_id % 7 = 0 AND line_index = 0)) AS p,
  coalesce(sum(amt) FILTER (category = 'non_medical'), 0) AS td, coalesce(sum(amt) FILTER (category = 'non_medical' AND NOT (doc_id % 7 = 0 AND line_index = 0)), 0) AS pd FROM items GROUP BY doc_id),
y AS (SELECT doc_id, coalesce(t, stated)::BIGINT AS true_payable, CASE WHEN doc_id % 11 <> 0 THEN coalesce(p, stated) END::BIGINT AS pred_payable, coalesce(td, 0)::BIGINT AS true_deducted, coalesce(pd, 0)::BIGINT AS pred_deducted
  FROM claims LEFT JOIN s USING (doc_id))"""


@query("net_payable_fallback", f"WITH {PAYABLE_SQL} SELECT * FROM y")
def net_payable_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payables(spark, sf_dir)


@query(
    "business_error",
    f"""WITH {PAYABLE_SQL}, e AS (SELECT *, abs(coalesce(pred_payable, 0) - true_payable) AS err FROM y)
    SELECT count(*) AS n, count(err) AS n_scored, quantile_cont(err, 0.5)::DOUBLE AS median_error, quantile_disc(err, 0.95)::BIGINT AS p95_error, round(avg(err), 4) AS mean_error,
    round(count_if(err > 10000) / count(err), 9) AS over_material, round(count_if(pred_deducted = true_deducted) / count(*), 9) AS deduction_exact FROM e""",
)
def business_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.score_business(_payables(spark, sf_dir))
    return out.select("n", "n_scored", "median_error", "p95_error", F.round("mean_error", 4).alias("mean_error"), F.round("over_material", 9).alias("over_material"), F.round("deduction_exact", 9).alias("deduction_exact"))


def _item_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of each order's lines, and of a prediction that drops every fifth and misspells every third."""
    lines = td.line_items(spark, sf_dir).select("doc_id", "line_index", "description")
    k = F.col("doc_id") + F.col("line_index")
    said = F.when(k % 5 != 0, F.when(k % 3 == 0, F.concat(F.substring("description", 2, 100), F.lit("s"))).otherwise(F.col("description")))
    ordered = lambda c: F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("line_index", c.alias("d")))), lambda x: x["d"]))
    return lines.groupBy("doc_id").agg(ordered(F.col("description")).alias("truth_items"), ordered(said).alias("pred_items"))


@query("line_item_match")
def line_item_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pairing of lines has no SQL."""
    return ev.matched_items(_item_sides(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query("line_item_scores")
def line_item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _item_sides(spark, sf_dir)
    counts = sides.agg(F.sum(F.size("truth_items")).alias("n_true"), F.sum(F.size("pred_items")).alias("n_pred"))
    return ev.line_item_scores(counts, ev.matched_items(sides).agg(F.count("*").alias("n_matched")))


@query("unmatched_truth_rows", f"WITH {td.ITEMS_SQL} SELECT doc_id, description, count(*) AS n FROM items WHERE (doc_id + line_index) % 5 = 0 GROUP BY ALL")
def unmatched_truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the matcher pairs with no prediction, of which every fifth is gone; of equal lines either may be paired, so they are counted."""
    lines = td.line_items(spark, sf_dir).select("doc_id", "line_index", "description")
    said = F.when((F.col("doc_id") + F.col("line_index")) % 5 != 0, F.col("description"))
    ordered = lambda c: F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("line_index", c.alias("d")))), lambda x: x["d"]))
    sides = lines.groupBy("doc_id").agg(ordered(F.col("description")).alias("truth_items"), ordered(said).alias("pred_items"))
    truth = sides.select("doc_id", F.posexplode("truth_items").alias("truth_index", "description"))
    return taxonomy.unmatched_rows(truth, ev.matched_items(sides)).groupBy("doc_id", "description").agg(F.count("*").alias("n"))


# Assembly


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages by line number; every eighth order reprints the last row of a page at the head of the next."""
    lines = td.line_items(spark, sf_dir).select("doc_id", "page_index", "line_index", "description", F.col("amount").cast("string").alias("amount"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("line_index", "description", "amount"))), lambda x: F.struct(x["description"].alias("description"), x["amount"].alias("amount"), x["line_index"].alias("line_index")))
    pages = lines.groupBy("doc_id", "page_index").agg(rows.alias("rows"))
    from pyspark.sql import Window

    before = F.lag("rows").over(Window.partitionBy("doc_id").orderBy("page_index"))
    again = F.when((F.col("doc_id") % 8 == 0) & before.isNotNull(), F.slice(before, -1, 1))
    return pages.withColumn("rows", F.concat(F.coalesce(again, F.array().cast(pages.schema["rows"].dataType)), "rows"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = RAW_SCHEMA["line_items"].dataType
    none = F.lit(None).cast("string")
    item = lambda r: F.struct(*((r[n] if n in ("description", "amount") else r["line_index"].cast("string") if n == "serial_no" else none).alias(n) for n in kind.elementType.fieldNames()))
    pages = _pages(spark, sf_dir).withColumn("line_items", F.transform("rows", item)).drop("rows")
    first = F.col("page_index") == 1
    block = lambda name, given: F.struct(*(given.get(n, none).alias(n) for n in RAW_SCHEMA[name].dataType.fieldNames()))
    patient = F.when(first | (F.col("page_index") == 2), block("patient", {"name": F.concat(F.lit("Patient "), (F.col("doc_id") + F.when(first | (F.col("doc_id") % 9 != 0), 0).otherwise(1)).cast("string"))}))
    stated = td.claims(spark, sf_dir).select("doc_id", F.col("stated_net").cast("string").alias("stated"))
    pages = pages.join(stated, "doc_id")
    totals = F.when(F.col("page_index") == 7, block("totals", {"gross_amount": F.col("stated"), "net_amount": F.col("stated"), "discount": F.when(F.col("doc_id") % 2 == 0, "10.00")}))
    empty = lambda name: F.lit(None).cast(RAW_SCHEMA[name].dataType)
    return pages.select("doc_id", "page_index", empty("hospital").alias("hospital"), patient.alias("patient"), empty("insurance").alias("insurance"), totals.alias("totals"), "line_items")


# Pages as printed, then folded in order: the longest overlap of the last rows so far with the first of the next page, three at most, goes.
ASSEMBLY_SQL = f"""{td.ITEMS_SQL}, own AS (SELECT doc_id, page_index, list({{'d': description, 'a': amt}} ORDER BY line_index) AS rows FROM items GROUP BY ALL),
pg AS (
  SELECT doc_id, page_index, CASE WHEN doc_id % 8 = 0 AND before IS NOT NULL THEN before[-1:] || rows ELSE rows END AS rows
  FROM (SELECT *, lag(rows) OVER (PARTITION BY doc_id ORDER BY page_index) AS before FROM own)),
folded AS (
  SELECT doc_id, count(*) AS n_pages, sum(len(rows)) AS n_rows_raw, bool_or(page_index = 7) AS has, list_reduce(list(rows ORDER BY page_index), lambda m, n: m || n[1 + CASE
    WHEN len(m) >= 3 AND len(n) >= 3 AND m[-3:] = n[1:3] THEN 3 WHEN len(m) >= 2 AND len(n) >= 2 AND m[-2:] = n[1:2] THEN 2 WHEN m[-1:] = n[1:1] THEN 1 ELSE 0 END:]) AS merged
  FROM pg GROUP BY doc_id)"""


@query(
    "page_assembly",
    f"WITH {ASSEMBLY_SQL} SELECT doc_id, n_pages::INT AS n_pages, len(merged)::INT AS n_rows, n_rows_raw::INT AS n_rows_raw FROM folded",
)
def page_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order; of those whose own lines repeat over a page break, the fold drops the overlap."""
    docs = asm.assemble(_fragments(spark, sf_dir))
    return docs.select("doc_id", "n_pages", "n_rows", "n_rows_raw")


@query(
    "header_conflicts",
    f"""WITH {ASSEMBLY_SQL} SELECT doc_id, count_if(page_index IN (1, 2)) = 0 AS no_patient, count_if(page_index = 7) = 0 AS no_totals,
    doc_id % 9 = 0 AND count_if(page_index = 1) > 0 AND count_if(page_index = 2) > 0 AS conflict FROM pg GROUP BY doc_id""",
)
def header_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = asm.assemble(_fragments(spark, sf_dir))
    return docs.select("doc_id", F.array_contains("missing_blocks", "patient").alias("no_patient"), F.array_contains("missing_blocks", "totals").alias("no_totals"), F.array_contains("conflicts", "patient.name").alias("conflict"))


@query(
    "reconcile_totals",
    f"""WITH {ASSEMBLY_SQL}, s AS (SELECT doc_id, list_sum(list_transform(merged, lambda r: r.a)) AS total, stated, has FROM folded JOIN claims USING (doc_id))
    SELECT doc_id, CASE WHEN has THEN (total - stated)::BIGINT END AS gross_delta, CASE WHEN has THEN CASE WHEN doc_id % 2 = 0 THEN 1000 ELSE 0 END END::BIGINT AS net_delta,
    NOT has OR (abs(total - stated) <= 100 AND doc_id % 2 = 1) AS balanced FROM s""",
)
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = asm.reconcile(asm.assemble(_fragments(spark, sf_dir)))
    cents = lambda c: (F.col(c) * 100).cast("bigint").alias(c)
    return docs.select("doc_id", cents("gross_delta"), cents("net_delta"), "balanced")


@query(
    "category_subtotals",
    f"""WITH {td.ITEMS_SQL} SELECT doc_id, category, line_index::INT AS line_index, sum(amt)::BIGINT AS hundredths, count(*) AS n, grouping(line_index)::INT AS is_subtotal FROM items
    GROUP BY GROUPING SETS ((doc_id, category, line_index), (doc_id, category))""",
)
def category_subtotals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asm.subtotals(td.line_items(spark, sf_dir))
    return rows.select("doc_id", "category", "line_index", (F.col("amount") * 100).cast("bigint").alias("hundredths"), "n", F.col("is_subtotal").cast("int").alias("is_subtotal"))
