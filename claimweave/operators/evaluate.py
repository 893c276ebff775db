"""Scores of extracted documents against the truth.

Field scores are aggregates over rows of fields. What needs a pairing of line items or an edit
distance of trees is one Arrow function over whole documents; all that follows from it is
aggregated by Spark. Medians and percentiles are exact: ranks are found by narrowing
histograms (``ranks``), so no task sorts all values.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import best_row_pairs, tree, tree_accuracy
from ..schema import FIELD_PATHS, LINE_ITEM_FIELDS, RAW_SCHEMA, long_fields
from ..shared import kept
from .documents import normalize_document, normalize_field, normalize_item_field, normalized, raw_items
from .ranks import group_medians

MATCH_FLOOR = 0.60
MATERIAL = "100"
THRESHOLDS = tuple(i / 20 for i in range(21))


def cer(predicted: Column, truth: Column) -> Column:
    """Edits for each true character, at most one."""
    p, t = F.coalesce(predicted, F.lit("")), F.coalesce(truth, F.lit(""))
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(p, t) / F.char_length(t)))


def pairs_of(predictions: DataFrame, truths: DataFrame, document: str = "document") -> DataFrame:
    """(doc_id, pred, truth, meta): every true document of ``truths`` (doc_id, truth, meta) with its prediction of ``predictions``
    (doc_id, document); without one, an empty document. Predictions of no true document are left out."""
    blank = F.from_json(F.lit("{}"), RAW_SCHEMA)
    said = predictions.select("doc_id", F.col(document).alias("pred"))
    return truths.select("doc_id", "truth", "meta").join(said, "doc_id", "left").select("doc_id", F.coalesce("pred", blank).alias("pred"), "truth", "meta")


def score_fields(fields: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """For each path: exact, normalized_exact, formatting_gap, cer, truth_present, pred_present, misses,
    hallucinations, correct_when_present, accuracy_when_present."""
    exact = F.coalesce("pred", F.lit("")) == F.coalesce("truth", F.lit(""))
    same = F.col("npred").eqNullSafe(F.col("ntruth"))
    t, p = F.col("ntruth").isNotNull(), F.col("npred").isNotNull()
    out = fields.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(exact).alias("n_exact"), F.count_if(same).alias("n_normalized"), F.avg(cer(F.col("pred"), F.col("truth"))).alias("cer"),
        F.count_if(t).alias("truth_present"), F.count_if(p).alias("pred_present"), F.count_if(t & ~p).alias("misses"), F.count_if(~t & p).alias("hallucinations"), F.count_if(t & same).alias("correct_when_present"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return (
        out.withColumn("exact", share("n_exact", "n")).withColumn("normalized_exact", share("n_normalized", "n"))
        .withColumn("formatting_gap", F.col("normalized_exact") - F.col("exact")).withColumn("accuracy_when_present", share("correct_when_present", "truth_present"))
    )


def matched_items(pairs: DataFrame, floor: float = MATCH_FLOOR, predicted: str = "pred_items", truth: str = "truth_items") -> DataFrame:
    """(doc_id, pred_index, truth_index, similarity): the best one-to-one pairing of descriptions in each document.

    ``pairs`` has doc_id and two arrays of descriptions, normalised; null counts as empty.
    """
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, p, t in zip(frame["doc_id"], frame[predicted], frame[truth], strict=True):
                left, right = [x or "" for x in (() if p is None else p)], [x or "" for x in (() if t is None else t)]
                rows += [(doc, i, j, s) for i, j, s in best_row_pairs(left, right, floor)]
            yield pd.DataFrame(rows, columns=["doc_id", "pred_index", "truth_index", "similarity"])

    return pairs.select("doc_id", predicted, truth).mapInPandas(match, f"doc_id {kind}, pred_index int, truth_index int, similarity double")


def typed_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (doc_id, pred, truth) with their typed documents, p and t; pairs that have these stay as they are."""
    if {"p", "t"} <= set(pairs.columns):
        return pairs
    return pairs.withColumns({"p": normalize_document(F.col("pred")), "t": normalize_document(F.col("truth"))})


def item_descriptions(pairs: DataFrame) -> DataFrame:
    """doc_id and both sides' typed items and normalised descriptions, from pairs of raw documents."""
    typed = typed_pairs(pairs).select("doc_id", F.col("p.line_items").alias("p"), F.col("t.line_items").alias("t"))
    names = lambda c: F.transform(c, lambda i: i["description"])
    return typed.select("doc_id", "p", "t", names("p").alias("pred_items"), names("t").alias("truth_items"))


def score_line_items(pairs: DataFrame, floor: float = MATCH_FLOOR) -> DataFrame:
    """One row: n_true, n_pred, n_matched, precision, recall, f1, insertions, deletions."""
    sides = item_descriptions(pairs)
    counts = sides.agg(F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("n_true"), F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("n_pred"))
    return line_item_scores(counts, matched_items(sides, floor).agg(F.count("*").alias("n_matched")))


def line_item_scores(counts: DataFrame, matched: DataFrame) -> DataFrame:
    one = counts.crossJoin(matched)  # two single rows
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = one.withColumn("precision", ratio("n_matched", "n_pred")).withColumn("recall", ratio("n_matched", "n_true"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1).withColumn("insertions", F.col("n_pred") - F.col("n_matched")).withColumn("deletions", F.col("n_true") - F.col("n_matched"))


def attribute_scores(pairs: DataFrame, floor: float = MATCH_FLOOR) -> DataFrame:
    """(attribute, support, hits, accuracy) over matched rows whose truth has the attribute."""
    sides = item_descriptions(pairs)
    both = matched_items(sides, floor).join(sides.select("doc_id", "p", "t"), "doc_id")
    p, t = F.element_at("p", F.col("pred_index") + 1), F.element_at("t", F.col("truth_index") + 1)
    rows = F.array(*(F.struct(F.lit(a).alias("attribute"), p[a].cast("string").alias("pv"), t[a].cast("string").alias("tv")) for a in LINE_ITEM_FIELDS))
    found = both.select(F.inline(rows)).where("tv is not null").groupBy("attribute")
    out = found.agg(F.count("*").alias("support"), F.count_if(F.col("pv").eqNullSafe(F.col("tv"))).alias("hits"))
    return out.withColumn("accuracy", F.col("hits") / F.col("support"))


def document_scores(pairs: DataFrame) -> DataFrame:
    """(doc_id, strict, ted, ted_raw): equality of the typed documents, tree accuracy of typed and raw ones.

    Equal documents have equal trees and are not written out; what is printed alike reads alike."""

    @F.arrow_udf("double")
    def accuracy(p: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([1.0 if a == b else tree_accuracy(tree(json.loads(a)), tree(json.loads(b))) for a, b in zip(p.to_pylist(), t.to_pylist(), strict=True)], pa.float64())

    typed = pairs.withColumn("alike", F.col("pred").eqNullSafe(F.col("truth")))
    if not {"p", "t"} <= set(pairs.columns):
        typed = typed.withColumns({"p": F.when(~F.col("alike"), normalize_document(F.col("pred"))), "t": F.when(~F.col("alike"), normalize_document(F.col("truth")))})
    written = lambda side: F.when(~F.col("alike"), F.to_json(side))
    strict = F.when(F.col("alike"), True).otherwise(F.col("p").eqNullSafe(F.col("t")))
    sides = typed.select("doc_id", strict.alias("strict"), *(written(c).alias(f"_{c}") for c in ("p", "t", "pred", "truth")))
    return sides.select("doc_id", "strict", accuracy(F.col("_p"), F.col("_t")).alias("ted"), accuracy(F.col("_pred"), F.col("_truth")).alias("ted_raw"))


def score_documents(scores: DataFrame) -> DataFrame:
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c)
    return scores.agg(F.count("*").alias("n"), mean("strict"), mean("ted"), mean("ted_raw"))


def net_payable(document: Column) -> Column:
    """What the lines that are payable come to, or the stated net where no line has such an amount."""
    return _payable(document["line_items"], document["totals"]["net_amount"])


def _payable(items: Column, net: Column) -> Column:
    """The sum in one pass; it stays null where no line counts."""
    wide = "decimal(28,2)"
    fits = lambda i: i["amount"].isNotNull() & F.coalesce(i["is_payable"], F.lit(True))
    total = F.aggregate(items, F.lit(None).cast(wide), lambda s, i: F.when(fits(i), (F.coalesce(s, F.lit(0).cast(wide)) + i["amount"]).cast(wide)).otherwise(s))
    return F.coalesce(total, net.cast(wide))


def deduction_total(document: Column) -> Column:
    zero = F.lit(0).cast("decimal(28,2)")
    out = F.filter(document["line_items"], lambda i: i["amount"].isNotNull() & (~i["is_payable"]))
    return F.aggregate(out, zero, lambda s, i: (s + i["amount"]).cast("decimal(28,2)"))


def cents(amount: Column) -> Column:
    return F.round(amount * 100, 0).cast("bigint")


def business_errors(pairs: DataFrame) -> DataFrame:
    """(doc_id, true_payable, pred_payable, pred_deducted, true_deducted) of pairs of raw documents, in hundredths."""
    return typed_pairs(pairs).select(
        "doc_id", cents(net_payable(F.col("t"))).alias("true_payable"), cents(net_payable(F.col("p"))).alias("pred_payable"),
        cents(deduction_total(F.col("p"))).alias("pred_deducted"), cents(deduction_total(F.col("t"))).alias("true_deducted"),
    )


def _gap() -> Column:
    return F.when(F.col("true_payable").isNotNull(), F.abs(F.coalesce("pred_payable", F.lit(0)) - F.col("true_payable")))


def score_business(errors: DataFrame, material: str = MATERIAL) -> DataFrame:
    """One row over (true_payable, pred_payable, pred_deducted, true_deducted), in hundredths: n, n_scored, median, p95 and
    mean error, shares over the material error and of exact deductions, and the error of 1,000 claims."""
    # Ranks take several rounds over five numbers a document, which are written for them.
    rows = kept(errors.select("true_payable", "pred_payable", "pred_deducted", "true_deducted", _gap().alias("error")), "errors")
    middle = group_medians(rows, (), "error").select(F.col("median").alias("median_error"), F.col("percentile").alias("p95_error"))
    scored = F.col("error").isNotNull()
    share = lambda test: F.coalesce(F.try_divide(F.count_if(scored & test).cast("double"), F.count_if(scored).cast("double")), F.lit(0.0))
    mean = F.coalesce(F.avg("error"), F.lit(0.0))
    whole = rows.agg(
        F.count("*").alias("n"), F.count_if(scored).alias("n_scored"), mean.alias("mean_error"),
        share(F.col("error") > int(material) * 100).alias("over_material"), share(F.col("pred_deducted") == F.col("true_deducted")).alias("deduction_exact"), (mean * 1000).alias("per_1000_claims"),
    )
    out = whole.join(F.broadcast(middle), F.lit(True), "left")  # two single rows
    return out.select("n", "n_scored", F.coalesce("median_error", F.lit(0.0)).alias("median_error"), F.coalesce("p95_error", F.lit(0)).alias("p95_error"), "mean_error", "over_material", "deduction_exact", "per_1000_claims")


#: Keys of slices that come before others.
PREFERRED = ("source", "template", "pages", "scan_quality", "language")


def _lists(arrays: pa.Array) -> Iterator[list[str]]:
    """Lists of strings, null as empty, from one list of all of them."""
    every = [x or "" for x in arrays.flatten().to_numpy(zero_copy_only=False)]
    at = 0
    for size in arrays.value_lengths().fill_null(0).to_numpy():
        yield every[at : at + size]
        at += size


def document_measures(pairs: DataFrame, paths: tuple[str, ...] = FIELD_PATHS, trees: bool = True) -> DataFrame:
    """One row of numbers a document of (doc_id, pred, truth, meta): the shares of fields that are exact as printed and when normalised,
    line items (n_true, n_pred, n_matched), the error in hundredths, and with ``trees`` strict and ted; meta stays."""
    read = trees or {"p", "t"} <= set(pairs.columns)
    if read:  # documents are normalised once, for fields, line items, money and trees
        typed = pairs if {"p", "t"} <= set(pairs.columns) else kept(typed_pairs(pairs.select("doc_id", "meta", "pred", "truth")), "typed")
    else:  # of line items only what is measured is normalised, each part where it is used
        typed = pairs.select("doc_id", "meta", "pred", "truth")
    raw = {"p": F.col("pred"), "t": F.col("truth")}
    of = lambda side, path: F.col(side)[path.split(".")[0]][path.split(".")[1]]
    field = of if read else lambda side, path: normalize_field(path, raw[side])
    share = lambda tests: sum((t.cast("int") for t in tests), F.lit(0)) / F.lit(float(len(paths)))
    exact = share(F.coalesce(of("pred", p), F.lit("")) == F.coalesce(of("truth", p), F.lit("")) for p in paths)
    # What is printed alike reads alike.
    same = share(F.when(of("pred", p).eqNullSafe(of("truth", p)), True).otherwise(field("p", p).eqNullSafe(field("t", p))) for p in paths)
    item = lambda i: F.struct(*((i[n] if read else normalize_item_field(n, i)).alias(n) for n in ("description", "amount", "is_payable")))
    items = lambda side: F.transform(F.col(side)["line_items"] if read else raw_items(raw[side]), item).alias(f"{side}_items")
    net = lambda side: cents(_payable(F.col(f"{side}_items"), F.col(f"{side}_net")))

    @F.arrow_udf("bigint")
    def matched(p: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([len(best_row_pairs(a, b, MATCH_FLOOR)) for a, b in zip(_lists(p), _lists(t), strict=True)], pa.int64())

    # Arrays in columns of their own are made once, however often they are used.
    sides = typed.select("doc_id", "meta", exact.alias("exact"), same.alias("normalized"), *(c for s in "pt" for c in (items(s), field(s, "totals.net_amount").alias(f"{s}_net"))))
    counted = sides.select(
        "doc_id", "meta", "exact", "normalized", F.size("t_items").alias("n_true"), F.size("p_items").alias("n_pred"),
        matched(F.col("p_items.description"), F.col("t_items.description")).alias("n_matched"), net("t").alias("true_payable"), net("p").alias("pred_payable"),
    )
    out = counted.select("doc_id", "meta", "exact", "normalized", "n_true", "n_pred", "n_matched", _gap().alias("error"))
    return out.join(document_scores(typed).select("doc_id", "strict", "ted"), "doc_id") if trees else out


def slice_summaries(measures: DataFrame, smallest: int = 5) -> DataFrame:
    """A row for each (key, value) of ``meta`` over ``document_measures``: n, macro averages of fields, the F1 of line items,
    means of strict and ted where they are measured, the median error, whether few documents stand behind it, and the place of the key."""
    rows = kept(measures.select("*", F.explode("meta").alias("key", "value")).drop("meta", "doc_id"), "slices")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    extra = [F.avg(F.col(c).cast("double")).alias(c) for c in ("strict", "ted") if c in measures.columns]
    n_true, n_pred, n_matched = (F.sum(c) for c in ("n_true", "n_pred", "n_matched"))
    out = rows.groupBy("key", "value").agg(F.count("*").alias("n"), F.avg("exact").alias("exact_macro"), F.avg("normalized").alias("normalized_macro"), ratio(2 * n_matched, n_true + n_pred).alias("line_f1"), *extra)
    medians = group_medians(rows, ("key", "value"), "error").select("key", "value", F.col("median").alias("median_error"))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PREFERRED)), F.col("key")), F.lit(0)), F.lit(len(PREFERRED) + 1))
    return out.join(medians, ["key", "value"]).withColumn("underpowered", F.col("n") < smallest).withColumn("place", order.cast("int"))


def ensemble_confidence(values: DataFrame, paths: tuple[str, ...] = FIELD_PATHS) -> DataFrame:
    """(doc_id, path, score) from (system, doc_id, path, value): 1 if all agree, 0.7 if some abstain, 0.3 if they
    differ, 0 without a value. Values agree if their normalised forms do; one that can't be read abstains."""
    said = values.withColumn("value", normalized(F.col("path"), F.col("value"), paths))
    kinds, present = F.count_distinct("value"), F.count("value")
    score = F.when(present == 0, 0.0).when(kinds > 1, 0.3).when(present == F.count("*"), 1.0).otherwise(0.7)
    return said.groupBy("doc_id", "path").agg(score.alias("score"))


def system_values(predictions: dict[str, DataFrame], document: str = "document") -> DataFrame:
    """(system, doc_id, path, value) of what each system read, for ``ensemble_confidence``."""
    out = None
    for name, df in predictions.items():
        rows = long_fields(df.select("doc_id", F.col(document).alias("d")), "d", "doc_id").select(F.lit(name).alias("system"), "doc_id", "path", "value")
        out = rows if out is None else out.unionAll(rows)
    return out


def by_system(scores: DataFrame, row: str, measures: tuple[str, ...], systems: list[str]) -> DataFrame:
    """A row for each ``row`` with every system's own measures side by side, as <system>_<measure>; null where a system has none.

    ``scores`` is (system, row, measures), one row each."""
    return scores.groupBy(row).pivot("system", systems).agg(*(F.first(m, ignorenulls=True).alias(m) for m in measures))


def coverage_curve(fields: DataFrame, confidences: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, coverage, accuracy, document_rate) over (doc_id, path, npred, ntruth); a field without a confidence
    has confidence 0, so only the threshold 0 answers it. A field is counted once, at the highest threshold it clears, and sums run downwards."""
    from pyspark.sql import Window

    steps = F.array(*(F.lit(t) for t in thresholds))
    cleared = F.size(F.filter(steps, lambda t: t <= F.coalesce("score", F.lit(0.0))))
    rows = fields.join(confidences, ["doc_id", "path"], "left").select("doc_id", cleared.alias("step"), F.col("npred").eqNullSafe(F.col("ntruth")).cast("long").alias("right"))
    per_doc = rows.groupBy("doc_id", "step").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    at = per_doc.groupBy("step").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    docs = per_doc.groupBy("doc_id").agg(F.min("step").alias("step")).groupBy("step").agg(F.count("*").alias("docs"))
    every = fields.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(thresholds)] + [(0, None)], "step int, threshold double")
    small = every.join(at, "step", "left").join(docs, "step", "left").fillna(0, ["n", "right", "docs"])
    down = Window.orderBy(F.desc("step"))  # one row a threshold
    whole = Window.partitionBy()
    sums = small.select("threshold", *(F.sum(c).over(down).alias(c) for c in ("n", "right", "docs")), *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "docs")))
    share = lambda a, b, other: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(other))
    return sums.where("threshold is not null").select("threshold", share("n", "all_n", 0.0).alias("coverage"), share("right", "n", 1.0).alias("accuracy"), share("docs", "all_docs", 0.0).alias("document_rate"))


def auto_processing_rate(curve: DataFrame, target: float = 0.95) -> DataFrame:
    """The point of most coverage that reaches the target, the lower threshold on a tie; no row if none does."""
    return curve.where((F.col("coverage") > 0) & (F.col("accuracy") >= target)).orderBy(F.desc("coverage"), "threshold").limit(1)


def deployment_sentence(point: dict | None, target: float = 0.95) -> str:
    if point is None:
        return f"No abstention threshold reaches {target:.0%} field accuracy; every document requires human review."
    return (
        f"At a confidence threshold of {point['threshold']:.2f}, giving {point['accuracy']:.1%} field accuracy, the system answers {point['coverage']:.1%} of fields "
        f"and fully auto-processes {point['document_rate']:.1%} of documents, routing the rest to human review."
    )


def slices(rows: DataFrame, meta: str, measures: list[Column], smallest: int = 5) -> DataFrame:
    """The measures for each (key, value) of a map column, and whether fewer than ``smallest`` rows stand behind them.

    One pass: what would be a grouping set for each key is one group of exploded pairs.
    """
    out = rows.select("*", F.explode(meta).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"), *measures)
    return out.withColumn("underpowered", F.col("n") < smallest)
