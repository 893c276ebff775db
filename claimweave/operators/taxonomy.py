"""Errors by kind: an ordered list of tests over each field that differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import normalize_date
from ..functions.money import normalize_amount
from ..functions.text import let

#: Kinds of error and digits that look alike.
KINDS = ("formatting_only", "missed_field", "hallucinated_field", "wrong_field", "date_unparsed", "magnitude_error", "digit_confusion", "value_confusion")
LINE_PATH = "line_items[]"
LOOK_ALIKE = ("56", "65", "17", "71", "08", "80", "38", "83", "94", "49")


def digit_confusion(truth: Column, predicted: Column) -> Column:
    """Same length, one or two edits, and all places that differ hold digits."""
    apart = F.filter(F.zip_with(F.split(truth, ""), F.split(predicted, ""), lambda a, b: F.when(a != b, F.concat(a, b))), lambda p: p.isNotNull())
    digits = F.forall(apart, lambda p: F.regexp_like(p, F.lit(r"^\d\d$")) | p.isin(*LOOK_ALIKE))
    return (F.char_length(truth) == F.char_length(predicted)) & (F.levenshtein(truth, predicted) <= 2) & (F.size(apart) > 0) & digits


def _magnitude(truth: Column, predicted: Column) -> Column:
    ratio = F.abs(F.try_divide(predicted.cast("double"), truth.cast("double")))
    return F.coalesce((truth != 0) & ((ratio >= 9) | (ratio <= 0.12)), F.lit(False))


def classify(path: Column, truth: Column, predicted: Column, ntruth: Column, npred: Column, elsewhere: Column) -> Column:
    """The kind of error of one field, null if there is none; ``elsewhere``: another field's truth is the prediction."""
    large = let(normalize_amount(truth), lambda t: let(normalize_amount(predicted), lambda p: _magnitude(t, p)))
    return (
        F.when(truth.eqNullSafe(predicted), None).when(ntruth.eqNullSafe(npred), "formatting_only")
        .when(predicted.isNull(), "missed_field").when(truth.isNull(), "hallucinated_field").when(elsewhere, "wrong_field")
        .when(F.contains(path, F.lit("date")) & normalize_date(predicted).isNull(), "date_unparsed")
        .when(large, "magnitude_error").when(digit_confusion(truth, predicted), "digit_confusion").otherwise("value_confusion")
    )


def error_cases(fields: DataFrame) -> DataFrame:
    """(doc_id, path, truth, pred, kind) of the rows of fields that are errors.

    A document's true values meet once, in the window of its own fields.
    """
    values = F.collect_list(F.when(F.col("truth") != "", F.struct("path", F.col("truth").alias("value")))).over(Window.partitionBy("doc_id"))
    elsewhere = F.exists("_values", lambda v: (v["path"] != F.col("path")) & (v["value"] == F.col("pred")))
    kind = classify(F.col("path"), F.col("truth"), F.col("pred"), F.col("ntruth"), F.col("npred"), elsewhere)
    return fields.withColumn("_values", values).withColumn("kind", kind).where("kind is not null").drop("_values")


def unmatched_rows(truth_items: DataFrame, matches: DataFrame) -> DataFrame:
    """True line items no prediction was paired with: truth_items is (doc_id, truth_index, ...)."""
    return truth_items.join(matches, ["doc_id", "truth_index"], "left_anti")


def missed_rows(truth_items: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, path, truth, pred, kind) of the true line items of (doc_id, truth_index, description) that no prediction was paired with."""
    gone = unmatched_rows(truth_items, matches.select("doc_id", "truth_index"))
    return gone.select("doc_id", F.lit(LINE_PATH).alias("path"), F.col("description").alias("truth"), F.lit(None).cast("string").alias("pred"), F.lit("missed_field").alias("kind"))


def all_cases(fields: DataFrame, truth_items: DataFrame, matches: DataFrame) -> DataFrame:
    """Errors of fields and line items that were never produced, in one frame."""
    return error_cases(fields).select("doc_id", "path", "truth", "pred", "kind").unionByName(missed_rows(truth_items, matches))


def summarise(cases: DataFrame, meta: str | None = None, most_values: int = 30) -> DataFrame:
    """(dimension, value, n): by kind, by path, and by each key of a map column that has 2 to ``most_values`` values
    and isn't a document's own name."""
    pairs = F.array(F.struct(F.lit("kind").alias("dimension"), F.col("kind").alias("value")), F.struct(F.lit("path").alias("dimension"), F.col("path").alias("value")))
    if meta is None:
        return cases.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    own = F.transform(F.map_entries(meta), lambda e: F.struct(e["key"].alias("dimension"), e["value"].alias("value")))
    counts = cases.select(F.inline(F.concat(pairs, own))).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    several = F.count("*").over(Window.partitionBy("dimension"))
    keep = F.col("dimension").isin("kind", "path") | (F.col("_several").between(2, most_values) & ~F.col("dimension").isin("doc_id", "page_id"))
    return counts.withColumn("_several", several).where(keep).drop("_several")
