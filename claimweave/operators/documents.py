"""Whole documents: raw to typed, and pairs of predicted and true documents as rows of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, gstin, labels, money, text
from ..schema import BLOCKS, FIELD_PATHS, LINE_ITEM_FIELDS, RAW_SCHEMA, TYPED_SCHEMA

#: One normaliser for each field, for the pipeline and for evaluation alike.
NORMALIZERS = {
    "hospital.address": text.normalize_text, "hospital.gstin": gstin.normalize_gstin,
    "patient.name": text.normalize_name, "patient.age": labels.normalize_age, "patient.sex": labels.normalize_sex,
    "patient.ward_type": labels.normalize_ward_type, "patient.admission_date": dates.normalize_date, "patient.discharge_date": dates.normalize_date,
    "totals.amount_in_words": text.normalize_text,
} | dict.fromkeys(("hospital.name", "hospital.city", "hospital.state", "hospital.hospital_type", "insurance.insurer_name", "insurance.tpa_name"), text.normalize_org_name) \
  | dict.fromkeys(("patient.uhid", "patient.ip_number", "insurance.policy_number", "insurance.claim_number", "insurance.employee_id"), text.normalize_identifier) \
  | dict.fromkeys((p for p in FIELD_PATHS if p.startswith("totals.") and p != "totals.amount_in_words"), money.normalize_amount)
LINE_ITEM_NORMALIZERS = {
    "serial_no": text.normalize_identifier, "description": text.normalize_text, "service_date": dates.normalize_date,
    "category": labels.normalize_category, "quantity": money.normalize_quantity, "unit_rate": money.normalize_amount,
    "amount": money.normalize_amount, "hsn_code": text.normalize_identifier, "is_payable": labels.normalize_bool, "deduction_reason": text.normalize_text,
}


def _unless_null(normalizer, value: Column) -> Column:
    """Most fields of a bill are null, and stay so without going through the tests of their normaliser."""
    return F.when(value.isNotNull(), normalizer(value))


def normalize_field(path: str, raw: Column) -> Column:
    """One typed field of a raw document."""
    block, name = path.split(".")
    return _unless_null(NORMALIZERS[path], raw[block][name]).cast(TYPED_SCHEMA[block].dataType[name].dataType)


def normalize_item_field(name: str, item: Column) -> Column:
    return _unless_null(LINE_ITEM_NORMALIZERS[name], item[name]).cast(TYPED_SCHEMA["line_items"].dataType.elementType[name].dataType)


def normalize_item(item: Column) -> Column:
    return F.struct(*(normalize_item_field(n, item).alias(n) for n in LINE_ITEM_FIELDS))


def raw_items(raw: Column) -> Column:
    return F.coalesce(raw["line_items"], F.array().cast(RAW_SCHEMA["line_items"].dataType))


def normalize_document(raw: Column) -> Column:
    """The typed document of a raw one; a leaf that can't be read is null."""
    blocks = {b: F.struct(*(normalize_field(f"{b}.{n}", raw).alias(n) for n in TYPED_SCHEMA[b].dataType.fieldNames())) for b in BLOCKS}
    items = F.transform(raw_items(raw), normalize_item)
    return F.struct(*((items if n == "line_items" else blocks[n]).alias(n) for n in TYPED_SCHEMA.fieldNames()))


def normalized(path: Column, value: Column, paths: tuple[str, ...] = FIELD_PATHS) -> Column:
    """A value in the form that its path's normaliser gives it, as text; null for other paths than ``paths``."""
    return F.coalesce(*(F.when(path == p, NORMALIZERS[p](value).cast("string")) for p in paths))


def field_array(paths: tuple[str, ...] = FIELD_PATHS) -> Column:
    """array of (path, pred, truth, npred, ntruth), as text, of the columns pred and truth of a pair of raw documents."""

    def row(path: str) -> Column:
        block, name = path.split(".")
        of = lambda side: F.col(side)[block][name]
        typed = lambda side: _unless_null(NORMALIZERS[path], of(side)).cast("string")
        return F.struct(F.lit(path).alias("path"), of("pred").alias("pred"), of("truth").alias("truth"), typed("pred").alias("npred"), typed("truth").alias("ntruth"))

    return F.array(*map(row, paths))


def field_pairs(pairs: DataFrame, paths: tuple[str, ...] = FIELD_PATHS) -> DataFrame:
    """(doc_id, path, pred, truth, npred, ntruth) for pairs (doc_id, pred, truth) of raw documents; only ``paths`` are read and normalised."""
    return pairs.select("doc_id", F.inline(field_array(paths)))
