"""Closed vocabularies: age, sex, ward, category, payability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORIES
from .text import let, prepare

#: Wards and ordered patterns of wards and categories; the first that fits wins.
WARDS = ("general", "semi_private", "private", "deluxe", "suite", "icu", "iccu", "nicu", "picu", "hdu", "day_care", "emergency", "other")
WARD_PATTERNS = (
    (r"semi[\s_-]*(private|pvt|special)|twin[\s_-]*shar", "semi_private"),
    (r"\bnicu\b|neonatal", "nicu"),
    (r"\bpicu\b|p(a)?ediatric intensive", "picu"),
    (r"\biccu\b|coronary", "iccu"),
    (r"\bicu\b|intensive care|critical care", "icu"),
    (r"\bhdu\b|high dependen", "hdu"),
    (r"day[\s_-]*care|\bdaycare\b", "day_care"),
    (r"emergenc|casualty|\ber\b", "emergency"),
    (r"deluxe|delux", "deluxe"),
    (r"suite", "suite"),
    (r"private|\bpvt\b|single[\s_-]*room|\bsingle\b", "private"),
    (r"general|\bgen\b|\bward\b|shar(ed|ing)|economy", "general"),
)
CATEGORY_PATTERNS = (
    (r"room|bed\s*charge|accommodation|rent", "room_rent"),
    (r"nurs", "nursing"),
    (r"pharm|medicine|drug|injection|tablet", "pharmacy"),
    (r"consumable|disposable|glove|syringe|cotton", "consumables"),
    (r"radiolog|x[\s-]*ray|\bct\b|\bmri\b|ultraso|sonograph|scan", "radiology"),
    (r"diagnost|lab\b|patholog|test|investigation|biochem", "diagnostics"),
    (r"surg|operat|\bot\b|procedure|anaesth|anesth", "surgery"),
    (r"consult|doctor|physician|professional|visit\s*charge", "professional_fees"),
    (r"equipment|ventilat|monitor|oxygen|pump", "equipment"),
    (r"admin|registration|admission\s*(fee|charge)|record|file\s*charge", "administrative"),
    (r"non[\s_-]*medical|toiletr|attendant|food|telephone|tv\b", "non_medical"),
)
#: Words for yes and no.
YES = ("y", "yes", "true", "1", "payable", "admissible", "allowed")
NO = ("n", "no", "false", "0", "nonpayable", "non_payable", "notpayable", "deducted", "disallowed", "inadmissible")


def first_pattern(text: Column, patterns, otherwise: Column) -> Column:
    """The name of the first pattern found in the text."""
    out = otherwise
    for pattern, name in reversed(patterns):
        out = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(out)
    return out


def normalize_age(text: Column) -> Column:
    """Whole years; ages in months, weeks or days are zero."""
    return let(F.lower(prepare(text)), _years)


def _years(t: Column) -> Column:
    found = r"(\d+)\s*(?:\.\d+)?\s*(years|year|yrs|yr|y)?"
    value, unit = F.regexp_extract(t, found, 1), F.regexp_extract(t, found, 2)
    young = F.regexp_like(t, F.lit(r"\b(m|mon|month|months|d|day|days|w|week|weeks)\b|^\d+\s*(m|d|w)\b"))
    return F.when((unit == "") & young & (value != ""), 0).otherwise(value.try_cast("int"))


def normalize_sex(text: Column) -> Column:
    return let(F.regexp_replace(F.lower(prepare(text)), "[^a-z]", ""), _sex)


def _sex(t: Column) -> Column:
    return F.when(t.isin("m", "male"), "male").when(t.isin("f", "female"), "female").when(t.isin("o", "other", "t", "ts", "transgender"), "other")


def normalize_ward_type(text: Column) -> Column:
    return let(F.lower(prepare(text)), _ward)


def _ward(t: Column) -> Column:
    exact = F.translate(t, " -", "__")
    return F.when(t.isNotNull(), F.when(exact.isin(*WARDS), exact).otherwise(first_pattern(t, WARD_PATTERNS, F.lit("other"))))


def normalize_category(text: Column) -> Column:
    return let(F.lower(prepare(text)), _category)


def _category(t: Column) -> Column:
    exact = F.regexp_replace(t, r"[\s-]+", "_")
    return F.when(t.isNotNull(), F.when(exact.isin(*CATEGORIES), exact).otherwise(first_pattern(t, CATEGORY_PATTERNS, F.lit("other"))))


def normalize_bool(text: Column) -> Column:
    return let(F.regexp_replace(F.regexp_replace(F.lower(prepare(text)), r"[\s-]+", "_"), "^_+|_+$", ""), _flag)


def _flag(t: Column) -> Column:
    return F.when(t.isin(*YES), True).when(t.isin(*NO) | F.replace(t, F.lit("_"), F.lit("")).isin(*NO), False)
