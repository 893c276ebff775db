"""Tax registration numbers: fifteen characters, the last a weighted check digit to base 36."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize_identifier

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHAPE = r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"

normalize_gstin = normalize_identifier


def _term(body: Column, i: Column) -> Column:
    """What the i-th character from the right adds."""
    weight = F.when(i % 2 == 1, 2).otherwise(1)
    product = weight * (F.position(F.substring(body, F.lit(15) - i, F.lit(1)), F.lit(ALPHABET)) - 1)
    return F.floor(product / 36).cast("int") + product % 36


def check_digit(first_fourteen: Column) -> Column:
    """Weights alternate 2, 1 from the right; products count by quotient and remainder of 36."""
    return let(F.upper(first_fourteen), _digit)


def _digit(body: Column) -> Column:
    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda t, i: t + _term(body, i))
    digit = F.substring(F.lit(ALPHABET), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))
    return F.when(F.regexp_like(body, F.lit("^[0-9A-Z]{14}$")), digit)


def is_valid_gstin(text: Column) -> Column:
    sound = lambda code: F.regexp_like(code, F.lit(SHAPE)) & (check_digit(F.substring(code, 1, 14)) == F.substring(code, 15, 1))
    return F.coalesce(let(normalize_gstin(text), sound), F.lit(False))
