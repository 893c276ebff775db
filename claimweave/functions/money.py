"""Money: decimals from end to end, half-up rounding, Indian printing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_whitespace, let, prepare, strip_edges

#: What prints as zero, and marks of the currency.
ZEROS = ("nil", "nill", "none", "-", "--", "---")
CURRENCY = r"(?i)(?:₹|rs\.?|inr|r\.s\.?)"
PARSED = "decimal(38,6)"
MONEY = "decimal(18,2)"


def _without_currency(text: Column) -> Column:
    return collapse_whitespace(F.regexp_replace(text, CURRENCY, " "))


def parse_decimal(text: Column, currency: bool) -> Column:
    """The number that a printed string stands for, or null: grouped, negative by
    parentheses or sign, with a trailing slash or dash."""
    read = lambda t: let(prepare(t), lambda whole: let(_without_currency(whole) if currency else whole, lambda body: _number(whole, body, currency)))
    # Digits with a point at most are what they say.
    return let(text.cast("string"), lambda t: F.when(F.regexp_like(t, F.lit(r"^\d+(?:\.\d+)?$")), t.try_cast(PARSED)).otherwise(read(t)))


def _number(whole: Column, body: Column, currency: bool) -> Column:
    bracketed = F.startswith(body, F.lit("(")) & F.endswith(body, F.lit(")")) & (F.char_length(body) >= 1)
    inner = F.trim(F.regexp_replace(body, r"^\(|\)$", ""))
    body = F.when(bracketed, _without_currency(inner) if currency else inner).otherwise(body)
    body = F.trim(F.regexp_replace(body, r"/-*\s*$", ""))
    body = F.trim(F.regexp_replace(body, r"-\s*$", ""))
    body = F.trim(F.regexp_replace(strip_edges(body, "=* "), r"^\+", ""))
    return let(body, lambda body: _signed(whole, body, bracketed | F.startswith(body, F.lit("-"))))


def _signed(whole: Column, body: Column, negative: Column) -> Column:
    return let(F.trim(F.regexp_replace(body, "^-", "")), lambda body: _plain_number(whole, body, negative))


def _plain_number(whole: Column, body: Column, negative: Column) -> Column:
    digits = F.regexp_replace(body, r"(?<=\d)[,\s](?=\d)", "")
    value = F.when(F.regexp_like(digits, F.lit(r"^(?:\d*\.?\d+|\d+\.)$")), F.regexp_replace(digits, r"\.$", "").try_cast(PARSED))
    zero = F.lower(whole).isin(*ZEROS) | F.lower(body).isin(*ZEROS)
    return F.when(zero, F.lit(0).cast(PARSED)).otherwise(F.when(negative, -value).otherwise(value)).cast(PARSED)


def normalize_amount(text: Column) -> Column:
    return parse_decimal(text, currency=True)


def normalize_quantity(text: Column) -> Column:
    return parse_decimal(F.regexp_replace(prepare(text), r"(?i)\s*(?:x|nos?\.?|units?|qty\.?)\s*$", ""), currency=False)


def round_money(value: Column) -> Column:
    """Half up, to the hundredth."""
    return F.round(value, 2).cast(MONEY)


def round_half_even(value: Column) -> Column:
    """As generated amounts are rounded."""
    return F.bround(value, 2).cast(MONEY)


def share_of(amount: Column, part: Column, whole: Column) -> Column:
    """amount * part / whole in whole units, half up, without a rounded quotient in between."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(2 * wide(amount) * wide(part)) + wide(whole), wide(2 * wide(whole)))


def indian_grouping(digits: Column) -> Column:
    """The last three digits, then pairs."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d\d)+\d$)", ",")


def format_amount(value: Column, prefix: str = "", slash: bool = False, parentheses: bool = True, nil: bool = False) -> Column:
    """Printed money with Indian grouping."""
    size = F.abs(value).cast("decimal(38,2)").cast("string")
    body = F.concat(indian_grouping(F.substring_index(size, ".", 1)), F.lit("."), F.substring_index(size, ".", -1), F.lit("/-" if slash else ""))
    out = F.concat(F.lit(prefix), body)
    if parentheses:
        out = F.when(value < 0, F.concat(F.lit("("), out, F.lit(")"))).otherwise(out)
    else:
        out = F.when(value < 0, F.concat(F.lit("-"), out)).otherwise(out)
    return F.when(value == 0, "NIL").otherwise(out) if nil else out


def format_quantity(value: Column) -> Column:
    """Whole quantities without decimals, others without trailing zeros."""
    text = F.regexp_replace(value.cast("decimal(38,4)").cast("string"), r"\.?0+$", "")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(text)


def format_rupees(value: Column) -> Column:
    return F.concat(F.lit("Rs "), F.format_number(value, 2))


def format_percent(value: Column) -> Column:
    return F.concat(F.format_number(value * 100, 1), F.lit("%"))
