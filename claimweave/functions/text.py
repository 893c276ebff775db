"""Text, names and identifiers: null-safe, total, native.

Compatibility forms (full-width digits, ligatures, the rupee sign) are composed before anything
else is read. That is the ICU library's work, which Spark ships for its collations, called within
the plan; ASCII, as most values are, goes past it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that count as a hyphen, and titles before personal names.
DASHES = "‐‑‒–—―−"
HONORIFICS = ("baby of", "b/o", "master", "mstr", "shri", "smt", "sri", "mrs", "miss", "mr", "ms", "dr")
SPACE = r"(?U)\s+"
#: What a text has that isn't printable ASCII with single spaces inside.
UNEVEN = r"[^ -~]|  |^ | \z|^\z"


def _wide(text: Column) -> Column:
    return F.octet_length(text) > F.char_length(text)


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition."""
    text = text.cast("string")
    return F.when(_wide(text), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))).otherwise(text)


def casefold(text: Column) -> Column:
    """Full case folding, by which a sharp s is two letters."""
    return F.when(_wide(text), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), text, F.lit(True))).otherwise(F.lower(text))


def nfkc_casefold(text: Column) -> Column:
    return let(nfkc(text), casefold)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used; without it, trees of
    expressions that use their input twice double at every step."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def prepare(text: Column) -> Column:
    """Composed, with hyphens for all dashes and single spaces; null for blank."""
    return blank_to_null(collapse_whitespace(F.translate(nfkc(text), DASHES, "-" * len(DASHES))))


def strip_edges(text: Column, characters: str) -> Column:
    """Without the characters (of a regular-expression class) at either end."""
    return F.regexp_replace(text, f"^[{characters}]+|[{characters}]+$", "")


def normalize_text(text: Column) -> Column:
    # Most values are plain, and only lose their capitals.
    return let(text.cast("string"), lambda t: F.when(~F.regexp_like(t, F.lit(UNEVEN)), F.lower(t)).otherwise(let(prepare(t), casefold)))


def normalize_org_name(text: Column) -> Column:
    """Punctuation at the edges goes; titles stay, as they belong to the name."""
    return blank_to_null(let(collapse_whitespace(strip_edges(prepare(text), r" .,:;\-_/\\|")), casefold))


def normalize_name(text: Column) -> Column:
    """A person's name without titles, however many, and without the dots of initials."""
    title = "|".join(HONORIFICS)
    name = F.regexp_replace(let(prepare(text), casefold), rf"^(?:[ .,]*(?:{title})(?=$|[\s.,]))+[ .,]*", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\b([a-z])\.", "$1 "), r"[.,;:]+", " ")
    return blank_to_null(collapse_whitespace(strip_edges(name, r" \-_/\\|")))


def normalize_identifier(text: Column) -> Column:
    return blank_to_null(F.upper(F.regexp_replace(prepare(text), "[^A-Za-z0-9]", "")))


def as_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def mask(text: Column, keep: int = 2) -> Column:
    """All but the first and last characters hidden; short values wholly."""
    n = F.char_length(text)
    inside = F.concat(F.substring(text, 1, keep), F.repeat(F.lit("*"), F.greatest(n - 2 * keep, F.lit(0))), F.substring(text, -keep, keep))
    return F.when(n <= 2 * keep, F.repeat(F.lit("*"), n)).otherwise(inside)


def clean_value(text: Column) -> Column:
    """A label's value without the colon and spaces around it."""
    return blank_to_null(F.trim(F.regexp_replace(F.trim(text), "^:+|:+$", "")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), SPACE), lambda t: t != "")


def split_cells(text: Column) -> Column:
    """Cells of a printed row: parted by bars if there are any, else by two spaces or more."""
    bars = F.transform(F.split(text, r"\|"), lambda c: F.trim(c))
    gaps = F.split(F.trim(text), r"\s{2,}")
    return F.filter(F.when(F.contains(text, F.lit("|")), bars).otherwise(gaps), lambda c: c != "")


def lines(text: Column) -> Column:
    """(top, left, text) of each line, right-trimmed."""
    rows = F.split(text, r"\r\n|\n|\r")
    return F.transform(rows, lambda line, i: F.struct(i.alias("top"), (F.char_length(line) - F.char_length(F.ltrim(line))).alias("left"), F.rtrim(line).alias("text")))
