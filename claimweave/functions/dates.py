"""Day-first dates as Indian bills print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, prepare, strip_edges

#: The year from which two digits are of the last century, months, a time of day after a date, ordinals, and
#: accepted forms in order, with the groups of year, month and day.
PIVOT = 70
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CLOCK = r"(?i)[\s,]+\d{1,2}[:.]\d{2}(?::\d{2})?(?:\s*[ap]\.?m\.?)?\s*$"
ORDINAL = r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b"
FORMS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 1, 2, 3),
    (r"^(\d{1,2})[-/.\s](\d{1,2})[-/.\s](\d{2,4})$", 3, 2, 1),
    (r"^(\d{1,2})[-/.\s]+([A-Za-z]+)[-/.,\s]+(\d{2,4})$", 3, 2, 1),
    (r"^([A-Za-z]+)[-/.\s]+(\d{1,2})[-/.,\s]+(\d{2,4})$", 3, 1, 2),
)


def expand_year(year: Column) -> Column:
    return F.when(year >= 100, year).when(year >= PIVOT, year + 1900).otherwise(year + 2000)


def build_date(year: Column, month: Column, day: Column) -> Column:
    """Null where the calendar has no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", expand_year(year), month, day), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    name, out = F.lower(name), F.lit(None).cast("int")
    for i, month in enumerate(MONTHS, 1):
        short = {month[:3], month} | ({"sept"} if month == "september" else set())
        out = F.when(name.isin(*short), i).otherwise(out)
    return out


def normalize_date(text: Column) -> Column:
    text = F.trim(F.regexp_replace(prepare(text), CLOCK, ""))
    return let(strip_edges(F.regexp_replace(text, ORDINAL, "$1"), " .,"), _first_form)


def _first_form(text: Column) -> Column:
    out = F.lit(None).cast("date")
    for form, year, month, day in reversed(FORMS):
        part = lambda i, form=form: F.regexp_extract(text, form, i)
        number = part(month).try_cast("int") if form in (FORMS[0][0], FORMS[1][0]) else month_number(part(month))
        made = build_date(part(year).try_cast("int"), number, part(day).try_cast("int"))
        out = F.when(F.regexp_like(text, F.lit(form)), F.when(number.isNotNull(), made)).otherwise(out)
    return out


#: Six printed styles.
STYLES = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd-MMM-yyyy", "d MMM yy", "yyyy-MM-dd")


def format_date(date: Column, style: Column) -> Column:
    """The date in the style of that number."""
    out = F.date_format(date, STYLES[-1])
    for i, pattern in enumerate(STYLES[:-1]):
        out = F.when(style == i, F.date_format(date, pattern)).otherwise(out)
    return out
