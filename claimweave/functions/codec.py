"""Tagged sequences: records rendered as ``<s_key>value</s_key>`` and parsed back.

Absent and empty fields are left out in rendering. Parsing keeps what a cut-off sequence
still has: a block without its end, a last row with at least one closed field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import LINE_ITEM_FIELDS, RAW_SCHEMA

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
SEPARATOR = "<sep/>"
HEADER_BLOCKS = ("hospital", "patient", "insurance")


def escape_value(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape_value(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def tag(key: str, value: Column) -> Column:
    """The tagged value; null for null or empty."""
    return F.when(value != "", F.concat(F.lit(f"<s_{key}>"), escape_value(value), F.lit(f"</s_{key}>")))


def _tags(record: Column, names) -> Column:
    return F.concat_ws("", *(tag(n, record[n]) for n in names))


def render_block(record: Column, name: str) -> Column:
    body = _tags(record, RAW_SCHEMA[name].dataType.fieldNames())
    return F.when(body != "", F.concat(F.lit(f"<s_{name}>"), body, F.lit(f"</s_{name}>"))).otherwise("")


def render_head_a(document: Column, header: Column | bool = True, totals: Column | bool = True) -> Column:
    """The header blocks and the totals, each where wanted."""
    lit = lambda flag: F.lit(flag) if isinstance(flag, bool) else flag
    parts = [F.when(lit(header), render_block(document[b], b)) for b in HEADER_BLOCKS]
    return F.concat_ws("", *parts, F.when(lit(totals), render_block(document["totals"], "totals")))


def render_head_b(items: Column) -> Column:
    rows = F.filter(F.transform(F.coalesce(items, F.array()), lambda i: _tags(i, LINE_ITEM_FIELDS)), lambda r: r != "")
    return F.concat(F.lit("<s_line_items>"), F.array_join(rows, SEPARATOR), F.lit("</s_line_items>"))


def _body(text: Column, name: str) -> Column:
    """What the block holds, to its end or else to the end of the text; null without the block."""
    opened, closed = rf"(?s)<s_{name}>(.*?)</s_{name}>", rf"(?s)<s_{name}>(.*)"
    return F.when(F.regexp_like(text, F.lit(opened)), F.regexp_extract(text, opened, 1)).when(F.regexp_like(text, F.lit(closed)), F.regexp_extract(text, closed, 1))


def _field(body: Column, name: str) -> Column:
    found = rf"(?s)<s_{name}>(.*?)</s_{name}>"
    return F.when(F.regexp_like(body, F.lit(found)), F.trim(unescape_value(F.regexp_extract(body, found, 1))))


def _record(body: Column, kind: StructType) -> Column:
    return F.struct(*(_field(body, n).alias(n) for n in kind.fieldNames()))


def parse_block(text: Column, name: str) -> Column:
    return _record(_body(text, name), RAW_SCHEMA[name].dataType)


def parse_head_a(text: Column) -> Column:
    return F.struct(*(parse_block(text, b).alias(b) for b in (*HEADER_BLOCKS, "totals")))


def parse_head_b(text: Column) -> Column:
    kind = RAW_SCHEMA["line_items"].dataType.elementType
    rows = F.transform(F.split(_body(text, "line_items"), SEPARATOR), lambda c: _record(c, kind))
    some = lambda r: F.coalesce(*(r[n] for n in LINE_ITEM_FIELDS)).isNotNull()
    return F.coalesce(F.filter(rows, some), F.array().cast(RAW_SCHEMA["line_items"].dataType))


def tag_pairs(text: Column) -> Column:
    """(tag, value) of every opening tag, in order; the value runs to the next tag."""
    found = r"(?s)<s_([a-z_0-9-]+)>([^<]*)(?=<)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(found), 1).alias("tag"), F.transform(F.regexp_extract_all(text, F.lit(found), 2), lambda v: F.trim(v)).alias("value"))
    return F.filter(both, lambda p: p["value"] != "")


def has_repetition_loop(text: Column) -> Column:
    """A phrase four times or more in a row."""
    return F.regexp_like(text, F.lit(r"(?iU)\b(\w[\w ]{3,30}?)\b(?:\s+\1\b){3}"))
