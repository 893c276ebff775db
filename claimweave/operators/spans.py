"""Boxes to lines, labels to spans, spans to rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FIELD_PATHS, LINE_ITEM_FIELDS, RAW_SCHEMA

MIN_CONFIDENCE, ROW_TOLERANCE, BAND = 0.3, 0.6, 12.0
LABELS = ("O", *(f"{p}-{name}" for name in (*FIELD_PATHS, *(f"line_items.{f}" for f in LINE_ITEM_FIELDS)) for p in "BI"))


def label_id(label: Column) -> Column:
    """Place of a label, from 0; -1 for an unknown one."""
    return F.array_position(F.array(*(F.lit(x) for x in LABELS)), label) - 1


def bounds(box: Column) -> Column:
    """struct(x0, y0, x1, y1) of four corner points."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def page_lines(boxes: list[tuple[float, float, float, float, str, float]], tolerance: float = ROW_TOLERANCE) -> list[tuple[int, int, str]]:
    """(top, left, text) of one page's boxes (x0, y0, x1, y1, text, score): boxes whose centres are near a
    row's mean make a row, and cells stand at the column their place on the page asks for."""
    boxes = sorted((b for b in boxes if b[5] >= MIN_CONFIDENCE and b[4] and b[4].strip()), key=lambda b: (b[1], b[0]))
    if not boxes:
        return []
    heights = sorted(b[3] - b[1] for b in boxes)
    reach = tolerance * heights[len(heights) // 2]
    widths = sorted((b[2] - b[0]) / len(b[4].strip()) for b in boxes)
    char = max(widths[len(widths) // 2], 1e-6)
    rows: list[list] = []
    for b in boxes:
        centre = (b[1] + b[3]) / 2
        row = next((r for r in rows if abs(sum((x[1] + x[3]) / 2 for x in r) / len(r) - centre) <= reach), None)
        if row is None:
            rows.append([b])
        else:
            row.append(b)
    out = []
    for top, row in enumerate(sorted(rows, key=lambda r: min(b[1] for b in r))):
        line = ""
        for b in sorted(row):
            gap = max(int(b[0] / char) - len(line), 2 if line else 0)
            line += " " * gap + b[4].strip()
        out.append((top, len(line) - len(line.lstrip()), line))
    return out


def boxes_to_lines(boxes: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, top, left, text) from (page, x0, y0, x1, y1, text, score)."""
    kind = boxes.schema[page_col].dataType.simpleString()
    pages = boxes.groupBy(page_col).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1", "text", "score")).alias("boxes"))

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *x) for p, b in zip(f[page_col], f["boxes"], strict=True) for x in page_lines([tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in b])]
            yield pd.DataFrame(rows, columns=[page_col, "top", "left", "text"])

    return pages.mapInPandas(lines, f"`{page_col}` {kind}, top int, left int, text string")


def decode_spans(tokens: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, path, start, text, x0, y0, x1, y1) of runs of labels in (page, idx, label, text, x0, y0, x1, y1); an I- label
    that follows nothing of its kind begins a run."""
    order = Window.partitionBy(page_col).orderBy("idx")
    path, begins = F.expr("substring(label, 3)"), F.startswith("label", F.lit("B-"))
    before = F.lag("label", 1, "O").over(order)
    fresh = (F.col("label") != "O") & (begins | (F.substr(before, F.lit(3)) != path))
    runs = tokens.withColumn("run", F.sum((fresh | (F.col("label") == "O")).cast("int")).over(order)).where("label <> 'O'")
    words = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"])
    found = runs.groupBy(page_col, "run").agg(
        F.min(path).alias("path"), F.min("idx").alias("start"), F.array_join(words, " ").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )
    return found.drop("run")


def rows_by_band(spans: DataFrame, page_col: str = "page_id", tolerance: float = BAND) -> DataFrame:
    """(page, row, attribute, text): spans of line items from top to bottom; a row ends where a span lies more than the
    tolerance under its first one, or names an attribute that the row has."""
    kind = spans.schema[page_col].dataType.simpleString()
    items = spans.where(F.startswith("path", F.lit("line_items.")))
    pages = items.groupBy(page_col).agg(F.sort_array(F.collect_list(F.struct(((F.col("y0") + F.col("y1")) / 2).alias("y"), "x0", F.expr("substring(path, 12)").alias("attribute"), "text"))).alias("spans"))

    def bands(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page, found in zip(f[page_col], f["spans"], strict=True):
                row, anchor, seen = -1, None, set()
                for s in found:
                    if anchor is None or s["y"] - anchor > tolerance or s["attribute"] in seen:
                        row, anchor, seen = row + 1, s["y"], set()
                    seen.add(s["attribute"])
                    out.append((page, row, s["attribute"], s["text"]))
            yield pd.DataFrame(out, columns=[page_col, "row", "attribute", "text"])

    return pages.mapInPandas(bands, f"`{page_col}` {kind}, row int, attribute string, text string")


def header_values(spans: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, path, text): the first span of each header field."""
    head = spans.where(~F.startswith("path", F.lit("line_items.")))
    return head.groupBy(page_col, "path").agg(F.min_by("text", "start").alias("text"))


def documents_of(spans: DataFrame, page_col: str = "page_id", tolerance: float = BAND) -> DataFrame:
    """(page, document): raw documents out of decoded spans: of each header field the first span, and line items by bands."""
    item = RAW_SCHEMA["line_items"].dataType
    head = header_values(spans, page_col).groupBy(page_col).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("head"))
    rows = rows_by_band(spans, page_col, tolerance).groupBy(page_col, "row").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "text"))).alias("cells"))
    made = F.struct(*(F.try_element_at("cells", F.lit(f)).alias(f) for f in item.elementType.fieldNames()))
    items = rows.groupBy(page_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", made.alias("item")))), lambda r: r["item"]).cast(item).alias("items"))
    value = lambda b, n: F.try_element_at("head", F.lit(f"{b}.{n}")).alias(n)
    block = lambda b: F.struct(*(value(b, n) for n in RAW_SCHEMA[b].dataType.fieldNames()))
    every = [(F.coalesce("items", F.array().cast(item)) if f.name == "line_items" else block(f.name)).alias(f.name) for f in RAW_SCHEMA]
    return head.join(items, page_col, "full").select(page_col, F.struct(*every).alias("document"))
