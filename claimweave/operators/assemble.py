"""Pages to documents: rows joined without those reprinted at a page break, header blocks picked,
sums checked.

Fragments are (doc_id, page_index, hospital, patient, insurance, totals, line_items), raw, blocks
null where a page doesn't show them. The pages of one document are folded in order; nothing
else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, text
from ..schema import BLOCKS, RAW_SCHEMA
from .documents import normalize_document

OVERLAP = 3
TOLERANCE = "1.00"
ITEM = RAW_SCHEMA["line_items"].dataType.elementType.simpleString()
KEYED = f"array<struct<item:{ITEM},key:struct<description:string,amount:decimal(38,6),quantity:decimal(38,6),rate:decimal(38,6)>>>"


def row_key(item: Column) -> Column:
    """What makes two printed rows the same; the serial number doesn't."""
    return F.struct(
        text.normalize_text(item["description"]).alias("description"), money.normalize_amount(item["amount"]).alias("amount"),
        money.normalize_quantity(item["quantity"]).alias("quantity"), money.normalize_amount(item["unit_rate"]).alias("rate"),
    )


def _keyed(items: Column) -> Column:
    rows = F.transform(items, lambda i: F.struct(i.alias("item"), row_key(i).alias("key")))
    return F.coalesce(rows, F.array()).cast(KEYED)


def _joiner(rows=lambda p: p["rows"], key=lambda r: r["key"]):
    """The rows of sorted pages: where the last rows so far are the first of the next page, the longest
    such overlap (three at most) is left out there. Rows within a page are never compared."""

    def add(merged: Column, page: Column) -> Column:
        new = rows(page)
        drop = F.lit(0)
        for k in range(1, OVERLAP + 1):
            tail = F.transform(F.slice(merged, F.greatest(F.size(merged) - k + 1, F.lit(1)), F.lit(k)), key)
            head = F.transform(F.slice(new, F.lit(1), F.lit(k)), key)
            drop = F.when((F.size(merged) >= k) & (F.size(new) >= k) & (tail == head), k).otherwise(drop)
        return text.let(drop, lambda d: F.concat(merged, F.slice(new, d + 1, F.size(new))))

    return add


def fold_pages(pages: Column, kind: str) -> Column:
    return F.aggregate(pages, F.array().cast(kind), _joiner())


def _getter(name: str):
    return lambda record: record[name]


def _conflicts(blocks: Column, name: str) -> list[Column]:
    """Paths at which a later page's block says something else than the first."""
    first = F.element_at(blocks, 1)
    out = []
    for field in RAW_SCHEMA[name].dataType.fieldNames():
        chosen = first[field]
        differs = lambda v: (chosen != "") & (v != "") & (text.normalize_text(chosen) != text.normalize_text(v))  # noqa: B023, E731
        other = F.exists(F.transform(blocks, _getter(field)), differs)
        out.append(F.when(F.size(blocks) > 1, F.when(F.coalesce(other, F.lit(False)), F.lit(f"{name}.{field}"))))
    return out


def assemble(fragments: DataFrame) -> DataFrame:
    """doc_id, document (raw), n_pages, n_rows_raw, n_rows, missing_blocks, conflicts."""
    items = RAW_SCHEMA["line_items"].dataType
    page = F.struct("page_index", *BLOCKS, F.coalesce(F.col("line_items").cast(items), F.array().cast(items)).alias("line_items"))
    docs = fragments.select("doc_id", page.alias("page")).groupBy("doc_id").agg(F.sort_array(F.collect_list("page")).alias("pages"))
    # Keys are made of what is gathered, so that who doesn't ask for rows doesn't pay for them.
    docs = docs.withColumn("rows", fold_pages(F.transform("pages", lambda p: F.struct(_keyed(p["line_items"]).alias("rows"))), KEYED))
    for b in BLOCKS:
        docs = docs.withColumn(f"_{b}", F.filter(F.transform("pages", _getter(b)), lambda x: x.isNotNull()))
    blocks = {b: F.try_element_at(F.col(f"_{b}"), F.lit(1)) for b in BLOCKS}
    items = F.transform("rows", lambda r: r["item"])
    document = F.struct(*((items if n == "line_items" else blocks[n]).alias(n) for n in RAW_SCHEMA.fieldNames()))
    missing = F.array_compact(F.array(*(F.when(F.size(f"_{b}") == 0, b) for b in BLOCKS)))
    conflicts = F.array_compact(F.array(*(c for b in BLOCKS for c in _conflicts(F.col(f"_{b}"), b))))
    return docs.select(
        "doc_id", document.alias("document"), F.size("pages").alias("n_pages"), F.size("rows").alias("n_rows"),
        F.aggregate("pages", F.lit(0), lambda n, p: n + F.size(p["line_items"])).alias("n_rows_raw"), missing.alias("missing_blocks"), conflicts.alias("conflicts"),
    )


def reconcile(documents: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """Adds line_sum, gross_delta, computed_net, net_delta, row_failures, arithmetic_flags, balanced, complete and
    flags; disagreements are reported, never mended."""
    zero = F.lit(0).cast("decimal(18,2)")
    docs = documents.withColumn("typed", normalize_document(F.col("document")))
    items, totals = F.col("typed.line_items"), F.col("typed.totals")
    some = F.exists(items, lambda i: i["amount"].isNotNull())
    total = F.aggregate(items, F.lit(0).cast("decimal(28,2)"), lambda s, i: (s + F.coalesce(i["amount"], zero)).cast("decimal(28,2)"))
    computed = totals["gross_amount"] - F.coalesce(totals["discount"], zero) + F.coalesce(totals["cgst"], zero) + F.coalesce(totals["sgst"], zero)
    wrong = F.filter(items, lambda i: F.coalesce((i["quantity"] * i["unit_rate"]) != i["amount"], F.lit(False)))
    docs = docs.withColumn("line_sum", F.when(some, total)).withColumn("computed_net", computed.cast("decimal(28,2)")).withColumn("row_failures", F.size(wrong))
    docs = docs.withColumn("gross_delta", (F.col("line_sum") - totals["gross_amount"]).cast("decimal(28,2)")).withColumn("net_delta", (totals["net_amount"] - F.col("computed_net")).cast("decimal(28,2)"))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    off = lambda c: F.abs(c) > F.lit(tolerance).cast("decimal(18,2)")
    sums = F.array_compact(F.array(
        F.when(off(F.col("gross_delta")), say("line items sum to ", F.col("line_sum"), " but gross is ", totals["gross_amount"], " (delta ", F.col("gross_delta"), ")")),
        F.when(off(F.col("net_delta")), say("stated net ", totals["net_amount"], " does not equal computed ", F.col("computed_net"), " (delta ", F.col("net_delta"), ")")),
        F.when(F.col("row_failures") > 0, say(F.col("row_failures"), " row(s) where quantity x rate != amount")),
    ))
    others = F.array_compact(F.array(
        F.when(F.size("conflicts") > 0, say("conflicting values across pages for: ", F.array_join("conflicts", ", "))),
        F.when(F.size("missing_blocks") > 0, say("no page carried: ", F.array_join("missing_blocks", ", "))),
    ))
    docs = docs.withColumn("arithmetic_flags", sums).withColumn("balanced", F.size("arithmetic_flags") == 0)
    complete = (F.size("missing_blocks") == 0) & (F.size("conflicts") == 0)
    return docs.withColumn("complete", complete).withColumn("flags", F.concat("arithmetic_flags", others)).drop("typed")


def subtotals(lines: DataFrame) -> DataFrame:
    """Printed rows of each document with a subtotal row after each category: line_index is null there."""
    return lines.groupingSets([["doc_id", "category", "line_index"], ["doc_id", "category"]], "doc_id", "category", "line_index").agg(
        F.sum("amount").alias("amount"), F.count("*").alias("n"), F.grouping("line_index").alias("is_subtotal")
    )
