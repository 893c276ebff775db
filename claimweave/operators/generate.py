"""Synthetic bills, drawn from hashes of seed and index: any part of the corpus can be made alone and
twice alike. Shares and ranges are what matters, not a particular stream of random numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, gstin, money
from ..schema import RAW_SCHEMA
from .labels_data import CITIES, FAMILY, FEMALE, INSURERS, ITEMS, MALE, WARDS
from .sampling import hashed_unit, sample_quality, split_for, weighted_choice

LAYOUTS = 21
#: Shares of documents with a missing hospital number, totals that don't add up, and a row printed twice.
MISSING_UHID, MISALIGNED, REPRINTED = 0.08, 0.05, 0.12


def pick(values: tuple[str, ...], unit: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.floor(unit * len(values)).cast("int") + 1)


def between(low: int, high: int, unit: Column, long_tail: bool = False) -> Column:
    """A whole number of the range, the upper end rare with a long tail; tens above 500."""
    value = low + (F.pow(unit, 2.2) if long_tail else unit) * (high - low)
    return F.when(value > 500, F.round(value / 10) * 10).otherwise(F.round(value)).cast("decimal(18,2)")


def sample_gstin(state_code: Column, *seed: Column) -> Column:
    """A number with a right check digit."""
    letter = lambda i: F.chr(F.floor(hashed_unit(F.lit(f"g{i}"), *seed) * 26).cast("int") + 65)
    digits = F.lpad(F.floor(hashed_unit(F.lit("gd"), *seed) * 10000).cast("string"), 4, "0")
    body = F.concat(F.lpad(state_code, 2, "0"), *(letter(i) for i in range(5)), digits, letter(5), F.lit("1Z"))
    return F.concat(body, gstin.check_digit(body))


def _printed(value: Column, style: Column) -> Column:
    return F.when(style == 0, money.format_amount(value)).when(style == 1, money.format_amount(value, "Rs. ")).when(style == 2, money.format_amount(value, slash=True)).otherwise(value.cast("decimal(18,2)").cast("string"))


def documents(spark: SparkSession, n: int, seed: int = 1337, shard: int = 0, shards: int = 1) -> DataFrame:
    """(doc_id, index, truth (raw), meta): bills of a shard, layouts taking turns."""
    base = spark.range(shard, n, shards).withColumnRenamed("id", "index")
    u = lambda what: hashed_unit(F.lit(seed), F.lit(what), F.col("index"))
    base = base.withColumn("female", u("sex") < 0.5).withColumn("stay", (1 + F.floor(u("stay") * 9)).cast("int")).withColumn("style", F.floor(u("style") * 4).cast("int")).withColumn("date_style", F.floor(u("dates") * 6).cast("int"))
    base = base.withColumn("admitted", F.date_add(F.lit("2025-01-01").cast("date"), F.floor(u("day") * 360).cast("int"))).withColumn("city", pick(tuple(CITIES), u("city")))
    base = base.withColumn("ward", weighted_choice(u("ward"), WARDS))
    rows = F.sequence(F.lit(0), (3 + F.floor(u("rows") * 10)).cast("int"))

    def item(i: Column) -> Column:
        iu = lambda what: hashed_unit(F.lit(seed), F.lit(what), F.col("index"), i)
        which = F.when(i == 0, 0).otherwise(1 + F.floor(iu("item") * (len(ITEMS) - 1)).cast("int"))
        at = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in ITEMS)), which + 1)
        rate = at(2) + F.pow(iu("rate"), 2.2) * (at(3) - at(2))
        rate = F.when(rate > 500, F.round(rate / 10) * 10).otherwise(F.round(rate)).cast("decimal(18,2)")
        quantity = F.when(i == 0, F.col("stay")).otherwise(1 + F.floor(iu("qty") * 3).cast("int"))
        return F.struct(at(0).alias("description"), at(1).alias("category"), quantity.alias("quantity"), rate.alias("rate"), (rate * quantity).cast("decimal(18,2)").alias("amount"))

    base = base.withColumn("items", F.transform(rows, item))
    gross = F.aggregate("items", F.lit(0).cast("decimal(18,2)"), lambda s, x: (s + x["amount"]).cast("decimal(18,2)"))
    base = base.withColumn("gross", gross)
    off = F.when(u("off") < MISALIGNED, F.lit("-13.40")).otherwise("0").cast("decimal(18,2)")
    none = F.lit(None).cast("string")
    leaf = {
        "hospital.name": F.concat("city", F.lit(" General Hospital")), "hospital.city": F.col("city"), "hospital.gstin": sample_gstin(F.lit("36"), F.lit(seed), F.col("index")),
        "patient.name": F.concat(F.when(F.col("female"), "Mrs. ").otherwise("Mr. "), F.when(F.col("female"), pick(FEMALE, u("first"))).otherwise(pick(MALE, u("first"))), F.lit(" "), pick(FAMILY, u("family"))),
        "patient.age": F.floor(1 + u("age") * 88).cast("string"), "patient.sex": F.when(F.col("female"), "F").otherwise("M"),
        "patient.uhid": F.when(u("uhid") >= MISSING_UHID, F.concat(F.lit("UH"), F.lpad(F.col("index").cast("string"), 8, "0"))),
        "patient.admission_date": dates.format_date(F.col("admitted"), F.col("date_style")), "patient.discharge_date": dates.format_date(F.date_add("admitted", F.col("stay")), F.col("date_style")),
        "patient.ward_type": F.col("ward"), "insurance.insurer_name": pick(INSURERS, u("insurer")), "insurance.policy_number": F.concat(F.lit("POL-"), F.floor(u("policy") * 10**8).cast("string")),
        "totals.gross_amount": _printed(F.col("gross"), F.col("style")), "totals.net_amount": _printed((F.col("gross") + off).cast("decimal(18,2)"), F.col("style")),
    }
    kind = RAW_SCHEMA["line_items"].dataType.elementType

    def printed(x: Column, i: Column) -> Column:
        given = {"serial_no": (i + 1).cast("string"), "description": x["description"], "category": x["category"], "quantity": x["quantity"].cast("string"), "unit_rate": _printed(x["rate"], F.col("style")), "amount": _printed(x["amount"], F.col("style"))}
        return F.struct(*(given.get(name, none).alias(name) for name in kind.fieldNames()))

    parts = [F.transform("items", printed).alias(f.name) if f.name == "line_items" else F.struct(*(leaf.get(f"{f.name}.{x}", none).alias(x) for x in f.dataType.fieldNames())).alias(f.name) for f in RAW_SCHEMA]
    meta = F.create_map(
        F.lit("layout"), F.concat(F.lit("L"), (F.col("index") % LAYOUTS + 1).cast("string")), F.lit("split"), split_for(F.col("index"), LAYOUTS),
        F.lit("quality"), sample_quality(F.lit(seed), F.col("index")), F.lit("reprinted"), (u("again") < REPRINTED).cast("string"),
    )
    return base.select(F.format_string("DOC-%08d", "index").alias("doc_id"), "index", F.struct(*parts).alias("truth"), meta.alias("meta"))


def printed_text(document: Column) -> Column:
    """A bill's text in the layout with headings, which the extractors read."""
    items = F.transform(document["line_items"], lambda i: F.concat_ws("  ", i["serial_no"], i["description"], F.concat(F.lit(" "), i["quantity"]), i["unit_rate"], i["amount"]))
    line = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(f"{label} : "), value))
    p, t = document["patient"], document["totals"]
    return F.concat_ws(
        "\n", document["hospital"]["name"], line("GSTIN", document["hospital"]["gstin"]), line("Patient Name", p["name"]), F.concat(F.lit("Age / Sex : "), p["age"], F.lit(" / "), p["sex"]), line("UHID", p["uhid"]),
        line("Admission", p["admission_date"]), line("Discharge", p["discharge_date"]), line("Ward Type", p["ward_type"]), line("Insurer", document["insurance"]["insurer_name"]), line("Policy No", document["insurance"]["policy_number"]),
        F.lit("S.No  Description   Qty  Rate  Amount"), F.array_join(items, "\n"), line("Gross Amount", t["gross_amount"]), line("Net Amount", t["net_amount"]),
    )
