"""Printed values and back: each query makes printed forms out of typed columns and normalises them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, gstin, labels, money, text
from ..sources.testdata import table
from .registry import query


def _pick(number: Column, choices: tuple[str | None, ...]) -> Column:
    """The choice at number modulo their count."""
    return F.element_at(F.array(*(F.lit(c) for c in choices)), (number % len(choices) + 1).cast("int"))


def _sql(choices, number: str) -> str:
    quoted = ", ".join("NULL" if c is None else "'" + c.replace("'", "''") + "'" for c in choices)
    return f"([{quoted}])[({number}) % {len(choices)} + 1]"


JUNK = ("31/02/2025", "05/13/2025", "05-Xyz-2025", "2025", "n/a", "")


@query(
    "normalize_dates",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderdate::DATE END AS value FROM orders",
)
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    printed = dates.format_date(F.col("d"), (F.col("o_orderkey") % 7).cast("int"))
    printed = F.when(F.col("o_orderkey") % 7 == 6, _pick(F.col("o_orderkey"), JUNK)).when(F.col("o_orderkey") % 5 == 0, F.concat(printed, F.lit(", 10:30 a.m."))).otherwise(printed)
    return orders.select("o_orderkey", dates.normalize_date(printed).alias("value"))


@query(
    "normalize_date_words",
    """SELECT o_orderkey, o_orderdate::DATE AS value FROM orders""",
)
def normalize_date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    ordinal = F.concat(F.dayofmonth("d").cast("string"), F.lit("th "), F.date_format("d", "MMMM yyyy"))
    words = F.when(F.col("o_orderkey") % 2 == 0, ordinal).otherwise(F.date_format("d", "MMM d, yyyy"))
    return orders.select("o_orderkey", dates.normalize_date(words).alias("value"))


@query(
    "normalize_amounts",
    """SELECT o_orderkey, (CASE o_orderkey % 7 WHEN 2 THEN -1 WHEN 5 THEN 0 WHEN 6 THEN NULL ELSE 1 END * round(o_totalprice * 100)::BIGINT)::BIGINT AS hundredths FROM orders""",
)
def normalize_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("a"))
    k, a = F.col("o_orderkey") % 7, F.col("a")
    printed = (
        F.when(k == 0, money.format_amount(a)).when(k == 1, money.format_amount(a, "Rs. ")).when(k == 2, money.format_amount(-a))
        .when(k == 3, money.format_amount(a, "INR ", slash=True)).when(k == 4, F.replace(money.format_amount(a), F.lit(","), F.lit(" ")))
        .when(k == 5, F.lit("NIL")).otherwise(_pick(F.col("o_orderkey"), ("abc", "1.2.3", "Rs.", "", "1e3")))
    )
    return orders.select("o_orderkey", (money.normalize_amount(printed) * 100).cast("bigint").alias("hundredths"))


UNITS = (" x", " nos", " Nos.", " units", "", " qty")


@query("normalize_quantity", "SELECT DISTINCT l_orderkey, l_quantity::BIGINT AS quantity FROM lineitem")
def normalize_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    printed = F.concat(F.col("l_quantity").cast("int").cast("string"), _pick(F.col("l_orderkey"), UNITS))
    return lines.select("l_orderkey", money.normalize_quantity(printed).cast("bigint").alias("quantity")).distinct()


@query(
    "normalize_identifiers",
    r"SELECT c_custkey, nullif(upper(regexp_replace('pol-' || c_custkey || ' / ' || c_name || '#', '[^A-Za-z0-9]', '', 'g')), '') AS id FROM customer",
)
def normalize_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    printed = F.concat(F.lit("pol-"), F.col("c_custkey").cast("string"), F.lit(" / "), F.col("c_name"), F.lit("#"))
    return customers.select("c_custkey", text.normalize_identifier(printed).alias("id"))


TITLES = ("Dr. Mrs. ", "Mr. ", "Baby of Smt. ", "B/O ", "", "Shri  ")


@query(
    "normalize_names",
    r"SELECT c_custkey, trim(regexp_replace(lower('A.B. ' || replace(c_name, '#', ' ')), '[.,;: ]+', ' ', 'g')) AS name FROM customer",
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    printed = F.concat(_pick(F.col("c_custkey"), TITLES), F.lit("A.B. "), F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")))
    return customers.select("c_custkey", text.normalize_name(printed).alias("name"))


@query("normalize_org_names", "SELECT s_suppkey, 'dr. ' || lower(s_name) || ' nursing home' AS name FROM supplier")
def normalize_org_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    printed = F.concat(F.lit("  ..Dr. "), F.col("s_name"), F.lit("  Nursing Home ,;"))
    return suppliers.select("s_suppkey", text.normalize_org_name(printed).alias("name"))


WARDS = ("Semi-Private", "Twin Sharing", "Single Room", "ICCU", "Casualty", "Zzz Block 4", "N.I.C.U", "nicu bed", "General Ward", "day care", "Deluxe Suite", None)
WARD_CANON = ("semi_private", "semi_private", "private", "iccu", "emergency", "other", "other", "nicu", "general", "day_care", "deluxe", None)


@query("ward_types", f"SELECT o_orderkey, {_sql(WARD_CANON, 'o_orderkey')} AS ward FROM orders")
def ward_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", labels.normalize_ward_type(_pick(F.col("o_orderkey"), WARDS)).alias("ward"))


KINDS = ("Bed Charges", "X-Ray Chest PA", "Surgeon Fee - OT", "Attendant Charges", "Zzzz", "Parenteral nutrition", "professional fees", "Lab Test", "Oxygen", None)
KIND_CANON = ("room_rent", "radiology", "surgery", "non_medical", "other", "room_rent", "professional_fees", "diagnostics", "equipment", None)


@query("category_patterns", f"SELECT l_orderkey, l_linenumber, count(*) AS n, {_sql(KIND_CANON, 'l_orderkey + l_linenumber')} AS category FROM lineitem GROUP BY ALL")
def category_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    name = labels.normalize_category(_pick(F.col("l_orderkey") + F.col("l_linenumber"), KINDS))
    return lines.withColumn("category", name).groupBy("l_orderkey", "l_linenumber", "category").agg(F.count("*").alias("n"))


AGES, AGE_CANON = ("45", "45 Y", "45Y/M", "6 months", "6M", "3 weeks", "adult", "10.5 yrs"), (45, 45, 45, 0, 0, 0, None, 10)
SEXES, SEX_CANON = ("M", "FEMALE", "Transgender", "M/F", "x", "f.", None), ("male", "female", "other", None, None, "female", None)
FLAGS, FLAG_CANON = ("Payable", "Non-Payable", "1", "maybe", "Deducted", "not payable", "?"), (True, False, True, None, False, False, None)


@query(
    "small_vocabularies",
    f"""SELECT c_custkey, ([{', '.join('NULL' if a is None else str(a) for a in AGE_CANON)}])[c_custkey % 8 + 1]::INT AS age, {_sql(SEX_CANON, 'c_custkey')} AS sex,
    ([{', '.join('NULL' if a is None else str(a).lower() for a in FLAG_CANON)}])[c_custkey % 7 + 1]::BOOLEAN AS payable FROM customer""",
)
def small_vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", labels.normalize_age(_pick(k, AGES)).alias("age"), labels.normalize_sex(_pick(k, SEXES)).alias("sex"), labels.normalize_bool(_pick(k, FLAGS)).alias("payable"),
    )


_BODY = "lpad((c_custkey % 100)::VARCHAR, 2, '0') || 'ABCDE' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'F' || (c_custkey % 9 + 1) || 'Z'"
_ALPHA = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOTAL = " + ".join(f"((({2 if i % 2 else 1}) * (strpos('{_ALPHA}', b[{15 - i}]) - 1)) // 36 + (({2 if i % 2 else 1}) * (strpos('{_ALPHA}', b[{15 - i}]) - 1)) % 36)" for i in range(1, 15))
GSTIN_SQL = f"WITH x AS (SELECT c_custkey, {_BODY} AS b FROM customer), y AS (SELECT *, ('{_ALPHA}')[(36 - ({_TOTAL}) % 36) % 36 + 1] AS digit FROM x)"


def _gstin_body() -> Column:
    k = F.col("c_custkey")
    pad = lambda n, width: F.lpad((k % n).cast("string"), width, "0")
    return F.concat(pad(100, 2), F.lit("ABCDE"), pad(10000, 4), F.lit("F"), (k % 9 + 1).cast("string"), F.lit("Z"))


@query("gstin_check_digits", f"{GSTIN_SQL} SELECT c_custkey, digit FROM y")
def gstin_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", gstin.check_digit(_gstin_body()).alias("digit"))


@query("gstin_valid", f"{GSTIN_SQL} SELECT c_custkey, c_custkey % 3 <> 0 OR digit = '0' AS valid FROM y")
def gstin_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third has 0 for its check digit."""
    digit = F.when(F.col("c_custkey") % 3 == 0, "0").otherwise(gstin.check_digit(_gstin_body()))
    return table(spark, sf_dir, "customer").select("c_custkey", gstin.is_valid_gstin(F.lower(F.concat(_gstin_body(), digit))).alias("valid"))


@query(
    "indian_grouping",
    r"""WITH x AS (SELECT o_orderkey, (round(o_totalprice * 100)::BIGINT // 100)::VARCHAR AS d FROM orders)
    SELECT o_orderkey, CASE WHEN length(d) <= 3 THEN d ELSE ltrim(reverse(regexp_replace(reverse(d[:length(d) - 3]), '(..)', '\1,', 'g')), ',') || ',' || right(d, 3) END AS grouped FROM x""",
)
def indian_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor(F.round("o_totalprice", 2).cast("decimal(18,2)")).cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", money.indian_grouping(whole).alias("grouped"))


@query(
    "mask_values",
    "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS masked FROM customer",
)
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask(F.col("c_name")).alias("masked"))
