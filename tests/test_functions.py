"""Scalar functions against vectors of printed values."""

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimweave.functions import codec, dates, gstin, labels, money, similarity, text
from claimweave.schema import CATEGORIES, DATE_FIELD_PATHS, FIELD_PATHS, LINE_ITEM_FIELDS, MONEY_FIELD_PATHS, RAW_SCHEMA, TYPED_SCHEMA, special_tokens


def of(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def check(spark, f, cases):
    assert of(spark, f, [a for a, _ in cases]) == [b for _, b in cases]


def test_amounts(spark):
    good = {"1,23,456.00": "123456", "12,34,567.89": "1234567.89", "1 23 456.00": "123456", "RS.500": "500", "500/-": "500", "500-": "500", "(1,234.00)": "-1234", "Rs. (2,500.00)": "-2500",
            "(Rs. 2,500.00)": "-2500", "NIL": "0", "-": "0", "--": "0", ".50": "0.5", "1234.": "1234", "Rs. NIL": "0", "₹ 12": "12", "-5": "-5", "+5": "5", "= 10.00 *": "10"}
    got = of(spark, money.normalize_amount, list(good))
    assert got == [Decimal(v) for v in good.values()]
    assert of(spark, money.normalize_amount, [None, "", "  ", "abc", "N/A", "1.2.3", "Rs.", "??", "1e3"]) == [None] * 9


def test_quantities(spark):
    check(spark, money.normalize_quantity, [("1 x", Decimal(1)), ("2 nos", Decimal(2)), ("3 Nos.", Decimal(3)), ("4 units", Decimal(4)), ("01", Decimal(1)), ("2.5", Decimal("2.5")), ("as required", None)])


def test_dates(spark):
    d = date(2025, 1, 5)
    good = ["05/01/2025", "05.01.2025", "05 01 2025", "5 Jan 25", "Jan 5, 2025", "05/01/2025, 10:30 a.m.", "05–01–2025", "2025-01-05", "5th January 2025", "5-Jan-2025"]
    assert of(spark, dates.normalize_date, good) == [d] * len(good)
    check(spark, dates.normalize_date, [("15-08-75", date(1975, 8, 15)), ("01-01-69", date(2069, 1, 1)), ("01-01-70", date(1970, 1, 1)), ("1 Sept 2024", date(2024, 9, 1))])
    bad = ["05/13/2025", "31/02/2025", "32/01/2025", "00/01/2025", "05-Xyz-2025", "2025", "05/2025", None, ""]
    assert of(spark, dates.normalize_date, bad) == [None] * len(bad)


def test_names_and_identifiers(spark):
    check(spark, text.normalize_name, [("Dr. Mrs. Kavitha  Rao", "kavitha rao"), ("B/O Lakshmi", "lakshmi"), ("Baby of Smt. Lakshmi", "lakshmi"), ("A.B.C. Naidu", "a b c naidu"), ("Mrudula Devi", "mrudula devi"), ("Mr.", None), (".", None), (None, None)])
    check(spark, text.normalize_org_name, [("Dr. Rao's Nursing Home", "dr. rao's nursing home"), ("  Apollo Hospitals Ltd.  ", "apollo hospitals ltd"), ("  ...  ", None)])
    check(spark, text.normalize_identifier, [("POL-1234 5678", "POL12345678"), ("12)", "12"), ("---", None)])
    check(spark, text.mask, [("abcdefg", "ab***fg"), ("abc", "***"), (None, None)])


def test_vocabularies(spark):
    check(spark, labels.normalize_age, [("45Y/M", 45), ("45", 45), ("6 months", 0), ("6M", 0), ("3 weeks", 0), ("10 days", 0), ("adult", None)])
    check(spark, labels.normalize_sex, [("M", "male"), ("MALE", "male"), ("Transgender", "other"), ("M/F", None), ("x", None)])
    check(spark, labels.normalize_ward_type, [("Semi-Private", "semi_private"), ("Twin Sharing", "semi_private"), ("Single Room", "private"), ("ICCU", "iccu"), ("Casualty", "emergency"), ("Zzz Block 4", "other"), (None, None)])
    check(spark, labels.normalize_category, [("Bed Charges", "room_rent"), ("X-Ray Chest PA", "radiology"), ("Surgeon Fee - OT", "surgery"), ("Attendant Charges", "non_medical"), ("Zzzz", "other")])
    check(spark, labels.normalize_bool, [("Payable", True), ("Admissible", True), ("1", True), ("Non-Payable", False), ("Deducted", False), ("maybe", None), ("?", None)])


def test_gstin(spark):
    check(spark, gstin.is_valid_gstin, [("27AAPFU0939F1ZV", True), ("29AAGCB7383J1Z4", True), ("27AAPFU0939F1ZX", False), ("27AAPFU0939F1AV", False), ("27AAPFU0939F1Z", False), (None, False)])


def test_unicode(spark):
    check(spark, text.nfkc, [("ｆｕｌｌ", "full"), ("plain", "plain"), (None, None)])
    check(spark, text.nfkc_casefold, [("Straße", "strasse")])
    check(spark, money.normalize_amount, [("１,２３４.００", Decimal(1234)), ("₨ 500", Decimal(500)), ("(₹ 2,500.00)", Decimal(-2500))])
    check(spark, text.normalize_text, [("Straße  ﬁle", "strasse file"), ("Cafe\u0301", "café"), ("రోగి", "రోగి"), (None, None)])
    check(spark, text.normalize_name, [("Ｄｒ. Ｒａｏ", "rao")])
    check(spark, text.normalize_org_name, [("ＡＰＯＬＬＯ ﬂoor.", "apollo floor")])
    check(spark, text.normalize_identifier, [("ＰＯＬ-１２", "POL12"), ("№ 5", "NO5")])
    check(spark, dates.normalize_date, [("０５/０１/２０２５", date(2025, 1, 5))])
    inside = spark.createDataFrame([(["ﬁ", "x", None],)], "v array<string>").select(F.transform("v", text.normalize_text).alias("v")).first()["v"]
    assert inside == ["fi", "x", None]


def test_printing(spark):
    check(spark, money.indian_grouping, [("1234567", "12,34,567"), ("123", "123"), ("1234", "1,234"), ("123456", "1,23,456")])
    row = spark.range(1).select(money.round_money(F.lit(Decimal("-2.345"))).alias("a"), money.round_half_even(F.lit(Decimal("2.345"))).alias("b"), money.format_amount(F.lit(Decimal("-1234.50")), "Rs. ").alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (Decimal("-2.35"), Decimal("2.34"), "(Rs. 1,234.50)")


def test_codec(spark):
    check(spark, lambda c: codec.unescape_value(codec.escape_value(c)), [("a < b & c > d &lt;", "a < b & c > d &lt;")])
    cut = "<s_line_items><s_description>A</s_description><s_amount>1</s_amount><sep/><s_description>B</s_description><s_amount>2</s_amount><s_qua"
    rows = of(spark, codec.parse_head_b, [cut, "<s_line_items></s_line_items>", None])
    assert [(r["description"], r["amount"]) for r in rows[0]] == [("A", "1"), ("B", "2")] and rows[1:] == [[], []]
    empty = spark.range(1).select(codec.render_head_b(F.array().cast(RAW_SCHEMA["line_items"].dataType)).alias("r")).first()["r"]
    assert empty == "<s_line_items></s_line_items>"
    check(spark, codec.has_repetition_loop, [("abcd abcd abcd abcd", True), ("one two three", False)])


def test_schema():
    assert len(FIELD_PATHS) == 27 and len(LINE_ITEM_FIELDS) == 10 and len(MONEY_FIELD_PATHS) == 7 and len(DATE_FIELD_PATHS) == 2 and len(CATEGORIES) == 12
    assert RAW_SCHEMA.fieldNames() == TYPED_SCHEMA.fieldNames()
    tokens = special_tokens()
    assert len(tokens) == len(set(tokens)) and tokens[-1] == "<sep/>" and "<s_uhid>" in tokens


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(a, b):
    assert similarity.lcs_length(a, b) == _lcs(a, b)


@given(st.lists(st.lists(st.integers(0, 5), min_size=3, max_size=3), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_assignment_is_cheapest(rows):
    import itertools

    import numpy as np

    cost = np.array(rows, float)
    n, m = cost.shape
    best = min(sum(cost[i, j] for i, j in zip(r, c)) for r in itertools.combinations(range(n), min(n, m)) for c in itertools.permutations(range(m), min(n, m)))
    found = similarity.assign(cost)
    assert len(found) == min(n, m) and len({j for _, j in found}) == len(found) and sum(cost[i, j] for i, j in found) == pytest.approx(best)


def test_partial_ratio():
    assert similarity.partial_ratio("admission date", "admission") == 100 and round(similarity.ratio("admission date", "admission")) == 78


def test_trees():
    r = lambda *c: ("r", c)
    y = ("y", (("y1", ()), ("y2", ())))
    assert similarity.tree_edit_distance(r(("x", ()), y), r(("x", ()))) == 3
    assert similarity.tree_edit_distance(None, r(y)) == 4
    a, b = similarity.tree({"a": [1, 2], "b": None}), similarity.tree({"a": [2, 1]})
    assert a == b and similarity.tree_accuracy(a, b) == 1.0 and similarity.tree_accuracy(None, None) == 1.0


def test_distances_of_alike_shapes_are_remembered():
    """labels only count by which are the same, so one answer serves all bills that differ in the same places."""
    bill = lambda claim, gross: similarity.tree({"insurance": {"claim_number": claim}, "totals": {"gross_amount": gross}})
    similarity._remembered_distance.cache_clear()
    got = [similarity.tree_edit_distance(bill(f"C{i}", f"{i}.50"), bill(f"C{i}", f"{i}.05")) for i in range(100)]
    assert got == [1] * 100 and similarity._remembered_distance.cache_info().misses == 1
    assert similarity.tree_edit_distance(bill("C1", "C1"), bill("C2", "C1")) == 1 and similarity.tree_edit_distance(bill("C1", None), bill("C1", "5")) == 3
