"""What costs must not grow with: work and bytes that went with more than the input before."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from claimweave.functions import money, similarity
from claimweave.operators import adjudicate, distant, extract, needles
from claimweave.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grams_of_a_long_line_are_one_walk(spark):
    """A line of 400,000 letters: each gram was counted out from the line's beginning before."""
    rng = random.Random(1)
    line = "".join(rng.choice("abcdé😀") for _ in range(400_000)) + "needlework"
    texts, wanted = spark.createDataFrame([(line,)], "text string"), spark.createDataFrame([("needlework",), ("é😀needle",), ("zzzz",)], "needle string")
    began = time.time()
    got = {r["needle"] for r in needles.holding(texts, wanted).collect()}
    assert got == {n for n in ("needlework", "é😀needle", "zzzz") if n in line} and time.time() - began < 30


def test_errors_are_tried_without_dealing_lines_again(spark):
    rng = random.Random(2)
    kinds = ["room_rent", "pharmacy", "nursing", None]
    rows = [(i // 4, i % 4, rng.choice(["Room", "anvil", None, "red plate"]), rng.choice(kinds), rng.choice([1.0, 2.0, 0.0, None]), rng.choice([None, None, 9000.0, 3333.33]), rng.choice([10000.0, 57.05, 0.0, None, 123456.78])) for i in range(240)]
    lines = spark.createDataFrame(rows, "doc_id int, line_index int, description string, category string, quantity double, unit_rate double, amount double")
    for c in ("quantity", "unit_rate", "amount"):
        lines = lines.withColumn(c, F.col(c).cast("decimal(18,2)"))
    claims = lines.select("doc_id").distinct().withColumn("ward_type", F.when(F.col("doc_id") % 3 == 0, "icu"))
    rules = [adjudicate.Rule("R", "c", "r", ("plate",), "pharmacy")]
    policy = adjudicate.Policy(sum_insured="150000", sub_limits=(adjudicate.SubLimit("anvil", "40000"),), deductible="500", proportionate=("room_rent", "nursing"))
    relatives = ("-0.10", "0", "0.01", "0.10")
    for order in (adjudicate.STAGES, ("room_rent_cap", "non_payable", "co_pay", "deductible"), ("sub_limits",)):
        p = policy.with_(order=order)
        for category, rate in (("room_rent", True), ("room_rent", False), ("pharmacy", False), (None, False)):
            found = adjudicate._payables(lines, claims, {"x": (category, rate)}, rules, p, relatives).drop("perturbation")
            want = adjudicate._payables_by_line(lines, claims, category, rules, p, rate, relatives)
            assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    both = adjudicate.sensitivity_table(lines, claims, rules, policy)
    assert "relative" not in "".join(x for x in plan_of(both).splitlines() if "Exchange hashpartitioning" in x and "doc_id" in x) and plan_of(both).count("Exchange hashpartitioning(doc_id") <= 4


def test_small_tables_are_assigned_as_large_ones_and_quickly():
    rng = random.Random(3)
    for _ in range(2000):
        n, m = rng.randrange(1, 7), rng.randrange(1, 7)
        cost = [[rng.choice([0, 0.25, 1 / 3, 1, rng.random()]) for _ in range(m)] for _ in range(n)]
        assert similarity.assign(cost) == similarity.assign_wide(np.array(cost, float))
    names = [f"{a} {b}" for a in ("red", "hot", "large", "small") for b in ("ring", "plate", "gizmo", "anvil")]
    began = time.perf_counter()
    for _ in range(10_000):
        bill = rng.choices(names, k=4)
        similarity.best_row_pairs(bill[1:], bill, 0.6)
    assert time.perf_counter() - began < 2  # 4 s before


def test_bills_are_read_by_their_letters_first():
    """Values that no alias is like cost no row of likeness: 10 ms a bill before."""
    fields, headings = extract.Names(extract.ALIASES), extract.Names(extract.COLUMNS)
    bill = lambda i: f"City Hospital\nPatient Name : P{i}   UHID : U{i}\nAge / Sex : 45 / M\n1  red plate   3  10.00  {i}.25\n2  hot gizmo   1  10.00  {i}.50\nGross Amount : {i}.75\n"
    began = time.perf_counter()
    for i in range(1000, 2000):
        got = extract.read_bill(bill(i), fields, headings)
        assert got["patient"]["uhid"] == f"U{i}" and got["totals"]["gross_amount"] == f"{i}.75" and [r["amount"] for r in got["line_items"]] == [f"{i}.25", f"{i}.50"]
    assert time.perf_counter() - began < 3
    rng = random.Random(4)
    for names in (fields, headings):
        for _ in range(3000):
            label = "".join(rng.choice("gros amunt/.#19xé") for _ in range(rng.randrange(1, 14)))
            for floor in (extract.COLUMN_FLOOR, extract.LABEL_FLOOR, extract.LABEL_AS_VALUE):
                assert (names.reached(label, floor) is not None) == (names.best(label)[1] >= floor)


def test_tokens_are_dealt_by_page_once(spark):
    words = spark.createDataFrame([(p, i, w) for p in range(3) for i, w in enumerate(["a", "b", "a", "b", "c"])], "page_id int, idx int, text string")
    values = spark.createDataFrame([(p, "patient.name", "a b c") for p in range(2)] + [(0, "hospital.city", "b")], "page_id int, path string, value string")
    made = distant.label_tokens(words, values)
    want = ["O", "B-hospital.city", "B-patient.name", "I-patient.name", "I-patient.name"]
    assert [r["label"] for r in made.where("page_id = 0").orderBy("idx").collect()] == want
    assert plan_of(made).count("Exchange hashpartitioning") <= 2  # tokens and values, each once
    pages = words.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda t: t["text"]).alias("words"))
    pages = pages.join(values.groupBy("page_id").agg(F.collect_list(F.struct("path", "value")).alias("values")), "page_id")
    assert sorted(map(tuple, distant.label_pages(pages).collect())) == sorted(map(tuple, made.where("label <> 'O'").select("page_id", "idx", "label").collect()))


def test_rows_run_a_pattern_once_and_long_rule_tables_are_lists(spark):
    lines = ["1  Tea: hot   2  10.00  20.00", "2. Food tray   Rs. 5/-", " 3  Bed   01/02/2024  1  1,000.00  1,000.00", "Gross Amount : 5", "4  Net total   5", "7 none", ""]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    whole, some = (df.select(extract.extract_rows(extract.printed_lines(F.col("text")), w).alias("r")) for w in (None, ("description", "amount")))
    got = [(r["serial_no"], r["description"], r["service_date"], r["quantity"], r["unit_rate"], r["amount"], r["category"], r["is_payable"]) for r in whole.first()["r"]]
    assert got == [("1", "Tea: hot", None, "2", "10.00", "20.00", None, "Y"), ("2", "Food tray", None, None, None, "Rs. 5/-", "non_medical", "N"), ("3", "Bed", "01/02/2024", "1", "1,000.00", "1,000.00", None, "Y")]
    assert [{k: v for k, v in r.asDict().items() if v is not None} for r in some.first()["r"]] == [{"description": d, "amount": a} for _, d, *_, a, _, _ in got]
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 0  # each field ran its pattern again before
    rules = [adjudicate.Rule(f"R{i}", "c", "r", (f"needle{i}", f"x{i}y"), "pharmacy" if i == 3 else None) for i in range(30)] + [adjudicate.Rule("LONG", "c", "r", ("a needle7 b",))]
    said = spark.createDataFrame([("A NEEDLE7 b", "q"), ("needle12", "q"), ("x4y needle5", "q"), ("", "pharmacy"), (None, "pharmacy"), ("zzz", "pharmacy")], "d string, c string")
    found = said.select(adjudicate.match_rule(F.col("d"), F.col("c"), rules).alias("r"))
    assert [r["r"] for r in found.collect()] == ["LONG", "R12", "R5", "R3", "R3", None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 2


def test_headers_are_assembled_without_keys_of_rows(spark):
    df = registry.queries()["header_conflicts"](spark, "/root/testdata/sf0.001")
    assert "decimal(38,6)" not in df._jdf.queryExecution().optimizedPlan().toString()  # amounts of rows were read before
    said = spark.createDataFrame([(v,) for v in ("12", "12.50", " 12", "1.", ".5", "nil", "(3)", "9" * 40, "12\n", "x", "", None)], "a string")
    got = [r[0] if r[0] is None else float(r[0]) for r in said.select(money.normalize_amount(F.col("a"))).collect()]
    assert got == [12, 12.5, 12, 1, 0.5, 0, -3, None, 12, None, None, None]


def test_deductions_run_the_stages_once(spark):
    """a claim's own deductions go with one of its rows, whatever its line indexes are, and not by a second run of the stages."""
    from claimweave.operators import adjudicate

    rows = [(c, i, "Room", "room_rent", 1.0, None, 900.0) for c in (1, 2, None) for i in (0, 0, None)]
    lines = spark.createDataFrame(rows, "doc_id int, line_index int, description string, category string, quantity double, unit_rate double, amount double")
    for c in ("quantity", "unit_rate", "amount"):
        lines = lines.withColumn(c, lines[c].cast("decimal(18,2)"))
    policy = adjudicate.Policy(deductible="100")
    staged = adjudicate.waterfall(lines, None, [], policy)
    found = adjudicate.deductions(staged, [], policy)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(r["doc_id"]), r["rule_id"], str(r["amount"])) for r in found.collect()) == [(d, i, a) for d in ("1", "2", "None") for i, a in (("CO_PAY", "260.00"), ("DEDUCTIBLE", "100.00"))]
    short = adjudicate.by_rule(adjudicate.deductions(staged, [], policy, grounds=False))
    assert sorted(map(str, short.collect())) == sorted(map(str, adjudicate.by_rule(found).collect()))


def test_lines_of_bills_are_read_by_their_form_once(spark, monkeypatch):
    """each line of each bill was taken apart for itself, and documents went through JSON."""
    rng = random.Random(5)
    item = lambda j: f"{j + 1}  {rng.choice(['red plate', 'hot gizmo', 'Food tray'])}   {rng.randrange(1, 51)}  10.00  {rng.randrange(100, 10**5)}.{rng.randrange(100):02d}"
    bills = [f"City Hospital\nPatient Name : P{i}   UHID : U{i}\nAge / Sex : 45 / M\n" + "\n".join(map(item, range(rng.randrange(1, 8)))) + f"\nGross Amount : {i}.75\n" for i in range(20_000)]
    reader = extract.Reader(extract.Names(extract.ALIASES), extract.Names(extract.COLUMNS))
    began = time.perf_counter()
    made = [reader.documents(bills[i : i + 1000]) for i in range(0, len(bills), 1000)]
    assert time.perf_counter() - began < 5  # 10 s before
    assert len(reader.lines) < 100 and [d["totals"]["gross_amount"] for d in made[-1].to_pylist()] == [f"{i}.75" for i in range(19_000, 20_000)]
    assert not any(c.isdigit() for names in (extract.ALIASES, extract.COLUMNS) for aliases in names.values() for a in aliases for c in a)
    odd = [
        None, "", "\r\n", "Description | Qty | Rate | Amount\nTea | 2 | 5.00 | 10.00\n|  | 1 | 2\nFood | | | 7\nTotal | | | 17", "7  Bed 01/02/2024 by x3 @5 window  = 15.00  4\nS.No  Particulars  Amount\n1  Lab  5",
        "ABC\nABC HOSPITALS / Clinic\nUHID No\t: 12:\nAge/Sex  61 / F\nGST 27AAPFU0939F1ZV x", "P\u0661 \u0663\u0664 5 6", "Net Payable : 5   Net : 6\rNet Amount : 7",
    ]
    got = reader.documents(odd).to_pylist()
    lines = [[[i[n] for n in ("serial_no", "description", "service_date", "quantity", "unit_rate", "amount", "is_payable")] for i in d["line_items"]] for d in got]
    assert lines == [[], [], [], [[None, "Tea", None, "2", "5.00", "10.00", "Y"], [None, "Food", None, None, None, "7", "N"]], [["1", "Lab", None, None, None, "5", "Y"]], [], [[None, "P١", None, "٣٤", "5", "6", "Y"]], []]
    assert [{f"{b}.{n}": v for b in d if b != "line_items" for n, v in d[b].items() if v is not None} for d in got] == [{}, {}, {}, {"hospital.name": "Description | Qty | Rate | Amount", "totals.gross_amount": "| | | 17", "totals.net_amount": "| | | 17"}, {"hospital.name": "2024 by x3 @5 window  = 15.00  4", "patient.ward_type": "01/02/2024 by x3 @5 window"}, {"hospital.name": "Clinic", "hospital.gstin": "27AAPFU0939F1ZV", "patient.age": "61 / F", "patient.sex": "F", "patient.uhid": "12", "patient.ip_number": "12", "totals.cgst": "27AAPFU0939F1ZV x", "totals.sgst": "27AAPFU0939F1ZV x"}, {"hospital.name": "P١ ٣٤ 5 6"}, {"totals.gross_amount": "7", "totals.net_amount": "5"}]
    assert [extract.read_bill(t, reader.fields, reader.headings) for t in odd] == [d | {"line_items": [{n: i[n] for n in (*extract.COLUMNS, "is_payable", "deduction_reason")} for i in d["line_items"]]} for d in got]
    # What is remembered doesn't show, also where it is forgotten or a line is too long for it.
    for name, value in (("REMEMBERED", 3), ("SHORT_LINE", 0)):
        monkeypatch.setattr(extract, name, value)
        fresh = extract.Reader(reader.fields, reader.headings)
        assert fresh.documents(odd + bills[:300]).to_pylist() == got + made[0][:300].to_pylist() and len(fresh.lines) <= 3
    read = extract.extract_heuristic(spark.createDataFrame([(t,) for t in odd], "text string").coalesce(1))
    assert [r["document"].asDict(True) for r in read.collect()] == got and "from_json" not in plan_of(read)
    assert extract.extract_heuristic(read.select("text").where("text = 'none'")).collect() == []


def test_lines_are_dealt_to_their_bills_once(spark):
    """lines were sorted and numbered in one deal by order, and gathered in another."""
    from claimweave.plans import records

    made = records._bills(spark, "/root/testdata/sf0.001")
    plan = plan_of(made)
    assert "Window" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") + plan.count("Exchange hashpartitioning(doc_id") == 1
    items = records.td.line_items(spark, "/root/testdata/sf0.001").where("doc_id % 50 = 0").orderBy("doc_id", "line_index").collect()
    want = {}
    for r in items:
        want.setdefault(r["doc_id"], []).append(f"{r['line_index'] + 1}  {r['description']}   {int(r['quantity'])}  10.00  {r['amount']}")
    got = {r["doc_id"]: r["text"].split("\n")[5:-2] for r in made.where("doc_id % 50 = 0").collect()}
    assert got == want and len(got) > 10
