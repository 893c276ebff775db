"""Operators against worked cases."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimweave.operators import adjudicate as adj
from claimweave.operators import adjudicate_json, assemble, evaluate, extract, generate, images, redact, sampling, spans, taxonomy
from claimweave.schema import RAW_SCHEMA
from claimweave.sources import manifest
from claimweave.sources.rules import load_policy, load_rules

LINES = "doc_id int, line_index int, description string, category string, quantity decimal(18,4), unit_rate decimal(18,2), amount decimal(18,2)"


def bill(spark, *items, ward="private", **policy):
    rows = [(1, i, d, c, None, Decimal(r) if r else None, Decimal(a)) for i, (d, a, c, r) in enumerate(items)]
    claims = spark.createDataFrame([(1, ward)], "doc_id int, ward_type string")
    terms, rules = load_policy(**policy), load_rules()
    rows = adj.waterfall(spark.createDataFrame(rows, LINES), claims, rules, terms)
    return adj.claims_of(rows).first().asDict(), {(r["rule_id"], r["amount"]) for r in adj.deductions(rows, rules, terms).collect()}


def test_worked_claims(spark):
    room, nursing, surgeon = ("Room", "10000", "room_rent", "10000"), ("Nursing", "2000", "nursing", None), ("Surgeon", "50000", "surgery", None)
    got, _ = bill(spark, room, nursing, ("Attendant", "800", "non_medical", None), surgeon, co_pay_percent="0")
    assert (got["payable"], got["gross"], got["gross"] - got["payable"]) == (3100000, 6280000, 3180000)
    got, _ = bill(spark, room, nursing, surgeon, ("Paracetamol", "500", "pharmacy", None), co_pay_percent="0")
    assert got["payable"] == 3150000
    got, taken = bill(spark, ("Cataract Surgery (Phaco)", "60000", "surgery", None), co_pay_percent="0")
    assert got["payable"] == 4000000 and taken == {("SUB_LIMIT", Decimal("20000.00"))}
    got, taken = bill(spark, ("Consultant", "1000", "professional_fees", None), ("Attendant", "1000", "non_medical", None))
    assert got["payable"] == 90000 and ("CO_PAY", Decimal("100.00")) in taken
    assert bill(spark, ("Room", "4000", "room_rent", "4000"), nursing, co_pay_percent="0")[0]["payable"] == 600000
    costly = ("Room", "9000", "room_rent", "9000")
    assert bill(spark, costly, ward="icu")[0]["payable"] > bill(spark, costly)[0]["payable"]


def test_order_of_own_deductions(spark):
    item = ("Consultant", "10000", "professional_fees", None)
    first = bill(spark, item, deductible="2000")[0]["payable"]
    swapped = bill(spark, item, deductible="2000", order=("non_payable", "sub_limits", "room_rent_cap", "co_pay", "deductible"))[0]["payable"]
    assert (first, swapped) == (720000, 700000)
    with pytest.raises(ValueError):
        load_policy(order=("no_such_stage",))


def test_longest_needle_is_credited(spark):
    names = ["Food & Beverages (attendant)", "Nebuliser Kit", "Oxygen Charges", "Surgeon Fee", "", None]
    df = spark.createDataFrame([(n, "administrative") for n in names], "d string, c string")
    got = [r[0] for r in df.select(adj.match_rule(F.col("d"), F.col("c"), load_rules())).collect()]
    assert got == ["LIST_I_FOOD_BEVERAGE", None, None, None, "LIST_I_ADMIN_RECORDS", "LIST_I_ADMIN_RECORDS"]


def test_json_in_json_out(spark):
    items = [{"description": "Room", "category": "room_rent", "unit_rate": "10,000", "amount": "Rs. 10,000.00"}, {"description": "Attendant", "category": "non_medical", "amount": "800"}, {"description": "Surgeon", "category": "surgery", "amount": "５０,０００"}]
    bills = [json.dumps({"patient": {"ward_type": "Private"}, "line_items": items}), json.dumps({"line_items": []}), "no json", json.dumps({"extra": 1}), None]
    requests = spark.createDataFrame(list(enumerate(bills)), "doc_id int, document string")
    got = {r["doc_id"]: r for r in adjudicate_json.adjudicate_json(requests, load_rules(), load_policy(), co_pay_percent=0, sum_insured=None).collect()}
    one = json.loads(got[0]["result"])
    assert (one["gross"], one["payable"], one["total_deducted"], one["notes"]) == ("60800.00", "30000.00", "30800.00", [])
    assert [(d["rule_id"], d["line_index"], d["line_description"]) for d in one["deductions"]] == [(one["deductions"][0]["rule_id"], 1, "attendant"), ("ROOM_RENT_CAP", 0, "room"), ("ROOM_RENT_CAP", 2, "surgeon")]
    assert sum(map(Decimal, one["by_rule"].values())) == Decimal("30800.00") and one["by_rule"]["ROOM_RENT_CAP"] == "30000.00"
    trail = one["audit_trail"].split("\n")
    assert trail[0] == "Gross considered: 60800.00" and trail[-1] == "Net payable: 30000.00" and trail[1].startswith("  -800.00  ") and trail[1].endswith(" [row 2: attendant]")
    nothing = json.loads(got[1]["result"])
    assert (nothing["gross"], nothing["payable"], nothing["deductions"], nothing["by_rule"]) == ("0.00", "0.00", [], {})
    assert [(got[i]["result"], got[i]["error"]) for i in (2, 3, 4)] == [(None, "not a JSON object"), (None, "unknown blocks"), (None, "not a JSON object")]
    with pytest.raises(ValueError):
        adjudicate_json.adjudicate_json(requests, load_rules(), load_policy(), order="x")


def raw(**given):
    out = {f.name: None if f.name != "line_items" else [] for f in RAW_SCHEMA}
    return out | given


FRAGMENT = "doc_id int, page_index int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_SCHEMA)


def pages(spark, *found):
    def item(x):
        return dict.fromkeys(RAW_SCHEMA["line_items"].dataType.elementType.fieldNames()) | x

    rows = []
    for i, p in enumerate(found):
        p = raw(**p)
        rows.append((1, i, *(([item(x) for x in p["line_items"]] if f.name == "line_items" else p[f.name] and dict.fromkeys(f.dataType.fieldNames()) | p[f.name]) for f in RAW_SCHEMA)))
    return assemble.reconcile(assemble.assemble(spark.createDataFrame(rows, FRAGMENT))).first()


def test_reprinted_rows(spark):
    a, b, c = ({"description": d, "amount": x} for d, x in (("Nursing", "800"), ("Room", "3500"), ("Pharmacy", "120")))
    got = pages(spark, {"line_items": [a, b]}, {"line_items": [{"description": "ROOM ", "amount": "3,500.00", "serial_no": "1"}, c]})
    assert [i["description"] for i in got["document"]["line_items"]] == ["Nursing", "Room", "Pharmacy"]
    twice = {"description": "Ondansetron", "amount": "85"}
    assert pages(spark, {"line_items": [twice, twice]})["n_rows"] == 2
    # A whole page reprinted, then one that repeats what is still the tail.
    assert pages(spark, {"line_items": [a, b]}, {"line_items": [a, b]}, {"line_items": [b, c]})["n_rows"] == 3


def test_reconciliation(spark):
    items = [{"description": "x", "amount": "100"}, {"description": "y", "amount": "200"}]
    got = pages(spark, {"line_items": items, "totals": {"gross_amount": "500.00", "net_amount": "500.00"}})
    assert got["gross_delta"] == Decimal("-200.00") and not got["balanced"] and "hospital" in got["missing_blocks"]
    assert pages(spark, {"line_items": [{"description": "x", "quantity": "2", "unit_rate": "100", "amount": "250"}]})["row_failures"] == 1
    got = pages(spark, {"patient": {"name": "Ramesh Kumar"}}, {"patient": {"name": "Suresh Babu"}})
    assert got["conflicts"] == ["patient.name"] and not got["complete"]


def test_line_matching(spark):
    df = spark.createDataFrame([(1, ["room rent - deluxe", "ambulance charges"], ["mri brain contrast", "room rent deluxe"]), (2, None, ["x"])], "doc_id int, pred_items array<string>, truth_items array<string>")
    assert [(r["pred_index"], r["truth_index"]) for r in evaluate.matched_items(df).collect()] == [(0, 1)]


def test_taxonomy(spark):
    rows = [("totals.net_amount", "1568.00", "1668.00", False, "digit_confusion"), ("totals.net_amount", "1,23,456.00", "12345.60", False, "magnitude_error"), ("patient.admission_date", "05/01/2025", "05|01|2O25", False, "date_unparsed"),
            ("patient.name", "Ramesh", "UH1", True, "wrong_field"), ("patient.name", None, "x", False, "hallucinated_field"), ("patient.name", "x", None, False, "missed_field"), ("patient.name", "a", "a", False, None)]
    df = spark.createDataFrame([(*r[:4], r[1], r[2] and r[2] + "~") for r in rows], "p string, t string, q string, e boolean, nt string, nq string")
    got = [r[0] for r in df.select(taxonomy.classify(*(F.col(c) for c in ("p", "t", "q", "nt", "nq", "e")))).collect()]
    assert got == [r[4] for r in rows]


def test_surrogates(spark):
    key = redact.RedactionKey(bytes(range(64)))
    values = ["Ramesh Kumar", "9876543210", "", None, "a-b/C 1"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", redact.surrogate(F.col("v"), key, "k").alias("b")).collect()
    assert all(r["b"] == redact.surrogate_text(v, key.material, "k") for r, v in zip(got, values))
    said = "call 9876543210 or a@b.co, PAN ABCDE1234F"
    row = spark.createDataFrame([(said,)], "t string").select(redact.redact_text(F.col("t"), key).alias("r")).first()["r"]
    assert len(row["text"]) == len(said) and (row["phone"], row["pan"]) == (1, 1) and "9876543210" not in row["text"]
    with pytest.raises(ValueError):
        redact.RedactionKey(b"short")


def test_redacted_documents(spark, tmp_path):
    key = redact.RedactionKey(b"k" * 40)
    docs = generate.documents(spark, 6).select("doc_id", F.col("truth").alias("document"), F.lit(1).alias("kept"))
    item = F.transform("document.line_items", lambda i: i.withField("description", F.concat(i["description"], F.lit(" for 9876543210"))))
    docs = docs.withColumn("document", F.col("document").withField("line_items", item))
    docs = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit("none"), "document": F.lit(None).cast(docs.schema["document"].dataType)}))
    out = redact.redact_documents(docs, key, extra_fields=("hospital.city", "patient.name"), consent="c-1").persist()
    assert out.columns == ["doc_id", "document", "kept", "record"]
    before = {r["doc_id"]: r["document"] for r in docs.collect()}
    for r in out.where("doc_id <> 'none'").collect():
        old, new, record = before[r["doc_id"]], r["document"], r["record"]
        assert new["patient"]["name"] != old["patient"]["name"] and len(new["patient"]["name"]) == len(old["patient"]["name"]) and new["hospital"]["city"] != old["hospital"]["city"]
        assert new["hospital"]["name"] == old["hospital"]["name"] and new["totals"] == old["totals"] and not any("9876543210" in i["description"] for i in new["line_items"])
        assert record["text_patterns"] == {"phone": len(old["line_items"])} and ("patient.uhid" in record["fields_redacted"]) == bool(old["patient"]["uhid"])
        assert "hospital.city" in record["fields_redacted"] and record["key_fingerprint"] == key.fingerprint and record["consent_reference"] == "c-1"
    (none,) = out.where("doc_id = 'none'").collect()
    assert none["document"] is None and none["record"]["fields_redacted"] == [] and none["record"]["text_patterns"] == {}
    manifest.append_records(out.select("record.*"), f"{tmp_path}/log")
    assert spark.read.schema(manifest.REDACTION).json(f"{tmp_path}/log").where("document_id = 'DOC-00000001'").count() == 1
    with pytest.raises(ValueError):
        redact.redact_documents(docs, key, extra_fields=("patient.shoe",))
    out.unpersist()


def test_allow_list(spark, tmp_path):
    (tmp_path / "allow").write_text("# none\ndocs/  # all of them\n\ntests/data//\n")
    prefixes = redact.read_allowlist(spark, f"{tmp_path}/allow")
    assert {r["prefix"] for r in prefixes.collect()} == {"docs", "tests/data"} and redact.read_allowlist(spark, f"{tmp_path}/nowhere").count() == 0
    files = spark.createDataFrame([("docs/a.md",), ("docsy",), ("tests/data/x",)], "path string")
    assert {r["path"] for r in redact.allowed(files, prefixes).collect()} == {"docs/a.md", "tests/data/x"}


def test_scan(spark):
    df = spark.createDataFrame([(1, "amount 1,23,456.00\nphone 9876543210\n9876543211 pii-allow")], "id int, t string")
    assert [(r["line_no"], r["kind"]) for r in redact.scan_text(df, "id", "t").collect()] == [(2, "phone")]


BILL = """City Hospital
Patient Name : Ramesh Kumar   UHID : UH1
Age / Sex : 45 / M
S.No  Description   Qty  Rate  Amount
1  Room Rent   2  500.00  1,000.00
2  Attendant Charges   1  80.00  80.00
Gross Amount : 1,080.00
"""


def test_extractors(spark):
    df = spark.createDataFrame([(BILL,), (None,)], "text string")
    rules = df.select(extract.extract_rules(F.col("text")).alias("d")).collect()[0]["d"]
    fuzzy = extract.extract_heuristic(df).collect()[0]["document"]
    assert rules["patient"]["sex"] == "M"
    for d in (rules, fuzzy):
        assert d["patient"]["name"] == "Ramesh Kumar" and d["patient"]["uhid"] == "UH1" and d["patient"]["age"] == "45 / M" and d["totals"]["gross_amount"] == "1,080.00"
        assert [(i["description"], i["amount"], i["is_payable"]) for i in d["line_items"]] == [("Room Rent", "1,000.00", "Y"), ("Attendant Charges", "80.00", "N")]


def test_receipts():
    got = extract.parse_cord("<s_nm>Tea</s_nm><s_cnt>2</s_cnt><s_price>10</s_price><s_nm>Bun</s_price><s_total_price>20</s_total_price>")
    assert [r["description"] for r in got["line_items"]] == ["Tea", "Bun"] and got["totals"] == {"net_amount": "20"}


def test_spans(spark):
    rows = [(1, 0, "I-patient.name", "A"), (1, 1, "I-patient.name", "B"), (1, 2, "B-patient.name", "C"), (1, 3, "O", "x")]
    df = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0) for r in rows], "page_id int, idx int, label string, text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r["text"] for r in spans.decode_spans(df).collect()) == ["A B", "C"]
    found = [(1, "line_items.description", 0, "Room", 100.0), (1, "line_items.amount", 1, "3500", 100.0), (1, "line_items.description", 2, "Nursing", 140.0), (1, "line_items.amount", 3, "800", 140.0)]
    df = spark.createDataFrame([(p, n, s, t, 0.0, y, 1.0, y) for p, n, s, t, y in found], "page_id int, path string, start int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {(r["row"], r["attribute"], r["text"]) for r in spans.rows_by_band(df).collect()} == {(0, "description", "Room"), (0, "amount", "3500"), (1, "description", "Nursing"), (1, "amount", "800")}


def test_images():
    import numpy as np

    grey = np.full((40, 40), 230, np.uint8)
    grey[10:30:2] = 20
    assert images.ink_contrast(grey) == 210 and images.edge_energy(grey) > 200 and 20 <= images.otsu_threshold(grey) < 230


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0]) for i in range(50)], "i int, s string")
    got = sampling.stratified_sample(df, ["s"], 6, F.col("i")).collect()
    assert sorted(r["s"] for r in got) == ["a"] * 3 + ["b"] * 3
    a, b = (sampling.corpus_hash(df.orderBy(o).select(F.sha2(F.col("i").cast("string"), 256).alias("h")), "h").first()[0] for o in ("i", F.desc("i")))
    assert a == b


def test_deployment_sentence():
    assert "every document" in evaluate.deployment_sentence(None)
    assert "0.75" in evaluate.deployment_sentence({"threshold": 0.75, "accuracy": 0.96, "coverage": 0.6, "document_rate": 0.1})
