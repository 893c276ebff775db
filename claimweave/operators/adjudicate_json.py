"""Adjudication of documents written as JSON: a row in, a row out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RAW_SCHEMA, unknown_keys
from .adjudicate import Policy, Rule, claims_of, deductions, money, waterfall
from .documents import normalize_document

TERMS = ("sum_insured", "co_pay_percent", "deductible")


def adjudicate_json(requests: DataFrame, rules: list[Rule], policy: Policy, **terms) -> DataFrame:
    """(doc_id, result, error) for rows (doc_id, document), where a document is the JSON of a raw bill and ids are unique.

    The result is JSON: gross, payable, total_deducted, deductions, by_rule, notes and audit_trail, amounts as text.
    What is no JSON object, or has blocks that a bill doesn't have, gives an error and no result; a bill without lines
    is one of nothing. ``terms`` stand for the policy's own, where they aren't None.
    """
    if other := terms.keys() - set(TERMS):
        raise ValueError(f"terms that can't be changed: {', '.join(sorted(other))}")
    policy = policy.with_(**{k: str(v) for k, v in terms.items() if v is not None})
    text = F.col("document")
    fault = F.when(F.json_object_keys(text).isNull(), "not a JSON object").when(F.size(unknown_keys(text, RAW_SCHEMA)) > 0, "unknown blocks")
    read = requests.select("doc_id", fault.alias("error"), text.alias("json"))
    docs = read.select("doc_id", "error", F.when(F.col("error").isNull(), normalize_document(F.from_json("json", RAW_SCHEMA))).alias("bill"))
    lines = docs.select("doc_id", F.posexplode("bill.line_items").alias("line_index", "item")).select("doc_id", "line_index", "item.*")
    rows = waterfall(lines, docs.select("doc_id", "bill.patient.ward_type"), rules, policy)
    taken = deductions(rows, rules, policy).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("stage_no", "line_index", "rule_id", "clause", "reason", "amount"))).alias("taken"))
    noted = rows.groupBy("doc_id").agg(F.max("note").alias("note"))
    every = docs.join(claims_of(rows).select("doc_id", "gross", "payable"), "doc_id", "left").join(taken, "doc_id", "left").join(noted, "doc_id", "left")
    return every.select("doc_id", F.when(F.col("error").isNull(), F.to_json(_result(), {"ignoreNullFields": "false"})).alias("result"), "error")


def _result():
    """The struct that is written, from gross, payable (hundredths), taken, note and the bill."""
    described = lambda d: F.get(F.col("bill.line_items"), d["line_index"])["description"]
    taken = F.coalesce("taken", F.array().cast("array<struct<stage_no:int,line_index:int,rule_id:string,clause:string,reason:string,amount:decimal(18,2)>>"))
    gross, payable = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("gross", "payable"))
    plain = lambda c: money(c).cast("string")
    found = F.transform(taken, lambda d: F.struct(
        d["rule_id"].alias("rule_id"), d["clause"].alias("clause"), d["reason"].alias("reason"), d["amount"].cast("string").alias("amount"),
        d["line_index"].alias("line_index"), described(d).alias("line_description"),
    ))
    ids = F.array_distinct(F.transform(taken, lambda d: d["rule_id"]))
    zero = F.lit(0).cast("decimal(28,2)")
    of_rule = lambda i: F.aggregate(F.filter(taken, lambda d: d["rule_id"] == i), zero, lambda s, d: (s + d["amount"]).cast("decimal(28,2)")).cast("string")
    where = lambda d: F.when(d["line_index"].isNotNull(), F.concat(F.lit(" [row "), (d["line_index"] + 1).cast("string"), F.lit(": "), F.coalesce(described(d), F.lit("None")), F.lit("]"))).otherwise("")
    said = F.transform(taken, lambda d: F.concat(F.lit("  -"), d["amount"].cast("string"), F.lit("  "), d["rule_id"], F.lit(" ("), d["clause"], F.lit(")"), where(d), F.lit("\n      "), d["reason"]))
    trail = F.concat(F.array(F.concat(F.lit("Gross considered: "), plain(gross))), said, F.array(F.concat(F.lit("Net payable: "), plain(payable))))
    return F.struct(
        plain(gross).alias("gross"), plain(payable).alias("payable"), plain(gross - payable).alias("total_deducted"), found.alias("deductions"),
        F.map_from_arrays(ids, F.transform(ids, of_rule)).alias("by_rule"), F.array_compact(F.array("note")).alias("notes"), F.array_join(trail, "\n").alias("audit_trail"),
    )
