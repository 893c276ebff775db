"""Adjudication queries over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adjudicate as adj
from ..sources import testdata as td
from ..sources.rules import load_rules, needles
from .registry import query

RULES_SQL = """rules AS (SELECT * FROM (VALUES (1, 'R_PLATE', 'plate'), (2, 'R_RED', 'red plate'), (3, 'R_GIZMO', 'gizmo'), (4, 'R_HOT', 'hot gizmo')) t(ord, rule_id, needle)),
lim AS (SELECT * FROM (VALUES (1, 'anvil', 4000000), (2, 'large', 8000000)) t(ord, needle, cap)),
m AS (SELECT doc_id, line_index, arg_max(rule_id, length(needle) * 100 - ord) AS rule_id FROM items JOIN rules ON contains(lower(description), needle) GROUP BY ALL)"""


def waterfall_sql(deductible: int = 0, order: str = "dc") -> str:
    """CTEs up to ``g`` (a claim's sums) and ``p`` (with its own deductions), in hundredths."""
    take = {"d": f"least({deductible}, greatest(rest, 0))", "c": "CASE WHEN rest > 0 THEN (2 * rest * 10 + 100) // 200 ELSE 0 END"}
    first, second = order
    return f"""{td.ITEMS_SQL}, {RULES_SQL},
s1 AS (SELECT i.*, CASE WHEN c.icu THEN 300000 ELSE 150000 END AS cap, m.rule_id, CASE WHEN m.rule_id IS NULL THEN i.amt ELSE 0 END AS live1
  FROM items i LEFT JOIN m USING (doc_id, line_index) LEFT JOIN claims c USING (doc_id)),
l AS (SELECT doc_id, line_index, arg_min(lim.cap, lim.ord) AS lcap, arg_min(lim.needle, lim.ord) AS lneedle FROM items JOIN lim ON contains(lower(description), lim.needle) GROUP BY ALL),
s2 AS (SELECT s1.*, lcap, lneedle, CASE WHEN live1 > lcap THEN lcap ELSE live1 END AS live2 FROM s1 LEFT JOIN l USING (doc_id, line_index)),
room AS (SELECT doc_id, arg_min(amt, line_index) AS ramt, arg_min(qty, line_index) AS rqty FROM items WHERE category = 'room_rent' GROUP BY doc_id),
s3 AS (SELECT s2.*, ramt, rqty, CASE WHEN ramt > cap * rqty AND category IN ('room_rent', 'nursing', 'surgery') AND live2 > 0
    THEN (2 * live2::HUGEINT * cap * rqty + ramt) // (2 * ramt) ELSE live2 END::BIGINT AS live3 FROM s2 LEFT JOIN room USING (doc_id)),
g AS (SELECT doc_id, sum(amt)::BIGINT AS gross, sum(amt - live1)::BIGINT AS non_payable, sum(live1 - live2)::BIGINT AS sub_limits,
    sum(live2 - live3)::BIGINT AS room_rent, sum(live3)::BIGINT AS rest FROM s3 GROUP BY doc_id),
t1 AS (SELECT *, ({take[first]})::BIGINT AS took_{first}, rest AS rest_{first} FROM g),
t2 AS (SELECT * REPLACE (rest - took_{first} AS rest) FROM t1),
p AS (SELECT *, ({take[second]})::BIGINT AS took_{second}, rest AS rest_{second} FROM t2)"""


SUMMARY = "SELECT doc_id, gross, non_payable, sub_limits, room_rent, took_d AS deductible, took_c AS co_pay, rest_{last} - took_{last} AS payable FROM p"


def _waterfall(spark: SparkSession, sf_dir: str, policy: adj.Policy = td.POLICY) -> DataFrame:
    return adj.waterfall(td.line_items(spark, sf_dir), td.claims(spark, sf_dir), td.RULES, policy)


@query("adjudicate_claims", f"WITH {waterfall_sql()} " + SUMMARY.format(last="c"))
def adjudicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.claims_of(_waterfall(spark, sf_dir))


ORDERED = {
    "deductible_then_co_pay": (("non_payable", "sub_limits", "room_rent_cap", "deductible", "co_pay"), "dc"),
    "co_pay_then_deductible": (("non_payable", "sub_limits", "room_rent_cap", "co_pay", "deductible"), "cd"),
}
for _name, (_order, _code) in ORDERED.items():

    @query(_name, f"WITH {waterfall_sql(200000, _code)} " + SUMMARY.format(last=_code[1]))
    def _ordered(spark: SparkSession, sf_dir: str, order=_order) -> DataFrame:
        return adj.claims_of(_waterfall(spark, sf_dir, td.POLICY.with_(deductible="2000", order=order)))


DEDUCTIONS_SQL = f"""{waterfall_sql()}, ded AS (
  SELECT doc_id, 0 AS stage_no, line_index::INT AS line_index, rule_id,
    'clause ' || CASE rule_id WHEN 'R_PLATE' THEN '1' WHEN 'R_RED' THEN '2' WHEN 'R_GIZMO' THEN '3' ELSE '4' END AS clause,
    CASE rule_id WHEN 'R_PLATE' THEN 'plates' WHEN 'R_RED' THEN 'red plates' WHEN 'R_GIZMO' THEN 'gizmos' ELSE 'hot gizmos' END || ' are not covered' AS reason,
    amt - live1 AS took FROM s3 WHERE rule_id IS NOT NULL AND amt > 0
  UNION ALL SELECT doc_id, 1, line_index::INT, 'SUB_LIMIT', CASE lneedle WHEN 'anvil' THEN 'limit A' ELSE 'limit B' END,
    'Charge of ' || (amt / 100.0)::DECIMAL(18,2) || ' exceeds the policy sub-limit of ' || lcap // 100 || ' for ''' || lneedle || '''', live1 - live2 FROM s3 WHERE live1 > live2
  UNION ALL SELECT doc_id, 2, line_index::INT, 'ROOM_RENT_CAP', 'Policy schedule - room rent capping with proportionate deduction', NULL, live2 - live3 FROM s3 WHERE live2 > live3
  UNION ALL SELECT doc_id, 4, NULL, 'CO_PAY', 'Policy schedule - co-payment', 'Co-payment of 10.0% applied to the admissible amount of ' || (rest_c / 100.0)::DECIMAL(18,2), took_c FROM p WHERE took_c > 0)"""


def _deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.deductions(_waterfall(spark, sf_dir), td.RULES, td.POLICY)


@query("claim_deductions", f"WITH {DEDUCTIONS_SQL} SELECT doc_id, stage_no, line_index, rule_id, clause, reason, took AS hundredths FROM ded")
def claim_deductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("rule_id") != "ROOM_RENT_CAP", F.col("reason"))  # its factor is a rounded quotient
    return _deductions(spark, sf_dir).select("doc_id", "stage_no", "line_index", "rule_id", "clause", reason.alias("reason"), adj.cents(F.col("amount")).alias("hundredths"))


@query("deductions_by_rule", f"WITH {DEDUCTIONS_SQL} SELECT doc_id, rule_id, sum(took)::BIGINT AS hundredths FROM ded GROUP BY ALL")
def deductions_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.by_rule(adj.deductions(_waterfall(spark, sf_dir), td.RULES, td.POLICY, grounds=False)).select("doc_id", "rule_id", adj.cents(F.col("amount")).alias("hundredths"))


@query(
    "claim_audit_trail",
    f"""WITH {DEDUCTIONS_SQL} SELECT doc_id, string_agg('[' || rule_id || '] ' || (took / 100.0)::DECIMAL(18,2) || ': ' || reason || ' (' || clause || ')', chr(10)
    ORDER BY stage_no, line_index) AS trail FROM ded WHERE rule_id <> 'ROOM_RENT_CAP' GROUP BY doc_id""",
)
def claim_audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.explain(_deductions(spark, sf_dir).where("rule_id <> 'ROOM_RENT_CAP'"))


MATCH_SQL = f"WITH {td.ITEMS_SQL}, {RULES_SQL} SELECT doc_id, line_index, rule_id FROM m"


@query("rule_match_compiled", MATCH_SQL)
def rule_match_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = td.line_items(spark, sf_dir)
    return lines.select("doc_id", "line_index", adj.match_rule(F.col("description"), F.col("category"), td.RULES).alias("rule_id")).where("rule_id is not null")


@query("rule_match_joined", MATCH_SQL)
def rule_match_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.match_rule_joined(td.line_items(spark, sf_dir), needles(spark, td.RULES))


@query(
    "category_hint_fallback",
    f"""WITH {td.ITEMS_SQL}, {RULES_SQL} SELECT doc_id, line_index, CASE WHEN part % 97 = 0 THEN
    CASE category WHEN 'consumables' THEN 'R_PLATE' WHEN 'non_medical' THEN 'R_RED' END ELSE rule_id END AS rule_id
    FROM items LEFT JOIN m USING (doc_id, line_index)""",
)
def category_hint_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = td.line_items(spark, sf_dir).withColumn("description", F.when(F.col("part") % 97 != 0, F.col("description")))
    return lines.select("doc_id", "line_index", adj.match_rule(F.col("description"), F.col("category"), td.RULES).alias("rule_id"))


@query("sub_limit_cap", f"WITH {waterfall_sql()} SELECT doc_id, line_index, live1 - live2 AS excess FROM s3 WHERE live1 > live2")
def sub_limit_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waterfall(spark, sf_dir).where("took_sub_limits > 0").select("doc_id", "line_index", F.col("took_sub_limits").alias("excess"))


@query("room_rent_proportionate", f"WITH {waterfall_sql()} SELECT doc_id, line_index, live2 - live3 AS excess FROM s3 WHERE live2 > live3")
def room_rent_proportionate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _waterfall(spark, sf_dir).where("took_room_rent_cap > 0").select("doc_id", "line_index", F.col("took_room_rent_cap").alias("excess"))


_PERMILLE = "(VALUES (-100), (-50), (-20), (-10), (0), (10), (20), (50), (100))"
SWEEP_SQL = f"""WITH {waterfall_sql()},
rel AS (SELECT k FROM {_PERMILLE} t(k)),
x AS (SELECT s1.*, k, CASE WHEN category = 'room_rent' THEN (2 * amt::HUGEINT * (1000 + k) + 1000) // 2000 ELSE amt END::BIGINT AS a FROM s1, rel),
x2 AS (SELECT x.*, CASE WHEN rule_id IS NOT NULL THEN 0 WHEN a > lcap THEN lcap ELSE a END AS b FROM x LEFT JOIN l USING (doc_id, line_index)),
xr AS (SELECT doc_id, k, arg_min(a, line_index) AS ra, arg_min(qty, line_index) AS rq FROM x WHERE category = 'room_rent' GROUP BY ALL),
x3 AS (SELECT x2.*, CASE WHEN ra > cap * rq AND category IN ('room_rent', 'nursing', 'surgery') AND b > 0 THEN (2 * b::HUGEINT * cap * rq + ra) // (2 * ra) ELSE b END::BIGINT AS c
  FROM x2 LEFT JOIN xr USING (doc_id, k)),
y AS (SELECT doc_id, k, sum(c)::BIGINT AS rest FROM x3 GROUP BY ALL),
z AS (SELECT doc_id, k, rest - CASE WHEN rest > 0 THEN (2 * rest * 10 + 100) // 200 ELSE 0 END AS payable FROM y),
w AS (SELECT *, max(payable) FILTER (k = 0) OVER (PARTITION BY doc_id) AS base FROM z)"""


@query("sensitivity_sweep", f"{SWEEP_SQL} SELECT doc_id, k AS permille, payable::BIGINT AS payable, (payable - base)::BIGINT AS delta FROM w")
def sensitivity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adj.sensitivity(td.line_items(spark, sf_dir), td.claims(spark, sf_dir), "room_rent", td.RULES, td.POLICY)
    return found.select("doc_id", (F.col("relative") * 1000).cast("int").alias("permille"), "payable", "delta")


@query(
    "sensitivity_amplification",
    f"""{SWEEP_SQL} SELECT doc_id, k AS permille, CASE WHEN base = 0 THEN NULL WHEN k = 0 THEN 0.0
    ELSE round(abs(payable - base)::DOUBLE / ((abs(k) / 1000.0)::DECIMAL(9,4) * base)::DOUBLE, 6) END AS amplification FROM w""",
)
def sensitivity_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adj.sensitivity(td.line_items(spark, sf_dir), td.claims(spark, sf_dir), "room_rent", td.RULES, td.POLICY)
    return found.select("doc_id", (F.col("relative") * 1000).cast("int").alias("permille"), F.round("amplification", 6).alias("amplification"))


@query(
    "sensitivity_pivot",
    f"""{SWEEP_SQL} SELECT 'room amounts' AS perturbation, """ + ", ".join(f'sum(payable - base) FILTER (k = {round(float(r) * 1000)})::BIGINT AS "{r}"' for r in adj.RELATIVES)
    + " FROM w UNION ALL SELECT 'stated gross', " + ", ".join("0" for _ in adj.RELATIVES),
)
def sensitivity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change of all payables, in hundredths, by what is off and how far."""
    wide = adj.sensitivity_table(td.line_items(spark, sf_dir), td.claims(spark, sf_dir), td.RULES, td.POLICY, {"room amounts": ("room_rent", False), "stated gross": (None, False)})
    return wide.select("perturbation", *(F.col(f"`{r}`").cast("bigint").alias(r) for r in adj.RELATIVES))


@query("shipped_rules", f"""WITH {td.ITEMS_SQL}, n AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{r.id}', '{n.casefold()}')" for i, r in enumerate(load_rules()) for n in r.match) + """) AS t(ord, rule_id, needle)),
    d AS (SELECT doc_id, line_index, lower(description || ' ' || category || CASE line_index % 4 WHEN 0 THEN ' admission kit' WHEN 1 THEN ' attendant food' ELSE '' END) AS said FROM items)
    SELECT doc_id, line_index, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_index ORDER BY length(needle) DESC, ord) AS k FROM d JOIN n ON contains(said, needle)) WHERE k = 1""")
def shipped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that come with the library, compiled, over all lines."""
    said = F.concat("description", F.lit(" "), "category", F.when(F.col("line_index") % 4 == 0, " admission kit").when(F.col("line_index") % 4 == 1, " attendant food").otherwise(""))
    lines = td.line_items(spark, sf_dir).select("doc_id", "line_index", adj.match_rule(said, F.col("category"), load_rules()).alias("rule_id"))
    return lines.where("rule_id is not null")
