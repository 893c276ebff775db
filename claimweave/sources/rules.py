"""Rule sets and policy terms from JSON or YAML files; small, read on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators.adjudicate import Policy, Rule, SubLimit

DEFAULT = Path(__file__).parent / "data" / "rules.json"


def _load(path: Path | str | None) -> dict:
    path = Path(path or DEFAULT)
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def load_rules(path: Path | str | None = None) -> list[Rule]:
    return [Rule(r["id"], r["clause"], r["reason"], tuple(r.get("match", ())), r.get("category_hint")) for r in _load(path)["rules"]]


def load_policy(path: Path | str | None = None, **overrides) -> Policy:
    """Policy terms; overrides replace whole terms. Both the flat form and a nested ``room_rent`` are read."""
    terms = dict(_load(path)["policy"]) | overrides
    if room := terms.pop("room_rent", None):
        terms |= {"room_percent": room["cap_percent_of_sum_insured_per_day"], "icu_percent": room["icu_cap_percent_of_sum_insured_per_day"], "proportionate": room["proportionate_categories"]}
    for name in ("sum_insured", "room_percent", "icu_percent", "co_pay_percent", "deductible"):
        if isinstance(terms.get(name), float) and name in ("sum_insured", "deductible"):
            raise TypeError(f"{name} is a float; give money as text or a whole number")
        terms[name] = str(terms[name])
    limits = tuple(s if isinstance(s, SubLimit) else SubLimit(str(s["match"]), str(s["cap"]), str(s.get("clause", "policy sub-limit"))) for s in terms.get("sub_limits", ()))
    return Policy(**terms | {"sub_limits": limits, "proportionate": tuple(terms["proportionate"]), "order": tuple(terms["order"])})


def needles(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(ord, rule_id, needle), for matching by join."""
    rows = [(i, r.id, n) for i, r in enumerate(rules) for n in r.match]
    return spark.createDataFrame(rows, "ord int, rule_id string, needle string")
