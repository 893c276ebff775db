"""The adjudication waterfall over line items.

Lines are (doc_id, line_index, description, category, quantity, unit_rate, amount), claims
(doc_id, ward_type). Each stage lowers the amount that is still live and leaves what it took
as a deduction. Rules are compiled to one chain of tests, the longest needle first, so
matching needs no join; lines of a claim are dealt together once, for the claim's
room rate and for the sums, and stay so to the end.

Money is counted in hundredths as whole numbers, so every rounding is exact and half up.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, share_of
from ..functions.text import let
from ..shared import maybe_broadcast
from .needles import holding

STAGES = ("non_payable", "sub_limits", "room_rent_cap", "deductible", "co_pay")
OWN = ("deductible", "co_pay")  # taken of a claim's sum
ICU_WARDS = ("icu", "iccu", "nicu", "picu")
#: Needles that are compiled to a chain of tests.
LONGEST_CHAIN = 16
ROOM_CLAUSE = "Policy schedule - room rent capping with proportionate deduction"


@dataclass(frozen=True)
class Rule:
    id: str
    clause: str
    reason: str
    match: tuple[str, ...]
    category_hint: str | None = None

    def __post_init__(self):
        if not (self.id and self.clause and self.reason):
            raise ValueError("a rule needs an id, a clause and a reason")


@dataclass(frozen=True)
class SubLimit:
    match: str
    cap: str
    clause: str = "policy sub-limit"


@dataclass(frozen=True)
class Policy:
    """Amounts and percentages as decimal strings; ``order`` names the stages to run."""

    sum_insured: str = "500000"
    room_percent: str = "1.0"
    icu_percent: str = "2.0"
    proportionate: tuple[str, ...] = ("room_rent", "nursing", "professional_fees", "surgery", "equipment")
    co_pay_percent: str = "10.0"
    deductible: str = "0"
    sub_limits: tuple[SubLimit, ...] = field(default=())
    order: tuple[str, ...] = STAGES

    def __post_init__(self):
        if unknown := [s for s in self.order if s not in STAGES]:
            raise ValueError(f"unknown adjudication stage: {', '.join(unknown)}")

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)

    def daily_cap(self, percent: str) -> int:
        """Hundredths a day, half up."""
        from decimal import ROUND_HALF_UP

        cap = Decimal(self.sum_insured) * Decimal(percent) / 100
        return int(cap.quantize(Decimal("0.01"), ROUND_HALF_UP) * 100)

    @property
    def room_cap(self) -> int:
        return self.daily_cap(self.room_percent)

    @property
    def icu_cap(self) -> int:
        return self.daily_cap(self.icu_percent)


def cents(amount: Column) -> Column:
    return F.round(amount.cast("decimal(38,6)") * 100, 0).cast("bigint")


def money(hundredths: Column) -> Column:
    return (hundredths.cast("decimal(20,0)") / 100).cast(MONEY)


def match_rule(description: Column, category: Column, rules: list[Rule], pick=lambda r: r.id) -> Column:
    """``pick`` of the rule whose longest needle is in the description; where that is blank,
    of the first rule hinting at the category. Ties go to the earlier rule."""
    text = F.lower(F.coalesce(description, F.lit("")))
    needles = sorted(((n.casefold(), i) for i, r in enumerate(rules) for n in r.match), key=lambda x: (-len(x[0]), x[1]))
    hinted = F.lit(None).cast("string")
    for r in reversed([r for r in rules if r.category_hint]):
        hinted = F.when(category == r.category_hint, pick(r)).otherwise(hinted)
    if len(needles) > LONGEST_CHAIN:
        # A chain of so many tests is a method too long to be compiled to machine code; a list of needles is gone through instead.
        table = F.array(*(F.struct(F.lit(n).alias("needle"), F.lit(pick(rules[i])).alias("of")) for n, i in needles))
        first = let(text, lambda t: F.try_element_at(F.filter(table, lambda x: F.contains(t, x["needle"])), F.lit(1)))
        return F.coalesce(first["of"], F.when(text == "", hinted))
    out = F.when(text == "", hinted)
    for needle, i in reversed(needles):
        out = F.when(F.contains(text, F.lit(needle)), pick(rules[i])).otherwise(out)
    return out


def match_rule_joined(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join, for rule tables too large to compile: ``rules`` is (ord, rule_id, needle).

    doc_id, line_index and rule_id of lines that match. Distinct descriptions meet needles by their rarest q-gram,
    and lines meet their description's rule; an empty needle is in every line that has no other.
    """
    held = holding(lines, rules, "description")
    of = rules.withColumn("needle", F.lower("needle"))
    best = F.max_by("rule_id", F.struct(F.char_length("needle"), -F.col("ord")))
    told = held.join(of, "needle").groupBy("text").agg(best.alias("rule_id"))
    every = of.where("needle = ''").agg(F.min_by("rule_id", "ord")).first()[0]
    said = lines.select("doc_id", "line_index", F.lower(F.coalesce("description", F.lit(""))).alias("text"))
    out = said.join(maybe_broadcast(told), "text", "left").select("doc_id", "line_index", F.coalesce("rule_id", F.lit(every)).alias("rule_id"))
    return out.where("rule_id is not null")


def _first(choices: list[tuple[Column, object]], otherwise: Column) -> Column:
    out = otherwise
    for test, value in reversed(choices):
        out = F.when(test, value).otherwise(out)
    return out


def waterfall(lines: DataFrame, claims: DataFrame | None, rules: list[Rule], policy: Policy, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every line with what each stage took, in hundredths.

    Adds cents, rule_id, limit (place of the sub-limit, -1 without), took_<stage>, live, and the claim's
    remaining, deductible_taken and co_pay_taken. ``keys`` tell claims apart.
    """
    return _staged(_with_wards(lines.withColumn("cents", cents(F.col("amount"))), claims, keys), rules, policy, keys)


def _with_wards(lines: DataFrame, claims: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    if claims is None:
        return lines.withColumn("ward_type", F.lit(None).cast("string"))
    return lines.join(claims.select(*keys, "ward_type"), list(keys), "left")


def _rooms() -> Column:
    return F.when(F.col("category") == "room_rent", F.struct("line_index", "unit_rate", "quantity", "amount"))


def _limit_of(policy: Policy) -> Column:
    text = F.lower(F.coalesce("description", F.lit("")))
    return _first([(F.contains(text, F.lit(s.match.casefold())), i) for i, s in enumerate(policy.sub_limits)], F.lit(-1))


def _own_taken(stage: str, policy: Policy, rest: Column) -> Column:
    """What a claim's own deduction takes of the rest."""
    if stage == "deductible":
        amount = F.least(cents(F.lit(policy.deductible).cast("decimal(18,2)")), rest)
    else:
        amount = F.round(rest.cast("decimal(38,0)") * F.lit(policy.co_pay_percent).cast("decimal(9,4)") / 100, 0).cast("bigint")
    return F.when(rest > 0, amount).otherwise(0).cast("bigint")


def _staged(rows: DataFrame, rules: list[Rule], policy: Policy, keys: tuple[str, ...]) -> DataFrame:
    """The stages over lines with cents and ward_type. What is found already stays: _rule, _limit, and the claim's _room."""
    per_claim = Window.partitionBy(*keys)
    found = {c for c in ("_rule", "_limit", "_room") if c in rows.columns}
    rows = rows.withColumn("live", F.coalesce("cents", F.lit(0).cast("bigint"))).withColumn("rule_id", F.lit(None).cast("string")).withColumn("limit", F.lit(-1))
    for stage in STAGES:
        rows = rows.withColumn(f"took_{stage}", F.lit(0).cast("bigint"))
    rows = rows.withColumn("note", F.lit(None).cast("string")).withColumn("billed", F.lit(None).cast("decimal(38,0)")).withColumn("per", F.lit(None).cast("decimal(38,0)"))
    icu = F.coalesce(F.col("ward_type").isin(*ICU_WARDS), F.lit(False))
    rows = rows.withColumn("day_cap", F.when(icu, policy.icu_cap).otherwise(policy.room_cap).cast("bigint"))
    left_over = F.sum("live").over(per_claim)
    exact = True  # until a claim's own deduction, lives are whole hundredths
    for place, stage in enumerate(policy.order):
        alive = F.col("live") > 0
        took = f"took_{stage}"
        if stage == "non_payable":
            rows = rows.withColumn("rule_id", F.when(alive, F.col("_rule") if "_rule" in found else match_rule(F.col("description"), F.col("category"), rules)))
            rows = rows.withColumn(took, F.when(F.col("rule_id").isNotNull(), F.col("live")).otherwise(0))
        elif stage == "sub_limits":
            rows = rows.withColumn("limit", F.col("_limit") if "_limit" in found else _limit_of(policy))
            cap = _first([(F.col("limit") == i, cents(F.lit(s.cap).cast("decimal(18,2)"))) for i, s in enumerate(policy.sub_limits)], F.lit(None).cast("bigint"))
            rows = rows.withColumn(took, F.when(alive & (F.col("live") > cap), F.col("live") - cap).otherwise(0))
        elif stage == "room_rent_cap":
            # The billed daily rate is billed / per, kept as a fraction.
            if "_room" not in found:
                rows = rows.withColumn("_room", F.min(_rooms()).over(per_claim))
            stated = F.col("_room.unit_rate").isNotNull()
            derived = F.col("_room.amount").isNotNull() & (F.coalesce("_room.quantity", F.lit(0)) != 0)
            whole = lambda c, k: F.round(c.cast("decimal(38,6)") * k, 0).cast("decimal(38,0)")
            rows = rows.withColumn("billed", F.when(stated, whole(F.col("_room.unit_rate"), 100)).when(derived, whole(F.col("_room.amount"), 1_000_000)))
            rows = rows.withColumn("per", F.when(stated, F.lit(1)).when(derived, whole(F.col("_room.quantity"), 10_000)).cast("decimal(38,0)"))
            due = F.col("day_cap").cast("decimal(38,0)") * F.col("per")
            over = (F.col("billed") > due) & F.col("category").isin(*policy.proportionate) & alive
            reduced = share_of(F.col("live"), due, F.col("billed")) if exact else F.round(F.col("live") * due / F.col("billed"), 0)
            rows = rows.withColumn(took, F.when(over, F.greatest(F.lit(0), F.col("live") - reduced)).otherwise(0))
            underived = F.col("_room").isNotNull() & F.col("billed").isNull()
            rows = rows.withColumn("note", F.when(underived, "room rent present but no daily rate could be derived")).drop("_room")
        else:
            rest = F.round(left_over, 0).cast("bigint")
            rows = rows.withColumn("_rest", rest)
            rows = rows.withColumn(f"{stage}_taken", _own_taken(stage, policy, F.col("_rest")))
            rows = rows.withColumn("remaining" if stage == "co_pay" else "_before", F.col("_rest"))
            if any(s not in ("deductible", "co_pay") for s in policy.order[place + 1 :]) or place + 1 < len(policy.order):
                share = F.when(F.col("_rest") > 0, (F.col("_rest") - F.col(f"{stage}_taken")).cast("decimal(20,0)") / F.col("_rest").cast("decimal(20,0)")).otherwise(1)
                idle = stage == "deductible" and float(policy.deductible) == 0
                if not idle:
                    rows = rows.withColumn("live", (F.col("live").cast("decimal(20,6)") * share).cast("decimal(28,8)"))
                    exact = False
            rows = rows.withColumn("_payable", F.col("_rest") - F.col(f"{stage}_taken"))
            continue
        rows = rows.withColumn("live", F.col("live") - F.col(took))
        if "_payable" in rows.columns:
            rows = rows.drop("_payable")
    for stage in ("deductible", "co_pay"):
        if f"{stage}_taken" not in rows.columns:
            rows = rows.withColumn(f"{stage}_taken", F.lit(0).cast("bigint"))
    if "_payable" not in rows.columns:
        rows = rows.withColumn("_payable", F.round(left_over, 0).cast("bigint"))
    if "remaining" not in rows.columns:
        rows = rows.withColumn("remaining", F.col("_payable"))
    return rows.drop("_rest", "_before")


def claims_of(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a claim, in hundredths; gross = what was taken + payable."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.groupBy(*keys).agg(
        total("cents").alias("gross"), total("took_non_payable").alias("non_payable"), total("took_sub_limits").alias("sub_limits"),
        total("took_room_rent_cap").alias("room_rent"), F.max("deductible_taken").alias("deductible"), F.max("co_pay_taken").alias("co_pay"),
        F.max("_payable").alias("payable"),
    )


def _plain(hundredths: Column) -> Column:
    return money(hundredths).cast("string")


def deductions(rows: DataFrame, rules: list[Rule], policy: Policy, keys: tuple[str, ...] = ("doc_id",), grounds: bool = True) -> DataFrame:
    """(keys, stage_no, line_index, rule_id, clause, reason, amount): every amount taken, with its grounds (clause and reason), if they are asked for.

    What is taken of a claim's sum goes with one row of the claim, so the stages run once."""
    order = {s: i for i, s in enumerate(policy.order)}
    of_rule = lambda what: _first([(F.col("rule_id") == r.id, what(r)) for r in rules], F.lit(None).cast("string"))
    of_limit = lambda what: _first([(F.col("limit") == i, F.lit(what(s))) for i, s in enumerate(policy.sub_limits)], F.lit(None).cast("string"))
    taken = {"non_payable": (F.col("rule_id"), of_rule(lambda r: r.clause), of_rule(lambda r: r.reason))}
    taken["sub_limits"] = (
        F.lit("SUB_LIMIT"), of_limit(lambda s: s.clause),
        F.concat(F.lit("Charge of "), _plain(F.col("cents")), F.lit(" exceeds the policy sub-limit of "), of_limit(lambda s: s.cap), F.lit(" for '"), of_limit(lambda s: s.match), F.lit("'")),
    )
    rate = F.round(F.col("billed") / F.col("per") / 100, 2).cast("decimal(18,2)").cast("string")
    factor = F.bround(F.col("day_cap") * F.col("per") / F.col("billed"), 4).cast("decimal(18,4)").cast("string")
    taken["room_rent_cap"] = (
        F.lit("ROOM_RENT_CAP"), F.lit(ROOM_CLAUSE),
        F.concat(F.lit("Room rate "), rate, F.lit("/day exceeds the eligible "), _plain(F.col("day_cap")), F.lit("/day; this charge is reduced proportionately by factor "), factor),
    )
    own = {
        "deductible": (F.lit("DEDUCTIBLE"), F.lit("Policy schedule - deductible"), F.lit(f"Policy deductible of {policy.deductible} applied")),
        "co_pay": (F.lit("CO_PAY"), F.lit("Policy schedule - co-payment"), F.concat(F.lit(f"Co-payment of {policy.co_pay_percent}% applied to the admissible amount of "), _plain(F.col("remaining")))),
    }

    def row(stage: str, line: Column, id_: Column, clause: Column, reason: Column, took: str) -> Column:
        told = [clause.alias("clause"), reason.alias("reason")] if grounds else []
        return F.struct(F.lit(order[stage]).alias("stage_no"), line.cast("int").alias("line_index"), id_.alias("rule_id"), *told, F.col(took).alias("took"))

    of_line = F.array(*(row(s, F.col("line_index"), *about, f"took_{s}") for s, about in taken.items() if s in order))
    of_claim = F.array(*(row(s, F.lit(None), *about, f"{s}_taken") for s, about in own.items() if s in order))
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    marked = marked.withColumn("_first", F.col("_row") == F.min("_row").over(Window.partitionBy(*keys)))
    found = [a for a, stages in ((of_line, taken), (F.filter(of_claim, lambda x: F.col("_first")), own)) if set(stages) & set(order)]
    every = marked.select(*keys, F.inline(F.filter(F.concat(*found), lambda x: x["took"] > 0)))
    return every.select(*keys, "stage_no", "line_index", "rule_id", *(("clause", "reason") if grounds else ()), money(F.col("took")).alias("amount"))


def by_rule(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return found.groupBy(*keys, "rule_id").agg(F.sum("amount").cast(MONEY).alias("amount"))


def explain(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The audit trail of each claim: a line a deduction, in the order they were made."""
    line = F.concat(F.lit("["), F.col("rule_id"), F.lit("] "), F.col("amount").cast("string"), F.lit(": "), F.col("reason"), F.lit(" ("), F.col("clause"), F.lit(")"))
    ordered = F.sort_array(F.collect_list(F.struct("stage_no", "line_index", line.alias("line"))))
    return found.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("trail"))


RELATIVES = ("-0.10", "-0.05", "-0.02", "-0.01", "0", "0.01", "0.02", "0.05", "0.10")


def perturbed(lines: DataFrame, category: str | None, relatives: tuple[str, ...] = RELATIVES, rate: bool = False) -> DataFrame:
    """Each line once for each relative error, with the amounts (and rates) of a category off by it."""
    steps = F.explode(F.array(*(F.lit(r).cast("decimal(9,4)") for r in relatives)))
    many = lines.withColumn("relative", steps)
    moved = lambda c: F.when(F.col("category") == F.lit(category), F.round(F.col(c).cast("decimal(18,2)") * (1 + F.col("relative")), 2)).otherwise(F.col(c)).cast(MONEY)
    many = many.withColumn("amount", moved("amount"))
    return many.withColumn("unit_rate", moved("unit_rate")) if rate else many


def _payables(lines: DataFrame, claims: DataFrame | None, perturbations: dict[str, tuple[str | None, bool]], rules: list[Rule], policy: Policy, relatives: tuple[str, ...]) -> DataFrame:
    """doc_id, perturbation, relative, payable and base, the payable without error.

    Lines are dealt by claim once and copied there, without being sorted or sent again, only for the errors that
    reach their claim: one without a line of the category keeps its payable. A claim's own deductions are taken of its sums.
    """
    step = "decimal(9,4)"
    line_stages, own = (tuple(s for s in policy.order if (s in OWN) == mine) for mine in (False, True))
    if policy.order != line_stages + own:  # a claim's deduction is spread over lines that are cut again
        each = [_payables_by_line(lines, claims, category, rules, policy, rate, relatives).withColumn("perturbation", F.lit(name)) for name, (category, rate) in perturbations.items()]
        return reduce(DataFrame.unionByName, each)
    kinds = sorted({k for k in perturbations.values() if k[0] is not None})
    errors = [(k, r) for k in kinds for r in dict.fromkeys(map(Decimal, relatives)) if r]
    number = {e: i + 1 for i, e in enumerate(errors)}
    per_claim = Window.partitionBy("doc_id")
    rows = _with_wards(lines, claims, ("doc_id",)).withColumns({"_whole": cents(F.col("amount").cast(MONEY)), "_rule": match_rule(F.col("description"), F.col("category"), rules), "_limit": _limit_of(policy)})
    rows = rows.withColumns({"_room": F.min(_rooms()).over(per_claim), "_kinds": F.collect_set("category").over(per_claim)})
    error = lambda n, off, category, rate: F.struct(F.lit(n).alias("n"), F.lit(off).cast(step).alias("off"), F.lit(category).cast("string").alias("category"), F.lit(rate).alias("rate"))
    none = F.array(error(0, "0", None, False))
    those = [F.when(F.array_contains("_kinds", k[0]), F.array(*(error(number[e], str(e[1]), *k) for e in errors if e[0] == k))).otherwise(F.slice(none, 1, 0)) for k in kinds if any(e[0] == k for e in errors)]
    rows = rows.select("doc_id", "category", "ward_type", "amount", "_whole", "_rule", "_limit", "_room", F.explode(F.concat(none, *those)).alias("v"))
    off = lambda c: F.round(c.cast("decimal(18,2)") * (1 + F.col("v.off")), 2).cast(MONEY)
    of_room = F.coalesce(F.col("v.category") == "room_rent", F.lit(False))
    room = F.struct(
        F.when(of_room & F.col("v.rate"), off(F.col("_room.unit_rate"))).otherwise(F.col("_room.unit_rate")).alias("unit_rate"), F.col("_room.quantity").alias("quantity"),
        F.when(of_room, off(F.col("_room.amount"))).otherwise(F.col("_room.amount").cast(MONEY)).alias("amount"),
    )
    rows = rows.select(
        "doc_id", "category", "ward_type", "_rule", "_limit", F.col("v.n").alias("n"), F.when(F.col("category").isin(*policy.proportionate) & F.col("_room").isNotNull(), room).alias("_room"),
        F.when(F.col("category") == F.col("v.category"), cents(off(F.col("amount")))).otherwise(F.col("_whole")).alias("cents"),
    )
    sums = _staged(rows, rules, policy.with_(order=line_stages), ("doc_id", "n")).groupBy("doc_id", "n").agg(F.sum("live").alias("payable"))
    for stage in own:
        sums = sums.withColumn("payable", F.col("payable") - _own_taken(stage, policy, F.col("payable")))
    of = lambda n: F.max(F.when(F.col("n") == n, F.col("payable")))
    wide = sums.groupBy("doc_id").agg(of(0).alias("base"), *(of(n).alias(f"_{n}") for n in number.values()))
    told = [(name, r, number.get((k, Decimal(r)))) for name, k in perturbations.items() for r in relatives]
    every = F.array(*(F.struct(F.lit(name).alias("perturbation"), F.lit(r).cast(step).alias("relative"), (F.coalesce(f"_{n}", "base") if n else F.col("base")).alias("payable")) for name, r, n in told))
    return wide.select("doc_id", "base", F.inline(every))


def _payables_by_line(lines: DataFrame, claims: DataFrame | None, category: str | None, rules: list[Rule], policy: Policy, rate: bool, relatives: tuple[str, ...]) -> DataFrame:
    """The same for any order of stages: every line goes through all of them once for each error."""
    keys = ("doc_id", "relative")
    many = perturbed(lines, category, relatives, rate)
    if claims is not None:
        claims = claims.select("doc_id", "ward_type", F.explode(F.array(*(F.lit(r).cast("decimal(9,4)") for r in relatives))).alias("relative"))
    found = claims_of(waterfall(many, claims, rules, policy, keys), keys)
    base = F.max(F.when(F.col("relative") == 0, F.col("payable"))).over(Window.partitionBy("doc_id"))
    return found.select("doc_id", "relative", "payable", base.alias("base"))


def sensitivity(lines: DataFrame, claims: DataFrame | None, category: str | None, rules: list[Rule], policy: Policy, rate: bool = False, relatives: tuple[str, ...] = RELATIVES) -> DataFrame:
    """doc_id, relative, payable, delta against no error, absolute_error, and amplification: the relative change of the
    payable for each unit of relative error (0 without error, null where nothing is payable). Without a category it is the
    stated gross that is off, which no payable hangs on. ``relatives`` must hold 0."""
    out = _payables(lines, claims, {"": (category, rate)}, rules, policy, relatives)
    delta = F.col("payable") - F.col("base")
    grew = F.try_divide(F.abs(delta).cast("double"), (F.abs("relative") * F.col("base")).cast("double"))
    return out.select(
        "doc_id", "relative", "payable", delta.alias("delta"), F.abs(delta).alias("absolute_error"),
        F.when(F.col("base") == 0, None).when(F.col("relative") == 0, 0.0).otherwise(grew).alias("amplification"),
    )


#: What is off, by name: a category's amounts (and rates), or the stated gross.
PERTURBATIONS = {"room rate": ("room_rent", True), "pharmacy amounts": ("pharmacy", False), "stated gross": (None, False)}


def sensitivity_table(lines: DataFrame, claims: DataFrame | None, rules: list[Rule], policy: Policy, perturbations: dict[str, tuple[str | None, bool]] | None = None, relatives: tuple[str, ...] = RELATIVES) -> DataFrame:
    """A row for each perturbation, a column for each relative error: the change of all payables together, by pivot."""
    found = _payables(lines, claims, perturbations or PERTURBATIONS, rules, policy, relatives)
    out = found.select("perturbation", F.col("relative").cast("double").alias("relative"), (F.col("payable") - F.col("base")).alias("delta"))
    wide = out.groupBy("perturbation").pivot("relative", [float(r) for r in relatives]).agg(F.sum("delta"))
    return wide.select("perturbation", *(F.col(f"`{float(r)}`").alias(r) for r in relatives))
