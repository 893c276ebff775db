"""Distant labels, alignment, needles, medians of groups and slices against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from claimweave import report
from claimweave.functions import codec, similarity, text
from claimweave.operators import adjudicate, align, distant, draws, evaluate, lengths, needles, ranks, spans
from claimweave.plans import registry, training
from claimweave.shared import kept
from claimweave.sources import testdata as td

SF = "/root/testdata/sf0.001"


def bare(word):
    return (word or "").casefold().strip(".,:;")


def brute_labels(words, values):
    out = ["O"] * len(words)
    for path, value in sorted(values, key=lambda v: (-len(v[1] or ""), distant.PLACES.get(v[0], 99), v[0], v[1] or "")):
        want = [bare(w) for w in (value or "").split()]
        n = len(want)
        for at in range(len(words) - n + 1) if n else ():
            if [bare(w) for w in words[at : at + n]] == want and all(x == "O" for x in out[at : at + n]):
                out[at : at + n] = [f"B-{path}", *[f"I-{path}"] * (n - 1)]
                break
    return out


def test_distant_labels(spark):
    rng = random.Random(2)
    few = ["a", "B", "c.", "d,", "straße", "STRASSE", "(y)", ":a:"]
    pages = {p: ([rng.choice([*few, None]) for _ in range(rng.randrange(30))], [(rng.choice([*distant.PLACES, "other"]), " ".join(rng.choice(few) for _ in range(rng.randrange(5))) or None) for _ in range(rng.randrange(7))]) for p in range(60)}
    pages[60] = (["w"] * 3000 + ["x", "y", "z"], [("patient.name", "w " * 50 + "x y z"), ("hospital.city", "w w"), ("hospital.city", "w w"), ("patient.uhid", "not there")])
    words = [(p, i * 3, w, "kept") for p, (ws, _) in pages.items() for i, w in enumerate(ws)] + [(None, 0, "a", "kept")]
    values = [(p, *v) for p, (_, vs) in pages.items() for v in vs] + [(99, "patient.name", "a"), (None, "patient.name", "a")]
    made = distant.label_tokens(spark.createDataFrame(words, "page_id int, idx int, text string, pos string"), spark.createDataFrame(values, "page_id int, path string, value string"))
    assert made.columns == ["page_id", "idx", "text", "pos", "label"]
    got = collections.defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: (r["page_id"] is None, r["page_id"], r["idx"])):
        got[r["page_id"]].append(r["label"])
    assert got.pop(None) == ["O"]
    assert got == {p: brute_labels(*of) for p, of in pages.items() if of[0]}
    assert sum(x != "O" for x in got[60]) == 57 and distant.label_tokens(made.drop("label").limit(0), spark.createDataFrame(values, "page_id int, path string, value string")).count() == 0


def test_documents_of_spans(spark):
    rows = [("p", 0, "B-patient.name", "Asha"), ("p", 1, "I-patient.name", "Rao"), ("p", 2, "B-patient.name", "Other"), ("p", 3, "B-line_items.description", "Bed"), ("p", 4, "B-line_items.amount", "10"), ("p", 5, "B-line_items.amount", "20"), ("q", 0, "I-totals.net_amount", "5")]
    tokens = spark.createDataFrame([(p, i, label, text, 0.0, float(i // 5 * 50), 1.0, float(i // 5 * 50 + 2)) for p, i, label, text in rows], "page_id string, idx int, label string, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r["page_id"]: r["document"] for r in spans.documents_of(spans.decode_spans(tokens)).collect()}
    assert got["p"]["patient"]["name"] == "Asha Rao" and [(i["description"], i["amount"]) for i in got["p"]["line_items"]] == [("Bed", "10"), (None, "20")]
    assert got["q"]["totals"]["net_amount"] == "5" and got["q"]["line_items"] == []


def test_values_of_records(spark):
    pairs = training._bills(spark, SF).limit(3)
    got = distant.values_of(pairs.withColumnRenamed("doc_id", "page_id"))
    assert {"insurance.claim_number", "line_items.description", "line_items.amount"} <= {r["path"] for r in got.collect()}


def test_alignment_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeß") for _ in range(rng.randrange(1, 7)))
    lines, values = [], []
    for p in range(12):
        page = [" ".join(word() for _ in range(rng.randrange(0, 9))) for _ in range(15 if p else 300)]
        lines += [(p, i, t) for i, t in enumerate(page)] + [(p, 900, None)]
        for t in rng.sample(page, 8):
            v = list(t)
            for _ in range(rng.randrange(0, 4)):
                if v:
                    v[rng.randrange(len(v))] = rng.choice(["", "x", "aa"])
            values.append((p, "a", "".join(v)[rng.randrange(3) :].upper()))
        values += [(p, "b", "abc"), (p, "b", "abc"), (p, "c", None), (p, "d", "")]
    got = collections.Counter((r["page_id"], r["path"], r["value"], r["top"], round(r["score"], 6)) for r in align.align_values(spark.createDataFrame(values, "page_id int, path string, value string"), spark.createDataFrame(lines, "page_id int, top int, text string")).collect())
    want = collections.Counter()
    for p, path, v in values:
        if v:
            score, top = max((similarity.partial_ratio(v.casefold(), t.casefold()), -i) for q, i, t in lines if q == p and t)
            if score >= 75:
                want[p, path, v, -top, round(score / 100, 6)] += 1
    assert got == want and len(got) > 60


@pytest.mark.parametrize("seed", range(3))
def test_pairs_left_by_edits(seed):
    """The bound of ``align``: strings that are alike by 75 share at least 0.2m - 1 pairs of letters, as often as they occur."""
    rng = random.Random(seed)
    near = 0
    for _ in range(4000):
        a = [rng.choice("ab" if seed else "abcd") for _ in range(rng.randrange(6, 16))]
        b = list(a)
        for _ in range(rng.randrange(0, len(a) // 2 + 1)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        a, b = "".join(a), "".join(b)
        if len(b) >= 6 and similarity.partial_ratio(a, b) >= 75:
            near += 1
            of = lambda s: collections.Counter(s[i : i + 2] for i in range(len(s) - 1))
            assert (of(a) & of(b)).total() >= 0.2 * min(len(a), len(b)) - 1
    assert near > 500


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_needles(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abC é") for _ in range(rng.randrange(30))) for _ in range(200)] * 2 + [None, "", "a" * 5000]
    wanted = ["".join(rng.choice("abcÉ ") for _ in range(rng.randrange(1, 7))) for _ in range(150)] + [None, "", "a" * 40, "zzz", "ab", "AB"]
    got = sorted(map(tuple, needles.holding(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in wanted], "needle string")).collect()))
    assert got == sorted({(t.lower(), n.lower()) for t in texts if t for n in wanted if n and n.lower() in t.lower()})
    assert needles.holding(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "needle string")).count() == 0


def test_a_hundred_thousand_needles_without_a_product(spark):
    rules = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("r"), "id").alias("rule_id"), F.concat(F.lit("item "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("needle"))
    rules = rules.unionByName(spark.createDataFrame([(100_001, "late", "ITEM 000007 large"), (100_002, "tie", "item 000009")], rules.schema))
    lines = spark.createDataFrame([(1, 0, "an Item 000007 large one"), (1, 1, "item 000009"), (1, 2, "nothing"), (2, 0, None)], "doc_id int, line_index int, description string")
    df = adjudicate.match_rule_joined(lines, rules)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert sorted(map(tuple, df.collect())) == [(1, 0, "late"), (1, 1, "r9")]
    every = rules.unionByName(spark.createDataFrame([(5, "any", "")], rules.schema))
    assert sorted(map(tuple, adjudicate.match_rule_joined(lines, every).collect()))[2:] == [(1, 2, "any"), (2, 0, "any")]


def test_ranks_of_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, rng.randrange(-50, 50), rng.randrange(10**12)])) for _ in range(400)] + [("hot", 7)] * 900 + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(7)
    of = collections.defaultdict(list)
    for g, v in rows:
        of[g] += [] if v is None else [v]
    for bins in (4, 4096):
        got = {r["g"]: (r["n"], r["first"], r["mid"], r["last"], r["far"]) for r in ranks.group_ranks(df, ("g",), "v", {"first": lambda n: F.lit(1), "mid": lambda n: F.floor((n + 1) / 2), "last": lambda n: n, "far": lambda n: n + 1}, bins=bins).collect()}
        assert got == {g: (len(vs), *((s[0], s[(len(s) + 1) // 2 - 1], s[-1]) if (s := sorted(vs)) else (None,) * 3), None) for g, vs in of.items()}
    values = spark.range(1, 101).select(F.col("id").alias("v"))
    assert tuple(ranks.group_medians(values, (), "v").first()) == (100, 50.5, 95)
    assert ranks.group_medians(values.where("v < 0"), (), "v").count() == 0
    assert tuple(evaluate.score_business(spark.createDataFrame([], "true_payable bigint, pred_payable bigint, pred_deducted bigint, true_deducted bigint")).first())[:4] == (0, 0, 0.0, 0)


def test_slices_count_trees_too(spark):
    measured = evaluate.document_measures(training._bills(spark, SF).limit(20))
    got = evaluate.slice_summaries(measured).collect()
    assert sum(r["n"] for r in got if r["key"] == "status") == 20 and all(0 <= r["ted"] <= 1 and r["strict"] == 0 for r in got)
    assert {r["key"]: r["place"] for r in got} == {"source": 1, "status": 6}


def test_measures_without_trees_in_one_pass(spark):
    """nothing is joined or written between, and what is measured is what whole typed documents give."""
    pairs = kept(training._bills(spark, SF).limit(30), "pairs")
    short = evaluate.document_measures(pairs, trees=False)
    plan = plan_of(short)
    assert "Join" not in plan and "Exchange" not in plan
    typed = kept(evaluate.typed_pairs(pairs), "typed")
    long = evaluate.document_measures(typed, trees=False)
    found = sorted(map(str, short.collect()))
    assert found == sorted(map(str, long.collect())) and len(found) == 30
    matched = {r["doc_id"]: r["n"] for r in evaluate.matched_items(evaluate.item_descriptions(typed)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    gaps = {r["doc_id"]: None if r["true_payable"] is None else abs((r["pred_payable"] or 0) - r["true_payable"]) for r in evaluate.business_errors(typed).collect()}
    assert all(r["n_matched"] == matched.get(r["doc_id"], 0) and r["error"] == gaps[r["doc_id"]] for r in short.collect())


def test_plain_text_goes_the_short_way(spark):
    odd = ["Ab c", " a", "a ", "a  b", "", None, "a\tb", "a\n", "É", "a\u2013b", "\u00a0x", "ß", "~!", "word " * 20_000 + "end"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    got = rows.select("t", text.normalize_text(F.col("t")).alias("a"), text.let(text.prepare(F.col("t")), text.casefold).alias("b")).collect()
    assert len(got) == len(odd) and all(r["a"] == r["b"] for r in got)


def test_trees_leave_out_what_is_empty():
    assert similarity.tree({"patient": {"name": None}, "rows": [{}, None], "a": 1}) == ("document", (("rows", (("item", ()),)), ("a", (("1", ()),))))


def test_repetition_loops(spark):
    loop = re.compile(r"(?i)\b(\w[\w ]{3,30}?)\b(?:\s+\1\b){3}")
    docs = td.table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["loops"] for r in registry.queries()["repetition_loops"](spark, SF).collect()}
    assert got == {i: t is not None and bool(loop.search(t)) for i, t in docs} and 0 < sum(got.values()) < len(got)
    assert spark.createDataFrame([("word " * 100_000,)], "t string").select(codec.has_repetition_loop(F.col("t"))).first()[0]


def test_length_sketches(spark):
    """Sketches of shards, merged, are as near to exact ranks as promised."""
    rows = spark.range(40_000).select((F.col("id") % 7).alias("shard"), (F.col("id") * F.col("id") % 99_991).alias("v")).persist()
    kept = lengths.sketches(rows, ("shard",), F.col("v"))
    whole = lengths.quantiles(lengths.merged(kept, ()), {"p50": 0.5, "p95": 0.95}).first()
    assert whole["n"] == 40_000
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        assert abs(rows.where(F.col("v") < whole[name]).count() / 40_000 - q) < lengths.ERROR + 0.005
    runs = spark.createDataFrame([("a", i, 10**9 if i < 3 else 1000 * i) for i in range(103)], "variant string, run int, microseconds bigint")
    (r,) = lengths.latency(runs, ("variant",)).collect()
    assert r["n"] == 100 and abs(r["p50_ms"] - 52.5) <= 2.5 and abs(r["p95_ms"] - 97) <= 3 and r["mean_ms"] == pytest.approx(52.5)
    rows.unpersist()


def test_sensitivity_by_what_is_off(spark):
    lines = spark.createDataFrame([(1, 0, "Room", "room_rent", 1.0, 10000.0, 10000.0), (1, 1, "Tablets", "pharmacy", 1.0, 500.0, 500.0)], "doc_id int, line_index int, description string, category string, quantity double, unit_rate double, amount double")
    for c in ("quantity", "unit_rate", "amount"):
        lines = lines.withColumn(c, F.col(c).cast("decimal(18,2)"))
    policy = adjudicate.Policy(co_pay_percent="0")
    wide = adjudicate.sensitivity_table(lines, None, [], policy, relatives=("-0.10", "0", "0.10"))
    got = {r["perturbation"]: r for r in wide.collect()}
    assert got["stated gross"]["0.10"] == 0 and got["pharmacy amounts"]["0.10"] == 5000 and got["pharmacy amounts"]["0"] == 0
    text = report.sensitivity_report(wide)
    assert "| pharmacy amounts | -50 | +0 | +50 |" in text
    one = adjudicate.sensitivity(lines, None, "pharmacy", [], policy, relatives=("0", "-0.10"))
    assert {(str(r["relative"]), r["absolute_error"]) for r in one.collect()} == {("0.0000", 0), ("-0.1000", 5000)}


def test_draws_follow_weights(spark):
    choices = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", 0.0), ("b", "x", 1.0), (None, "n", 2.0), ("c", "never", -1.0)], "g string, v string, weight double")
    rows = spark.range(30_000).select("id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("d")), (F.col("id") % 5 + 1).cast("int")).alias("g"), F.lit("kept").alias("lower"))
    got = draws.draw(rows, draws.unit(F.lit("seed"), F.col("id").cast("string")), choices, ("g",), ("v",))
    assert got.count() == 30_000 and got.columns == ["id", "g", "lower", "v"]
    n = {(r["g"], r["v"]): r["count"] for r in got.groupBy("g", "v").count().collect()}
    assert n[("b", "x")] == n[(None, "n")] == n[("c", None)] == n[("d", None)] == 6000 and ("a", "z") not in n
    assert abs(n[("a", "y")] / 6000 - 0.75) < 0.02
    edges = spark.createDataFrame([("a", 0.0, 1), ("a", 0.25, 2), ("a", 0.9999999, 3), ("a", None, 4)], "g string, u double, id int")
    assert {r["id"]: r["v"] for r in draws.draw(edges, F.col("u"), choices, ("g",), ("v",)).collect()} == {1: "x", 2: "y", 3: "y", 4: None}
    assert {r["v"] for r in draws.draw(edges, F.col("u"), choices.where("g = 'a'"), (), ("v",)).collect()} == {"x", "y", None}
