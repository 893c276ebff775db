"""Synthetic bills and the report."""

from pyspark.sql import functions as F

from claimweave import evaluation_run as run
from claimweave import report
from claimweave.functions.gstin import is_valid_gstin
from claimweave.operators import evaluate as ev
from claimweave.operators import generate
from claimweave.sources import manifest


def test_generator(spark):
    docs = generate.documents(spark, 10).withColumn("text", generate.printed_text(F.col("truth"))).persist()
    assert docs.count() == 10 and docs.where(~is_valid_gstin(F.col("truth.hospital.gstin"))).count() == 0
    assert docs.where(F.contains("text", F.lit("Gross Amount : "))).count() == 10


def test_evaluation_run(spark, tmp_path):
    """From made-up bills to the report: both extractors, their own supports side by side, errors, the same on a second run."""
    docs = run.generated(spark, 24, 7)
    manifest.write_documents(docs, f"{tmp_path}/docs")
    assert run.main(["--documents", f"{tmp_path}/docs", "--reports-dir", f"{tmp_path}/out", "--seed", "7"]) == 0
    text = next((tmp_path / "out").glob("eval_*.md")).read_text()
    for heading in ("Headline", "Fields", "Line items", "Attributes of matched rows", "Rupees", "Coverage of rules", "Slices of heuristic", "Errors of rules"):
        assert f"## {heading}" in text
    assert text.count("`totals.gross_amount`") == 1 and "| source | generated | 24 |" in text and "24 documents, sha256 " in text
    errors = (tmp_path / "out/errors_rules.md").read_text()
    assert "## By kind" in errors and "`missed_field`" in errors and "### 1. " in errors
    assert run.dataset_hash(docs) == run.dataset_hash(manifest.read_documents(spark, f"{tmp_path}/docs").repartition(5))


def test_scores_follow_predictions(spark):
    """The truth as a prediction scores full marks; without predictions nothing is right but what is absent."""
    docs = run.generated(spark, 12, 3)
    truth = docs.select("doc_id", F.col("truth").alias("document"))
    perfect = report.evaluate_system(ev.pairs_of(truth, docs))
    assert perfect["documents"]["strict"] == perfect["documents"]["ted"] == perfect["line_items"]["f1"] == 1.0 and perfect["business"]["median_error"] == 0
    assert perfect["cases"] == [] and all(s["exact_macro"] == 1.0 for s in perfect["slices"]) and perfect["coverage"] == []
    nothing = report.evaluate_system(ev.pairs_of(truth.where("doc_id = 'none'"), docs))
    rows = docs.agg(F.sum(F.size("truth.line_items"))).first()[0]
    assert nothing["line_items"]["deletions"] == rows and nothing["documents"]["strict"] == 0
    missed = {e["value"]: e["n"] for e in nothing["errors"] if e["dimension"] == "path"}
    assert missed["line_items[]"] == rows and missed["patient.name"] == 12
    both = report.side_by_side({"a": perfect, "b": nothing}, "attributes", "attribute", ("accuracy", "support"))
    assert all(r["a_accuracy"] == 1.0 and r["b_accuracy"] is None for r in both)


def test_write_report(tmp_path):
    assert report.table(["a"], []) == "_no data_" and report.curve_plot([]) == "_no data_"
    assert report.write_report("text", str(tmp_path)).read_text() == "text"
