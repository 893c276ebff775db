"""The evaluation run: documents, extractors, pairs, confidences, report.

    python -m claimweave.evaluation_run --documents FOLDER --reports-dir reports
    python -m claimweave.evaluation_run --generate 500 --systems rules,heuristic

Documents are a folder that ``sources.manifest.write_documents`` wrote, or bills generated on the spot. An extractor takes
(doc_id, text) and gives (doc_id, document); others can be added to ``EXTRACTORS``.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .operators import evaluate as ev
from .operators import extract, generate
from .operators.sampling import corpus_hash
from .session import session
from .shared import kept
from .sources import manifest

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "rules": lambda docs: docs.select("doc_id", extract.extract_rules(F.col("text")).alias("document")),
    "heuristic": lambda docs: extract.extract_heuristic(docs).select("doc_id", "document"),
}


def generated(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(doc_id, text, truth, meta) of bills that are printed and made up."""
    docs = generate.documents(spark, n, seed)
    return docs.select("doc_id", generate.printed_text(F.col("truth")).alias("text"), "truth", F.map_concat("meta", F.create_map(F.lit("source"), F.lit("generated"))).alias("meta"))


def dataset_hash(docs: DataFrame) -> str:
    """SHA-256 over the hashes of all documents, whatever their order."""
    one = docs.select(F.sha2(F.concat_ws("\x1f", "doc_id", "text", F.to_json("truth")), 256).alias("h"))
    return corpus_hash(one, "h").first()[0]


def evaluate(docs: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, dict]:
    """The scores of each system on documents (doc_id, text, truth, meta), with confidences by the systems' agreement."""
    docs = kept(docs, "documents")
    said = {name: kept(read(docs.select("doc_id", "text")), f"read-{name}") for name, read in extractors.items()}
    confidences = kept(ev.ensemble_confidence(ev.system_values(said)), "confidences")
    return {name: report.evaluate_system(ev.pairs_of(df, docs), confidences) for name, df in said.items()}


def run(docs: DataFrame, folder: str, systems: tuple[str, ...] = tuple(EXTRACTORS), seed: int = 1337, name: str = "documents") -> Path:
    """Writes the report and each system's errors; the path of the report."""
    results = evaluate(docs, {s: EXTRACTORS[s] for s in systems})
    metadata = report.run_metadata(report.set_seed(seed))
    notes = (f"{docs.count()} documents, sha256 {dataset_hash(docs)}.",)
    path = report.write_report(report.build_report(results, name, metadata, notes), folder, metadata)
    for system, result in results.items():
        Path(folder, f"errors_{system}.md").write_text(report.taxonomy_report(result, f"{name}, {system}"), encoding="utf-8")
    return path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m claimweave.evaluation_run", description="Evaluates extractors and writes a report.")
    parser.add_argument("--documents", help="folder of texts and truths")
    parser.add_argument("--generate", type=int, default=200, help="without a folder: how many bills to make up")
    parser.add_argument("--systems", default=",".join(EXTRACTORS))
    parser.add_argument("--reports-dir", default="reports")
    parser.add_argument("--seed", type=int, default=1337)
    args = parser.parse_args(argv)
    systems = tuple(args.systems.split(","))
    if unknown := [s for s in systems if s not in EXTRACTORS]:
        parser.error(f"no extractor named {', '.join(unknown)}")
    spark = SparkSession.getActiveSession() or session("evaluation")
    docs = manifest.read_documents(spark, args.documents) if args.documents else generated(spark, args.generate, args.seed)
    print(f"wrote {run(docs, args.reports_dir, systems, args.seed, args.documents or 'generated bills')}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
