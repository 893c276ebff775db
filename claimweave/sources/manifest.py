"""Manifests, page targets, corrections and redaction records as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RAW_SCHEMA

MANIFEST = (
    "page_id string, doc_id string, page int, total_pages int, image string, targets string, sha256 string, split string, quality string, "
    "legible boolean, ink_contrast double, edge_energy double, has_header boolean, has_totals boolean, n_line_items int, layout string, template string, language string"
)
CORRECTION = "page_id string, field string, predicted string, corrected string, note string, logged_at string, git_sha string"
REDACTION = "document_id string, redacted_at string, fields_redacted array<string>, text_patterns map<string,int>, key_fingerprint string, consent_reference string"


def read_manifest(spark: SparkSession, *paths: str, split: str | None = None) -> DataFrame:
    rows = spark.read.schema(MANIFEST).json(list(paths)).where("page_id is not null")
    return rows.where(F.col("split") == split) if split else rows


def write_manifest(rows: DataFrame, path: str, partition_by_split: bool = False) -> None:
    """Nulls stay out; with partitions, a split's readers see only its files."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy("split") if partition_by_split else writer).json(path)


def merge_shards(spark: SparkSession, *paths: str) -> DataFrame:
    """All shards in order of page, a page once."""
    return read_manifest(spark, *paths).dropDuplicates(["page_id"]).orderBy("page_id")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, head_a, head_b) of page targets, one JSON file each."""
    target = f"page_id string, doc_id string, page int, head_a {RAW_SCHEMA.simpleString()}, head_b struct<line_items:{RAW_SCHEMA['line_items'].dataType.simpleString()}>, has_header boolean, has_totals boolean, duplicate_row_reprinted boolean"
    return spark.read.schema(target).json(path, multiLine=True)


def samples(manifest: DataFrame, targets: DataFrame, head: str) -> DataFrame:
    """(page_id, image, target) of pages whose targets are there, rendered for one head."""
    from ..functions import codec

    if head not in ("a", "b"):
        raise ValueError(f"no head {head!r}")
    rendered = codec.render_head_a(F.col("head_a"), F.col("has_header"), F.col("has_totals")) if head == "a" else codec.render_head_b(F.col("head_b.line_items"))
    both = manifest.select("page_id", "image").join(targets.select("page_id", "head_a", "head_b", "has_header", "has_totals"), "page_id")
    return both.select("page_id", "image", rendered.alias("target"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Pages whose image isn't among (path)."""
    return manifest.join(files.select(F.col("path").alias("image")), "image", "left_anti")


def page_targets(pages: DataFrame) -> DataFrame:
    """(page_id, doc_id, page, head_a, head_b, flags) of assembled pages: blocks where shown, rows without the reprinted one."""
    shown = lambda flag, block: F.when(F.col(flag), F.col(block)).alias(block)
    head_a = F.struct(*(shown("has_header", b) for b in ("hospital", "patient", "insurance")), shown("has_totals", "totals"))
    rows = F.when(F.col("duplicate_row_reprinted"), F.slice("line_items", F.lit(2), F.greatest(F.size("line_items") - 1, F.lit(0)))).otherwise(F.col("line_items"))
    return pages.select("page_id", "doc_id", "page", head_a.alias("head_a"), F.struct(rows.alias("line_items")).alias("head_b"), "has_header", "has_totals", "duplicate_row_reprinted")


def append_records(rows: DataFrame, path: str) -> None:
    """Append-only: corrections and redaction records."""
    rows.write.mode("append").json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORRECTION).json(path)


def latest_corrections(log: DataFrame, keys: tuple[str, ...] = ("page_id", "field"), time: str = "logged_at", tie: str | None = None) -> DataFrame:
    """The last entry for each page and field."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, top, left, text) of text files, whole files read."""
    from ..functions.text import lines

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.inline(lines(F.col("value"))))
    return files


def write_documents(rows: DataFrame, path: str) -> None:
    """Documents as text and as truth: ``texts`` (doc_id, text) and ``truths`` (doc_id, truth, meta)."""
    rows.select("doc_id", "text").write.mode("overwrite").json(f"{path}/texts")
    rows.select("doc_id", "truth", "meta").write.mode("overwrite").json(f"{path}/truths")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, truth, meta), in order of doc_id."""
    texts = spark.read.schema("doc_id string, text string").json(f"{path}/texts")
    truths = spark.read.schema(f"doc_id string, truth {RAW_SCHEMA.simpleString()}, meta map<string,string>").json(f"{path}/truths")
    return texts.join(truths, "doc_id").orderBy("doc_id")
