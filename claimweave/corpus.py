"""The corpus: documents cut into pages, their targets, manifests by shard, and the merged manifest with its hash.

A shard is one pass over its documents: pages are made and written once, and targets, manifest and counts are read from what was written. The
manifest comes last, so a shard without one was not finished; running it again writes the same files. Shards are folders
(``pages/shard=2``, ``targets/shard=2``, ``manifest/shard=2``), made one by one or by many jobs at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.generate import documents, printed_text
from .operators.sampling import corpus_hash
from .sources import manifest as mf

ROWS_PER_PAGE = 6


def pages_of(docs: DataFrame, rows_per_page: int = ROWS_PER_PAGE) -> DataFrame:
    """(page_id, doc_id, page, total_pages, blocks, line_items, text, has_header, has_totals, duplicate_row_reprinted, meta) of documents (doc_id, truth, meta).

    The first page has the header, the last one the totals. Where meta says ``reprinted``, a page begins with the row that the page before ended with.
    """
    items, n = F.col("truth.line_items"), F.size("truth.line_items")
    total = F.greatest(F.lit(1), F.ceil(n / rows_per_page)).cast("int")
    cut = docs.select("*", total.alias("total_pages"), F.explode(F.sequence(F.lit(0), total - 1)).alias("page"))
    again = (F.col("page") > 0) & F.coalesce(F.col("meta")["reprinted"] == "true", F.lit(False))
    start = F.col("page") * rows_per_page - F.when(again, 1).otherwise(0)
    rows = F.slice(items, start + 1, F.lit(rows_per_page) + F.when(again, 1).otherwise(0))
    first, last = F.col("page") == 0, F.col("page") == F.col("total_pages") - 1
    shown = lambda block, flag: F.when(flag, F.col(f"truth.{block}")).alias(block)
    out = cut.select(
        F.concat("doc_id", F.lit("_p"), F.lpad(F.col("page").cast("string"), 2, "0")).alias("page_id"), "doc_id", "page", "total_pages", "meta",
        shown("hospital", first), shown("patient", first), shown("insurance", first), rows.alias("line_items"), shown("totals", last),
        first.alias("has_header"), last.alias("has_totals"), again.alias("duplicate_row_reprinted"),
    )
    printed = F.struct(*(F.col(c) for c in ("hospital", "patient", "insurance", "line_items", "totals")))
    return out.withColumn("text", printed_text(printed))


def _manifest(pages: DataFrame, shard: int) -> DataFrame:
    meta: Column = F.col("meta")
    names = ("split", "quality", "layout", "template", "language")
    return pages.select(
        "page_id", "doc_id", "page", "total_pages", F.concat(F.lit(f"pages/shard={shard}/"), "page_id").alias("image"), F.concat(F.lit(f"targets/shard={shard}/"), "page_id").alias("targets"),
        F.sha2("text", 256).alias("sha256"), *(meta[n].alias(n) for n in names), "has_header", "has_totals",
        (F.size("line_items") - F.col("duplicate_row_reprinted").cast("int")).alias("n_line_items"),
    )


def build_shard(spark: SparkSession, folder: str, n: int, seed: int = 1337, shard: int = 0, shards: int = 1, max_pages: int | None = None) -> dict:
    """Writes a shard and gives its counts: pages, documents and corpus_sha256. ``max_pages`` takes the first of the shard's pages, by id."""
    pages = pages_of(documents(spark, n, seed, shard, shards))
    if max_pages is not None:
        pages = pages.orderBy("page_id").limit(max_pages)
    at = lambda what: f"{folder}/{what}/shard={shard}"
    _remove(spark, at("manifest"))
    pages.write.mode("overwrite").parquet(at("pages"))
    pages = spark.read.schema(pages.schema).parquet(at("pages"))
    mf.page_targets(pages).write.mode("overwrite").json(at("targets"))
    rows = _manifest(pages, shard)
    mf.write_manifest(rows, at("manifest"))
    counts = rows.agg(F.count("*").alias("pages"), F.count_distinct("doc_id").alias("documents")).first().asDict()
    return counts | {"corpus_sha256": _hash(rows), "seed": seed}


def _hash(manifest: DataFrame) -> str:
    return corpus_hash(manifest.select(F.sha2(F.concat_ws(":", "page_id", "sha256"), 256).alias("h")), "h").first()[0]


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def merge(spark: SparkSession, folder: str) -> dict:
    """Writes ``merged``, the manifest of all finished shards in order of page, a page once, and the hash beside it; pages, documents and hash."""
    rows = mf.merge_shards(spark, f"{folder}/manifest/shard=*")
    mf.write_manifest(rows, f"{folder}/merged")
    done = mf.read_manifest(spark, f"{folder}/merged")
    counts = done.agg(F.count("*").alias("pages"), F.count_distinct("doc_id").alias("documents")).first().asDict() | {"corpus_sha256": _hash(done)}
    spark.createDataFrame([(counts["corpus_sha256"],)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/corpus_hash")
    return counts


def repack(manifest: DataFrame, encoded: DataFrame) -> DataFrame:
    """The manifest after images were encoded anew: ``encoded`` is (image, new_image, sha256); pages without a new image stay as they are."""
    new = encoded.select("image", "new_image", F.col("sha256").alias("_sha256"))
    both = manifest.join(new, "image", "left")
    made = {"image": F.coalesce("new_image", "image"), "sha256": F.coalesce("_sha256", "sha256")}
    return both.select(*(made.get(c, F.col(c)).alias(c) for c in manifest.columns))
