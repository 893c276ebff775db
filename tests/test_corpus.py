"""The corpus writer and the data source of bills."""

import pytest
from pyspark.sql import functions as F

from claimweave import corpus
from claimweave.operators import generate
from claimweave.operators.documents import normalize_document
from claimweave.sources import manifest
from claimweave.sources.bills import BillFolder


def files(path):
    return {str(p.relative_to(path)): p.read_bytes() for p in path.rglob("part-*")}


def test_shards_and_merge(spark, tmp_path):
    out = f"{tmp_path}/corpus"
    counts = [corpus.build_shard(spark, out, 30, shard=s, shards=3) for s in range(3)]
    whole = corpus.merge(spark, out)
    assert sum(c["documents"] for c in counts) == whole["documents"] == 30 and sum(c["pages"] for c in counts) == whole["pages"]
    assert corpus.build_shard(spark, out, 30, shard=1, shards=3) == counts[1] and corpus.merge(spark, out) == whole  # run again, nothing changes
    assert spark.read.text(f"{out}/corpus_hash").first()[0] == whole["corpus_sha256"]
    one = corpus.build_shard(spark, f"{tmp_path}/one", 30)
    assert one["pages"] == whole["pages"]
    hashes = lambda folder: {r["page_id"]: r["sha256"] for r in manifest.read_manifest(spark, folder).collect()}
    assert hashes(f"{out}/merged") == hashes(f"{tmp_path}/one/manifest/shard=0")
    assert corpus.build_shard(spark, f"{tmp_path}/few", 30, max_pages=7)["pages"] == 7
    # A shard that was stopped has no manifest and isn't merged.
    corpus._remove(spark, f"{out}/manifest/shard=2")
    assert corpus.merge(spark, out)["documents"] == 20


def test_pages_and_targets(spark, tmp_path):
    out = f"{tmp_path}/corpus"
    corpus.build_shard(spark, out, 40)
    pages = spark.read.parquet(f"{out}/pages/shard=0")
    targets = spark.read.schema(manifest.page_targets(pages).schema).json(f"{out}/targets/shard=0")
    rows = targets.groupBy("doc_id").agg(F.sum(F.size("head_b.line_items")).alias("n"), F.count_if("has_header").alias("heads"), F.count_if("has_totals").alias("ends"))
    truth = generate.documents(spark, 40).select("doc_id", F.size("truth.line_items").alias("want"))
    assert rows.join(truth, "doc_id").where("n <> want or heads <> 1 or ends <> 1").count() == 0 and rows.count() == 40
    again = pages.where("duplicate_row_reprinted")
    assert again.count() > 0 and pages.where("total_pages > 1").count() > 0
    assert manifest.read_manifest(spark, f"{out}/manifest/shard=0", split="train").count() > 0
    shown = manifest.read_manifest(spark, f"{out}/manifest/shard=0").join(targets.select("page_id", F.size("head_b.line_items").alias("n")), "page_id")
    assert shown.where("n <> n_line_items").count() == 0


def test_repack(spark):
    rows = spark.createDataFrame([("p1", "a.png", "x"), ("p2", "b.png", "y")], "page_id string, image string, sha256 string")
    new = spark.createDataFrame([("a.png", "a.jpg", "z")], "image string, new_image string, sha256 string")
    assert sorted(map(tuple, corpus.repack(rows, new).collect())) == [("p1", "a.jpg", "z"), ("p2", "b.png", "y")]


def test_bills_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(BillFolder)
    docs = generate.documents(spark, 23).select("doc_id", generate.printed_text(F.col("truth")).alias("text"), F.to_json("truth").alias("truth"), "meta").repartition(4).persist()
    docs.write.format("bills").mode("append").save(f"{tmp_path}/bills")
    back = spark.read.format("bills").option("files", 5).load(f"{tmp_path}/bills")
    assert back.rdd.getNumPartitions() == 5
    key = lambda r: (r["doc_id"], r["text"], r["truth"], tuple(sorted(r["meta"].items())))
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    typed = back.select(normalize_document(F.from_json("truth", generate.documents(spark, 1).schema["truth"].dataType)).alias("d"))
    assert typed.where("d.patient.name is null").count() == 0
    assert sorted(p.name for p in (tmp_path / "bills").iterdir() if p.name.startswith(".")) == []
    before = files_of(tmp_path / "bills")
    bad = docs.withColumn("doc_id", F.when(F.col("doc_id").endswith("7"), F.lit("no/name")).otherwise(F.concat(F.lit("new-"), "doc_id")))
    with pytest.raises(Exception, match="no file name"):
        bad.write.format("bills").mode("append").save(f"{tmp_path}/bills")
    assert files_of(tmp_path / "bills") == before  # an aborted write leaves nothing
    docs.limit(2).write.format("bills").mode("overwrite").save(f"{tmp_path}/bills")
    assert spark.read.format("bills").load(f"{tmp_path}/bills").count() == 2
    (tmp_path / "bills/alone.txt").write_text("no truth")
    assert spark.read.format("bills").load(f"{tmp_path}/bills").count() == 2
    docs.unpersist()


def files_of(folder):
    return {p.name: p.read_bytes() for p in folder.rglob("*") if p.is_file()}
