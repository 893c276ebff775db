"""Streams give what their batch forms give."""

import collections
import datetime
import json
import time

from pyspark.sql import functions as F

from claimweave.sources import manifest
from claimweave.streaming import events

SF = "/root/testdata/sf0.001"


def test_windows(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_type", "value")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    query = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, events.tumbling(rows).collect()))


def run_as_stream(spark, tmp_path, make, name):
    """Rows of a windowed stream of events in append mode: one file with all, then a late event that moves the watermark past them."""
    rows = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    last = rows.agg(F.max("ts")).first()[0]
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(-1, last + datetime.timedelta(days=9), "end", 0.0)], rows.schema).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return collections.Counter(map(tuple, spark.table(name).collect())), collections.Counter(map(tuple, make(rows).collect()))


def test_sliding_windows_as_a_stream(spark, tmp_path):
    got, want = run_as_stream(spark, tmp_path, events.sliding, "slid")
    assert got == want


def test_sessions_as_a_stream(spark, tmp_path):
    got, want = run_as_stream(spark, tmp_path, events.sessions, "sat")
    assert got == want


def test_corrections(spark, tmp_path):
    def log(*rows):
        manifest.append_records(spark.createDataFrame([(p, "f", None, v, None, at, None) for p, v, at in rows], manifest.CORRECTION), f"{tmp_path}/log")

    def run():
        stream = spark.readStream.schema(manifest.CORRECTION).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/log")
        events.latest_by_key(stream, f"{tmp_path}/out", f"{tmp_path}/ck", buckets=8).awaitTermination()
        return {r["page_id"]: r["corrected"] for r in events.read_latest(spark, f"{tmp_path}/out", spark.createDataFrame([], manifest.CORRECTION).schema).collect()}

    for i, at in enumerate(("2025-01-02", "2025-01-03", "2025-01-01")):
        log(("p1", f"v{i}", at))
    assert run() == {"p1": "v1"}
    log(*((f"q{i}", "old", "2025-01-01") for i in range(40)))
    assert run() == {"p1": "v1"} | {f"q{i}": "old" for i in range(40)}
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("v=*/bucket=*/*.parquet")}
    log(("q3", "new", "2025-01-05"), ("q3", "new", "2025-01-05"))
    assert run() == {"p1": "v1"} | {f"q{i}": "old" for i in range(40)} | {"q3": "new"}
    last = max(int(v.name[2:]) for v in (tmp_path / "out").glob("v=*"))
    assert len(list((tmp_path / "out").glob(f"v={last}/bucket=*"))) == 1  # a batch of one key writes one bucket
    assert sum(p in before for p in (tmp_path / "out").glob("v=*/bucket=*/*.parquet")) >= len(before) - 1


def test_corrections_batch_run_again(spark, tmp_path):
    """What a batch writes hangs on versions before its own alone."""
    schema = spark.createDataFrame([], manifest.CORRECTION).schema
    row = lambda v, at: spark.createDataFrame([("p", "f", None, v, None, at, None)], schema).withColumn("bucket", F.lit(0))
    for number, (v, at) in enumerate((("a", "2025-01-01"), ("b", "2025-01-02"))):
        row(v, at).write.partitionBy("bucket").parquet(f"{tmp_path}/out/v={number}")
    assert [r["corrected"] for r in events.read_latest(spark, f"{tmp_path}/out", schema, before=1).collect()] == ["a"]
    (tmp_path / "out/v=1/_SUCCESS").unlink()
    assert [r["corrected"] for r in events.read_latest(spark, f"{tmp_path}/out", schema).collect()] == ["a"]


def test_complete_documents(spark, tmp_path):
    def arrive(n, *pages):
        rows = spark.createDataFrame(list(pages), "doc_id string, page_index int, total_pages int, amount string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return rows.schema

    def wait(n, seconds=90):
        until = time.monotonic() + seconds
        while spark.table("complete").count() < n and query.isActive and time.monotonic() < until:
            time.sleep(1)
        return sorted(map(tuple, spark.table("complete").collect()))

    schema = arrive(0, ("a", 2, 2, "1.50"), ("a", 1, 2, None), ("a", 1, 2, "9.00"), ("b", 1, None, "2.00"), ("b", None, 1, "7.00"), ("c", 1, 1, "0.29"))
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = events.complete_documents(stream, timeout="20 seconds").writeStream.outputMode("append").format("memory").queryName("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="1 second").start()
    try:
        assert wait(2) == [("a", 2, 150), ("c", 1, 29)]
        arrive(1, ("a", 1, 2, "1.00"), ("a", 2, 2, "5.00"), ("d", 1, 1, "1.00"))  # pages of a again, in a later batch
        assert wait(3) == [("a", 2, 150), ("c", 1, 29), ("d", 1, 100)]
        assert wait(4) == [("a", 2, 150), ("b", 1, 200), ("c", 1, 29), ("d", 1, 100)]  # b is given when its time is out
        arrive(2, ("b", 2, 2, "9.00"), ("e", 1, 1, "3.00"))  # a late page of b
        assert wait(5) == [("a", 2, 150), ("b", 1, 200), ("c", 1, 29), ("d", 1, 100), ("e", 1, 300)]
        time.sleep(25)
        assert len(spark.table("complete").collect()) == 5
    finally:
        query.stop()


def test_manifest(spark, tmp_path):
    rows = [{"page_id": f"p{i}", "doc_id": "d", "split": "val" if i else "train", "image": f"i{i}", "page": i} for i in (1, 0)]
    (tmp_path / "m.1.jsonl").write_text(json.dumps(rows[0]) + "\n\n")
    (tmp_path / "m.2.jsonl").write_text(json.dumps(rows[1]) + "\n" + json.dumps(rows[0]) + "\n")
    assert [r["page_id"] for r in manifest.merge_shards(spark, f"{tmp_path}/m.*.jsonl").collect()] == ["p0", "p1"]
    assert manifest.read_manifest(spark, f"{tmp_path}/m.1.jsonl", split="val").count() == 1
