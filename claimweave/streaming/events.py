"""Streams: corrections as they arrive, windows over events, sessions, pages that become claims.

Each has a batch form with the same rows, which its oracle states in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType


def timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """With a time that watermarks take."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total); on a stream, windows close ``late`` after their end."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


BUCKETS = 64


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in one that begin with ``prefix``, without it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName().removeprefix(prefix) for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix)] if fs.exists(at) else []


def _forget(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """The finished versions of each bucket of a table of ``latest_by_key``, in order."""
    out: dict[int, list[int]] = {}
    done = sorted(int(v) for v in _children(spark, path, "v="))
    for v in done:
        if (before is None or v < before) and _children(spark, f"{path}/v={v}", "_SUCCESS"):
            for b in _children(spark, f"{path}/v={v}", "bucket="):
                out.setdefault(int(b), []).append(v)
    return out


def read_latest(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The rows of a table of ``latest_by_key``: of each bucket (or of those named) the last version."""
    of = {b: vs[-1] for b, vs in _versions(spark, path, before).items() if buckets is None or b in buckets}
    paths = [f"{path}/v={v}/bucket={b}" for b, v in sorted(of.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def latest_by_key(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("page_id", "field"), time: str = "logged_at", buckets: int = BUCKETS, late: str = "1 hour"):
    """Keeps a table of the latest entry of each key, in buckets of keys; the query that was started is returned.

    An entry that is delivered again (all values the same) within ``late`` of its arrival is dropped by the stream's own state. A micro-batch reads and
    writes only the buckets that its keys are in, under its number (``v=<number>/bucket=<bucket>``); a version counts once its
    ``_SUCCESS`` is there. A batch that is run again reads versions before its own, so it writes the same rows. Of a bucket the last two
    versions are kept, for readers that began before.
    """
    from ..sources.manifest import latest_corrections

    columns = stream.columns

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_corrections(batch.select(*columns), keys, time).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets, at most
            if touched:
                old = read_latest(spark, path, batch.select(*columns).schema, touched, before=number)
                both = latest_corrections(old.unionByName(new.drop("bucket")), keys, time).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
                both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
                for bucket, versions in _versions(spark, path).items():
                    for gone in versions[:-2] if bucket in touched else ():
                        _forget(spark, f"{path}/v={gone}/bucket={bucket}")
        finally:
            new.unpersist()

    # By the time of arrival: by the entries' own time, a correction that comes late would be lost.
    once = stream.withColumn("_at", F.current_timestamp()).withWatermark("_at", late).dropDuplicatesWithinWatermark([c for c in columns])
    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


PAGES = "doc_id string, page_index int, total_pages int, amount decimal(18,2)"
COMPLETE = "doc_id string, n_pages int, total_cents bigint"


class _Pages(StatefulProcessor):
    """Pages of one document: what was seen, how many are wanted, when to stop waiting, and whether it was given."""

    def __init__(self, wait: int, remember: int):
        self.wait, self.remember = wait, remember

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "page int", "cents bigint")
        self.wanted = handle.getValueState("wanted", "n int, until bigint")
        self.given = handle.getValueState("given", "given boolean", self.remember)

    def _give(self, key: tuple) -> Row:
        cents = [c for (c,) in self.seen.values()]
        self.seen.clear()
        self.wanted.clear()
        self.given.update((True,))
        return Row(doc_id=key[0], n_pages=len(cents), total_cents=sum(cents))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        pages = [r for r in rows if r["page_index"] is not None]
        if self.given.exists() or not pages:
            return
        n, until = self.wanted.get() if self.wanted.exists() else (0, None)
        for r in pages:
            if not self.seen.containsKey((r["page_index"],)):
                self.seen.updateValue((r["page_index"],), (0 if r["amount"] is None else int(r["amount"] * 100),))
            n = n if r["total_pages"] is None else r["total_pages"]
        if until is not None:
            self.handle.deleteTimer(until)
        if 0 < n <= sum(1 for _ in self.seen.keys()):
            yield self._give(key)
            return
        until = timerValues.getCurrentProcessingTimeInMs() + self.wait
        self.wanted.update((n, until))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.wanted.exists() and not self.given.exists():
            yield self._give(key)

    def close(self) -> None:
        pass


def complete_documents(pages: DataFrame, timeout: str = "1 hour", remember: str = "7 days") -> DataFrame:
    """(doc_id, n_pages, total_cents): a document as soon as its last page is there, whatever the order of pages.

    A page that comes twice counts once, one without a number not at all; a null amount adds nothing, and a null number of
    pages leaves what was known. What is incomplete waits until no page has come for ``timeout``, and is then given with the pages it has.
    That a document was given is remembered for that long after (``remember``), so pages that come late or again give no second row;
    its pages are forgotten at once. State is kept in RocksDB, page by page. Timers go by the clock, so a query with the trigger ``availableNow`` doesn't end by itself.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ms = lambda span: int(pd.Timedelta(span).total_seconds() * 1000)
    return pages.groupBy("doc_id").transformWithState(_Pages(ms(timeout), ms(remember)), COMPLETE, "Append", "ProcessingTime")
