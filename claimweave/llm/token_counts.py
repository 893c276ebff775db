"""Token counts as delta-maintained rollups.

Totals by (source, lang, tokenizer) are kept as signed deltas. A batch of changes
(insert, delete, or revise with the count before and after) is reduced to one signed row
for each group and committed as one folder ``batch=<id>`` of the rollup. Writing a
batch again replaces that folder by the same rows, so a batch that is sent twice, or
whose first attempt died half-way, counts once. Totals are the sums over committed
batches. ``compact`` folds batches into one and keeps their ids.

Sums are additive, so a hot group is pre-aggregated in every task before the
shuffle; what is stored and read again has the size of the groups, not of the corpus.

Defined cases: a null text has no tokens; null source, lang or tokenizer are groups of
their own; an empty batch commits no rows; groups whose documents and tokens are
both zero again are left out; repeated rows count each time, as each is a change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, shared_folder, table

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "batch string, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
#: Tokenizer versions: runs outside white space, and runs of letters or digits or single signs.
TOKENIZERS = {"space-1": r"[^\x20\x09-\x0D]+", "word-2": r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """The number of tokens, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[tokenizer])).cast("long")


def inserts(counted: DataFrame) -> DataFrame:
    """Changes that add documents; ``counted`` has source, lang, tokenizer and n_tokens."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    return inserts(counted).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(counted: DataFrame, before: str = "n_before", after: str = "n_after") -> DataFrame:
    """Changes of counts alone: the documents stay."""
    delta = F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))
    return counted.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), delta.cast("long").alias("n_tokens"))


class Rollup:
    """The totals under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _folder(self, batch: str) -> str:
        if not batch or any(c in batch for c in "/=\\"):
            raise ValueError(f"{batch!r} is no batch id")
        return f"{self.path}/batch={batch}"

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch, unless it is committed already; says which."""
        folder = self._folder(batch)
        fs, _ = self._fs()
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if fs.exists(done) or batch in self._folded():
            return False
        delta = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.withColumn("folded", F.lit(None).cast("array<string>")).write.mode("overwrite").parquet(folder)
        return True

    def _committed(self) -> list[str]:
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = [x.getPath() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("batch=")]
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(p.toString() for p in names if fs.exists(path(p, "_SUCCESS")))

    def _stored(self, folders: list[str]) -> DataFrame:
        schema = SCHEMA.removeprefix("batch string, ") + ", folded array<string>"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _folded(self) -> set[str]:
        """Ids of batches inside compacted ones: a few, one row each compaction."""
        compacted = [f for f in self._committed() if "/batch=compacted-" in f]
        return {b for row in self._stored(compacted).where("folded is not null").select("folded").collect() for b in row[0]}

    def _live(self) -> list[str]:
        folded = self._folded()
        return [f for f in self._committed() if f.rpartition("batch=")[2] not in folded]

    def totals(self) -> DataFrame:
        rows = self._stored(self._live()).where("folded is null")
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """One batch in place of all; their ids stay known, so none can be committed again."""
        live = self._live()
        ids = sorted({f.rpartition("batch=")[2] for f in live} | self._folded())
        note = self.spark.createDataFrame([(None, None, None, 0, 0, ids)], self._stored([]).schema)
        rows = self.totals().withColumn("folded", F.lit(None).cast("array<string>")).unionByName(note)
        rows.coalesce(1).write.mode("overwrite").parquet(self._folder(f"compacted-{uuid.uuid4().hex}"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under both tokenizers, by way of signed batches: all are inserted under space-1, then under word-2,
    ids divisible by 7 with a stale count, that of space-1; ids divisible by 10 are deleted under both as they
    stand, in a batch that is sent twice, and inserted again as they should be; the other stale counts are revised.
    The totals are those of a full recount."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    counts = docs.select("doc_id", "source", "lang", count_tokens(F.col("text"), "space-1").alias("a"), count_tokens(F.col("text"), "word-2").alias("b"))
    counts = counts.withColumn("stood", F.when(F.expr("doc_id % 7 = 0"), F.col("a")).otherwise(F.col("b"))).persist()
    under = lambda rows, name, n: rows.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(n).alias("n_tokens"))
    rollup = Rollup(spark, f"{shared_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}")
    rollup.commit("1-insert", inserts(under(counts, "space-1", "a")))
    rollup.commit("2-insert", inserts(under(counts, "word-2", "stood")))
    tenth = counts.where("doc_id % 10 = 0")
    gone = deletes(under(tenth, "space-1", "a").unionAll(under(tenth, "word-2", "stood")))
    rollup.commit("3-delete", gone)
    rollup.commit("3-delete", gone)
    rollup.commit("4-insert", inserts(under(tenth, "space-1", "a").unionAll(under(tenth, "word-2", "b"))))
    stale = counts.where("doc_id % 7 = 0 and doc_id % 10 <> 0").withColumn("tokenizer", F.lit("word-2"))
    rollup.commit("5-revise", revisions(stale, "stood", "b"))
    counts.unpersist()
    return rollup.totals()


OP10_SQL = r"""
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens
FROM (
  SELECT source, lang, 'space-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
  UNION ALL
  SELECT source, lang, 'word-2', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]+|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]'))
  FROM documents)
GROUP BY ALL
"""
