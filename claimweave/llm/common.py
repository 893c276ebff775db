"""What several operators share: tables, ASCII folding, folds by checksum, the shared folder."""

from __future__ import annotations

import re
import string
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: What may be broadcast, measured before it is.
MAX_BROADCAST_BYTES = 64 << 20
ARROW_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Fixed values of the contracts: separators between words.
SPACES = r"[\x20\x09-\x0D]"
WORD_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
SHA_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts of ASCII alone take the faster function, which does the same to them."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column, separators: str = SPACES) -> Column:
    """The runs of characters outside ``separators``, lower-cased A-Z; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{separators}+")
    return F.array_remove(parts, "")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id, which belongs to no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is made only where both are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="claimweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and sizes are known exactly."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, BATCH_ROWS)  # whole texts go to Python as these many rows at a time
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether the rows take at most ``max_bytes`` as text and numbers, counted exactly: then they may be broadcast."""
    size = [F.coalesce(F.octet_length(F.to_json(F.struct(c)) if _nested(df, c) else F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns]
    total = df.agg(F.sum(sum(size[1:], size[0]))).first()[0]
    return (total or 0) <= max_bytes


def _nested(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, ArrayType | StructType)


def remembered(owner: str) -> dict:
    """What a worker process remembers from task to task, for one operator at a time: workers are used again, so what
    another operator left in this one is forgotten, and Arrow's unused memory goes back."""
    kept = sys.modules.setdefault("_claimweave_remembered", types.ModuleType("_claimweave_remembered")).__dict__
    if kept.get("owner") != owner:
        kept.clear()
        kept |= {"owner": owner, "of_owner": {}}
    pa.default_memory_pool().release_unused()
    return kept["of_owner"]


def private(name: str, *frames: DataFrame) -> str:
    """A column name like ``name`` that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; null for null."""
    return F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose keys aren't among the rows of ``gone``, null being equal to null.

    ``keys`` gives each column of ``gone`` as an expression of ``docs``. ``gone`` is broadcast only within
    ``MAX_BROADCAST_BYTES``; beyond that both sides are shuffled.
    """
    gone = written(gone.select(*keys).distinct(), "gone")
    ours = {c: private(f"_own_{c}", docs) for c in keys}
    theirs = gone.select(*(F.col(c).alias(private(f"_gone_{c}", docs)) for c in keys))
    same = [F.col(ours[c]).eqNullSafe(F.col(private(f"_gone_{c}", docs))) for c in keys]
    test = same[0]
    for s in same[1:]:
        test &= s
    if fits(gone):
        theirs = F.broadcast(theirs)
    return docs.withColumns({ours[c]: e for c, e in keys.items()}).join(theirs, test, "left_anti").select(*docs.columns)
