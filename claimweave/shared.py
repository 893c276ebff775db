"""Tables in the folder that driver and executors share, which end a lineage, and what may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be broadcast, measured before it is.
MAX_BROADCAST_BYTES = 64 << 20


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="claimweave-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table there, read again: what follows doesn't compute them anew, on however many machines."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, most: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether rows of text and numbers take at most that many bytes, counted."""
    size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= most


def maybe_broadcast(df: DataFrame, most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if fits(df, most) else df
