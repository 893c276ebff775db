"""Connected components of links, by large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _nearest(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the least node it sees."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _nearest(down)
    moved = down.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(near.select("u", F.col("m").alias("v")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all linked nodes, component the least node reachable.

    A node's links are reduced to one minimum before the shuffle, and the join with the
    minima splits nodes of many links; the table shrinks to a star for each component.
    """
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state[0] == 0 or state == before:
            break
        before = state
        last, edges = edges, written(_small_star(_large_star(edges).where("u <> v").distinct()).where("u <> v").distinct(), "links")
        forget(last)
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)
