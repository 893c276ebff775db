"""Nearest neighbours by largest inner product: a vantage-point tree for each shard.

Vectors get one component more, which makes all norms equal; then the nearest by
Euclidean distance are those of the largest inner product, and the triangle inequality
prunes: a subtree whose distances from its vantage point lie in [low, high] can't hold a
vector nearer to the query than max(low - d, d - high). Subtrees are skipped where
``factor`` times that bound exceeds the query's 20th nearest so far; factor 1
skips nothing that counts, so results are exact; a greater one skips more.

Rows are dealt into shards by hash, queries into blocks; each shard meets
each block once, and gives that block's 20 nearest of that shard, from which the nearest
of all are taken. Shards and blocks have a bounded number of rows and of bytes, however long the vectors. Queries are a twentieth of the rows, so it
is blocks that are sent to every shard. Each shard's tree is descended: every query goes to the leaf it falls in first,
then down again through all that the bound leaves.

Vectors of different lengths have no inner product, so each length is a space of its own, with shards, blocks
and norms of its own.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as queries or candidates; a query's candidates are the vectors of its own
length; rows are told apart by a private key, so of rows that share an id each is a candidate of the others, each query has
a list of its own, and only the query's own row is left out; rows with a null id take no part; queries with
no candidate give no rows; ties go to the smaller id; other columns are neither needed nor returned, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits, table, written

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 32768, 4096, 256
PACK_BYTES = 16 << 20  # of vectors in a shard or block
TOP = 20


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str, asked: Column) -> DataFrame:
    """vec_id, v (array<double>), its length n and whether the row is a query, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.select(F.col(id_col).alias("vec_id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked")).where("vec_id is not null and v is not null").where(fine)
    return good.withColumn("n", F.size("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks)
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(lists), -1)


class Tree:
    """A vantage-point tree over the rows of x. A node is a leaf's number, or a vantage row with its two sides
    as (low, high, node), the distances from the vantage point that the side's rows lie in."""

    def __init__(self, x: np.ndarray, leaf_rows: int):
        self.x, self.leaf_rows, self.leaves = x, leaf_rows, []
        self.root = self._node(np.arange(len(x)))

    def _node(self, rows: np.ndarray):
        if len(rows) > self.leaf_rows:
            far = self.x[rows] - self.x[rows].mean(axis=0)
            pick = int(rows[int((far * far).sum(axis=1).argmax())])
            gap = self.x[rows] - self.x[pick]
            d = np.sqrt((gap * gap).sum(axis=1))
            near = d <= np.median(d)
            if near.all():
                near = d < d.max()
            if near.any() and not near.all():
                return pick, [(float(d[side].min()), float(d[side].max()), self._node(rows[side])) for side in (near, ~near)]
        self.leaves.append(rows)
        return len(self.leaves) - 1


def search(q_keys: np.ndarray, q: np.ndarray, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, top_norm: float, factor: float, k: int, leaf_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row number, score) of each query's nearest; exact scores, ties by id."""
    lift = np.sqrt(np.maximum(0, top_norm**2 - (x * x).sum(axis=1)))
    tree = Tree(np.hstack([x, lift[:, None]]), leaf_rows)
    q2 = (q * q).sum(axis=1)
    slack = 1e-9 * (np.sqrt(q2) * top_norm + 1)
    best = np.full((len(q), k), -np.inf)
    home = np.full(len(q), -1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def away(some: np.ndarray, vantage: int) -> np.ndarray:
        return np.sqrt(np.maximum(0, q2[some] + top_norm**2 - 2 * q[some] @ x[vantage]))

    def visit(leaf: int, some: np.ndarray) -> None:
        rows = tree.leaves[leaf]
        near = q[some] @ x[rows].T
        near[q_keys[some][:, None] == keys[rows][None, :]] = -np.inf
        a, b = np.nonzero(near >= (best[some, 0] - slack[some])[:, None])
        a, b = a[ok := np.isfinite(near[a, b])], b[ok]
        found.append((some[a], rows[b], (q[some[a]] * x[rows[b]]).sum(axis=1)))
        both = np.hstack([best[some], near])
        both.partition(both.shape[1] - k, axis=1)
        best[some] = np.sort(both[:, -k:], axis=1)

    def settle(node, some: np.ndarray) -> None:
        """Each query to the leaf on its own side of every vantage point."""
        if not len(some):
            return
        if isinstance(node, int):
            home[some] = node
            visit(node, some)
            return
        d = away(some, node[0])
        one, other = (np.maximum(low - d, d - high) for low, high, _ in node[1])
        settle(node[1][0][2], some[one <= other])
        settle(node[1][1][2], some[one > other])

    def descend(node, some: np.ndarray, bound: np.ndarray) -> None:
        """All other leaves that may hold one of the k nearest."""
        reach = np.sqrt(np.maximum(0, q2[some] + top_norm**2 - 2 * (best[some, 0] - slack[some])))  # infinite until k are found
        some, bound = some[keep := factor * bound <= reach], bound[keep]
        if isinstance(node, int):
            some = some[home[some] != node]
            if len(some):
                visit(node, some)
            return
        if not len(some):
            return
        d = away(some, node[0])
        sides = [(np.maximum(bound, np.maximum(low - d, d - high)), child) for low, high, child in node[1]]
        for low, child in sorted(sides, key=lambda s: float(s[0].mean())):
            descend(child, some, low)

    every = np.arange(len(q))
    settle(tree.root, every)
    descend(tree.root, every, np.zeros(len(q)))
    a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = s >= (best[a, 0] - slack[a])
    a, b, s = a[keep], b[keep], s[keep]
    order = np.lexsort((ids[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    start = np.searchsorted(a, a)
    first = np.arange(len(a)) - start < k
    return a[first], b[first], s[first]


def _packed(rows: pa.Table, key: str) -> pa.Table:
    """All rows of a group as one Arrow stream."""
    sink = pa.BufferOutputStream()
    kept = rows.select(["key", "vec_id", "v"])
    with pa.ipc.new_stream(sink, kept.schema) as out:
        out.write_table(kept)
    return pa.table({"n": rows.column("n").slice(0, 1), key: rows.column(key).slice(0, 1), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpacked(data: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = pa.ipc.open_stream(data.as_buffer()).read_all()
    return np.asarray(rows.column("key")), np.asarray(rows.column("vec_id")), _matrix(rows.column("v"))


def nearest(
    rows: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, factor: float = 1.0,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf_rows: int = LEAF_ROWS, pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest other rows of each row for which ``asked`` holds."""
    good = written(valid_vectors(rows, id_col, vector_col, asked).withColumn("key", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    held = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(pack_bytes) / (8 * F.col("n")))))
    parts = lambda count, most: F.ceil(count / F.first(held(most))).cast("int")
    shape = good.groupBy("n").agg(
        parts(F.count("*"), shard_rows).alias("shards"), parts(F.count_if("asked"), block_rows).alias("blocks"), (F.sqrt(F.max(square)) * (1 + 1e-12)).alias("norm")
    )
    shape = written(shape.where("blocks > 0"), "vector-shapes")  # a row for each length
    shape = F.broadcast(shape) if fits(shape) else shape
    deal = lambda name: F.pmod(F.xxhash64(F.lit(name), "key"), F.col(f"{name}s")).cast("int").alias(name)
    index = good.join(shape, "n").select("n", deal("shard"), "key", "vec_id", "v")
    index = index.groupBy("n", "shard").applyInArrow(lambda t: _packed(t, "shard"), "n int, shard int, data binary")
    packs = good.where("asked").join(shape, "n").select("n", deal("block"), "key", "vec_id", "v")
    packs = packs.groupBy("n", "block").applyInArrow(lambda t: _packed(t, "block"), "n int, block int, data binary")
    pairs = packs.join(shape, "n").select("n", "norm", "data", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, norm in zip(batch.column("index"), batch.column("data"), batch.column("norm").to_pylist(), strict=True):
                (keys, ids, x), (q_keys, q_ids, q) = _unpacked(shard), _unpacked(block)
                a, b, s = search(q_keys, q, keys, ids, x, norm, factor, k, leaf_rows)
                yield pa.RecordBatch.from_arrays([pa.array(q_keys[a]), pa.array(q_ids[a]), pa.array(ids[b]), pa.array(s)], names=["query", "query_id", "vec_id", "score"])

    met = pairs.join(index.withColumnRenamed("data", "index"), ["n", "shard"]).select("index", "data", "norm")
    kind = rows.schema[id_col].dataType.simpleString()
    found = met.mapInArrow(meet, f"query bigint, query_id {kind}, vec_id {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
