"""Hard negatives by a distributed kNN join over Voronoi cells.

Vectors get one component more, which makes all norms M; anchors get a zero there. Then the squared distance of an anchor
and a row is |a|^2 + M^2 - 2 * (inner product), so large products are small distances. Pivots are a bounded
sample of rows; every row belongs to the cell of its nearest pivot, with its distance to it, and so do anchors. Neighbouring
cells are put together to groups of up to ``GROUP_ROWS`` anchors, and a cell with more is split, so the copies of a row grow with the
number of anchors and not with that of cells. Counts and least and greatest distances of each cell and label bound how far
the rows that a group needs can be: for positives, as far as cells nearby surely hold enough rows of the label; for
negatives, the distances between which 30 and 90 hundredths of the positive scores lie, and no farther than cells that surely lie
between them hold enough rows. A row is sent to a group only if its distance to its own pivot doesn't exclude it by
the triangle inequality. Each group meets its rows in chunks of bounded size, in a local exact join by matrix products, and
the first of each chunk are merged.

Pivots are at most ``MAX_PIVOTS`` for a vector length, one for ``CELL_ROWS`` rows, drawn by hash; where all of them together don't fit in what
may be broadcast, the origin is the only one, which costs pruning and no result. Bounds are widened by a slack for rounding.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; neither do doubles beyond 1e140, whose
squares aren't finite; vectors of another length are of another space; rows that share an id are rows each, and an anchor's
own row is no positive of it, but another row of its id may be; an anchor without positives gives no rows, nor does a positive
without negatives; ties go to the smaller id; products are exact integers, those beyond 64 bits held at its ends; empty tables give
no rows; other columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits, table, written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
CELL_ROWS, MAX_PIVOTS, GROUP_ROWS, CHUNK_ROWS, CHUNK_BYTES = 2048, 1024, 512, 8192, 16 << 20
HOME = ["n", "home", "part"]  # vector length, the cell of the anchors, and a share of them: what has bounds
GROUP = ["n", "team"]  # the anchors that meet rows together


def prepared(rows: DataFrame, vec_id: Column, label: Column, vector: Column, anchor: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, anchor, v (whole numbers as doubles) and their number n, of the rows that take part."""
    found = rows.select(vec_id.alias("vec_id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), vector.cast("array<double>").alias("x"))
    found = found.where("vec_id is not null and label is not null and x is not null").where(F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < 1e140)))
    whole = F.transform("x", lambda c: F.rint(c * scale) - F.when(F.rint(c * scale) > c * scale, 1.0).otherwise(0.0))  # floor as a double
    return found.select("vec_id", "label", "anchor", whole.alias("v"), F.size("x").alias("n"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), n)


def _lift(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, norm**2 - (x * x).sum(axis=1)))[:, None]])


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row of x, and its distance, by differences, as products of close vectors cancel."""
    at = (((pivots * pivots).sum(axis=1)[None, :]) - 2 * (x @ pivots.T)).argmin(axis=1)
    gap = x - pivots[at]
    return at, np.sqrt((gap * gap).sum(axis=1))


class Space:
    """Norms and pivots of each vector length; what the tasks are given."""

    def __init__(self, norms: dict[int, float], pivots: dict[int, np.ndarray]):
        self.norms = norms
        self.pivots = {n: _lift(pivots[n], norm) if n in pivots else np.zeros((1, n + 1)) for n, norm in norms.items()}

    def cells(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the cell and distance of the row, and of the anchor where it is one."""
        for batch in batches:
            length = batch.column("n").to_numpy()
            for n in np.unique(length).tolist():
                some = batch.take(pa.array(np.flatnonzero(length == n)))
                x, pivots = _matrix(some.column("v"), n), self.pivots[n]
                cell, d = _nearest_pivot(_lift(x, self.norms[n]), pivots)
                home, far = _nearest_pivot(np.hstack([x, np.zeros((len(x), 1))]), pivots)
                more = [pa.array(c) for c in (cell.astype(np.int32), d, home.astype(np.int32), far, (x * x).sum(axis=1))]
                yield pa.RecordBatch.from_arrays([*some.columns, *more], names=[*some.schema.names, "cell", "d", "home", "far", "square"])

    def teams(self, counts: pd.DataFrame, most: int) -> pd.DataFrame:
        """n, home, parts and team of cells with so many anchors (n, home, count): cells in the order of their pivots along the
        axis of greatest spread fill a team up, a cell of more is shared out to teams of its own."""
        out, team = [], -1
        for n, of in counts.groupby("n"):
            pivots = self.pivots[n] - self.pivots[n].mean(axis=0)
            along = pivots @ np.linalg.svd(pivots, full_matrices=False)[2][0]
            held = most + 1  # a length begins a team
            for home, count in sorted(zip(of["home"], of["count"], strict=True), key=lambda c: (along[c[0]], c[0])):
                parts = -(-count // most)
                if parts > 1:
                    out.append((n, home, parts, team + 1))
                    team, held = team + parts, most + 1
                    continue
                if held + count > most:
                    team, held = team + 1, 0
                held += count
                out.append((n, home, 1, team))
        return pd.DataFrame(out, columns=["n", "home", "parts", "team"]).astype("int32")

    def gap(self) -> Callable[..., Column]:
        """The distance between two pivots of a length."""

        @F.pandas_udf("double")
        def between(n: pd.Series, one: pd.Series, other: pd.Series) -> pd.Series:
            out = np.zeros(len(n))
            for k in n.unique():
                at = (n == k).to_numpy()
                away = self.pivots[k][one[at]] - self.pivots[k][other[at]]
                out[at] = np.sqrt((away * away).sum(axis=1))
            return pd.Series(out)

        return between


def space_of(rows: DataFrame, cell_rows: int = CELL_ROWS, most: int = MAX_PIVOTS) -> tuple[Space, DataFrame]:
    """Norms, pivots, and a table of n, norm, pivots (their number) and slack."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    shape = rows.groupBy("n").agg(F.count("*").alias("rows"), (F.sqrt(F.max(square)) * (1 + 1e-12)).alias("norm"))
    shape = written(shape.withColumn("wanted", F.least(F.ceil(F.col("rows") / cell_rows), F.lit(most)).cast("int")), "negatives-shapes")
    shape_side = F.broadcast(shape) if fits(shape) else shape
    place = F.xxhash64(F.lit("pivot"), "vec_id", "v")
    few = F.pmod(place, F.lit(1 << 40)) < F.lit(float(1 << 40)) * (4 * F.col("wanted") + 64) / F.col("rows")
    drawn = rows.join(shape_side, "n").where(few).groupBy("n", "v", "wanted").agg(F.min(place).alias("place"))
    drawn = written(drawn.withColumn("i", F.row_number().over(Window.partitionBy("n").orderBy("place"))).where("i <= wanted").select("n", "v"), "negatives-pivots")
    pivots: dict[int, np.ndarray] = {}
    if fits(drawn):
        for n, of in drawn.toPandas().groupby("n")["v"]:
            pivots[n] = np.array(of.tolist(), float).reshape(len(of), n)
    space = Space({r["n"]: r["norm"] for r in shape.select("n", "norm").collect()}, pivots)
    numbers = pd.DataFrame({"n": list(space.pivots), "pivots": [len(p) for p in space.pivots.values()]}, dtype="int32")
    counted = rows.sparkSession.createDataFrame(numbers, "n int, pivots int")
    return space, shape_side.select("n", "norm", (F.col("norm") * 1e-6 + 1e-6).alias("slack")).join(F.broadcast(counted), "n")


def _exact(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: by doubles where these are exact, else by Python's integers."""
    if a.size and c.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(c).max()) >= 2**53:
        whole = np.frompyfunc(int, 1, 1)
        return whole(a) @ whole(c).T
    return a @ c.T


def _first(score: np.ndarray, fine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest fine scores of each row; the columns come in the order that settles ties."""
    if score.dtype == object:
        order = [(i, j) for i in range(len(score)) for j in sorted(np.flatnonzero(fine[i]), key=lambda j: (-score[i, j], j))[:k]]
        return np.array([i for i, _ in order], int), np.array([j for _, j in order], int)
    score = np.where(fine, score, -np.inf)
    least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(score), -np.inf)
    i, j = np.nonzero(fine & (score >= least[:, None]))
    order = np.lexsort((j, -score[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep]


def _longs(values) -> pa.Array:
    return pa.array([max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in values], pa.int64())


def _by_id(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("vec_id", "ascending"), ("key", "ascending")])


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def join(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            n, rows = anchors.column("n")[0].as_py(), _by_id(rows)
            x, key, label = _matrix(rows.column("v"), n), rows.column("key").to_numpy(), rows.column("label").to_numpy()
            for at in range(0, anchors.num_rows, 64):
                some = anchors.slice(at, 64)
                own, theirs = some.column("key").to_numpy(), some.column("label").to_numpy()
                score = _exact(_matrix(some.column("v"), n), x)
                i, j = _first(score, (own[:, None] != key[None, :]) & (theirs[:, None] == label[None, :]), k)
                out.append(pa.table([pa.array(own[i]), pa.array(key[j]), rows.column("vec_id").take(pa.array(j)), _longs(score[i, j])], names=["anchor", "key", "vec_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), rows.column("vec_id").type, pa.int64())], names=["anchor", "key", "vec_id", "score"])

    return join


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def join(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            n, rows = anchors.column("n")[0].as_py(), _by_id(rows)
            x, label = _matrix(rows.column("v"), n), rows.column("label").to_numpy()
            for at in range(0, anchors.num_rows, 64):
                some = anchors.slice(at, 64)
                own, theirs = some.column("key").to_numpy(), some.column("label").to_numpy()
                score, positive = _exact(_matrix(some.column("v"), n), x), some.column("positives").to_pylist()
                for p in range(max(map(len, positive))):
                    which = np.array([i for i, ps in enumerate(positive) if p < len(ps)])
                    ps = [positive[i][p] for i in which]
                    least, most = (np.array(b, score.dtype)[:, None] for b in ([-(-low * s // 100) for s in ps], [high * s // 100 for s in ps]))
                    part = score[which]
                    fine = (part >= least) & (part <= most) & (theirs[which][:, None] != label[None, :])
                    i, j = _first(part, fine.astype(bool), k)
                    out.append(pa.table([pa.array(own[which[i]]), pa.array(np.full(len(i), p + 1, np.int32)), rows.column("vec_id").take(pa.array(j)), _longs(part[i, j])], names=["anchor", "place", "vec_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), rows.column("vec_id").type, pa.int64())], names=["anchor", "place", "vec_id", "score"])

    return join


def _met(anchors: DataFrame, rows: DataFrame, routes: DataFrame, local: Callable[[pa.Table, pa.Table], pa.Table], made: str) -> DataFrame:
    """The local joins of each group with the rows that ``routes`` (cell, label, group, lo and hi) sends it, chunk by chunk."""
    routes = written(routes, "negatives-routes")
    size = F.least(F.lit(CHUNK_ROWS), F.greatest(F.lit(64), F.floor(F.lit(CHUNK_BYTES) / (8 * F.col("n") + 8)))).cast("long")
    chunks = routes.groupBy(*GROUP).agg(F.sum("rows").alias("rows")).withColumn("chunks", F.ceil(F.col("rows") / size).cast("int")).drop("rows")
    chunks = written(chunks, "negatives-chunks")
    side = lambda df: F.broadcast(df) if fits(df) else df
    ways = written(routes.join(side(chunks), GROUP).drop("rows"), "negatives-ways")
    sent = rows.select("n", "cell", "label", "d", "key", "vec_id", "v").join(side(ways), ["n", "cell", "label"]).where("d >= lo and d <= hi")
    sent = sent.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).select(*GROUP, "chunk", "key", "vec_id", "label", "v")
    asking = anchors.join(side(chunks), GROUP).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    key = [*GROUP, "chunk"]
    return asking.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(local, made)


def _pairs(groups: DataFrame, cells: DataFrame, shape: DataFrame, space: Space, same_label: bool) -> DataFrame:
    """Groups (by label) with each cell that holds rows of the label, or of other labels, and the bounds of distances between the two."""
    all_cells = groups.join(shape, "n").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("pivots") - 1)))
    theirs = cells.withColumnRenamed("label", "theirs")
    theirs = F.broadcast(theirs) if fits(theirs) else theirs
    found = all_cells.join(theirs, ["n", "cell"]).where(F.col("label") == F.col("theirs") if same_label else F.col("label") != F.col("theirs"))
    found = found.withColumn("gap", space.gap()("n", "home", "cell")).withColumn("most", F.col("gap") + F.col("reach") + F.col("high"))
    return found.withColumn("least", F.greatest(F.lit(0.0), F.col("gap") - F.col("reach") - F.col("high"), F.col("low") - F.col("gap") - F.col("reach")))


def _enough(found: DataFrame, counts: Column, k: int) -> Column:
    """A distance within which a group (of a label) surely has k rows, null without one."""
    by = Window.partitionBy(*HOME, "label")
    running = F.sum(counts).over(by.orderBy("most", "cell", "theirs").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("running", running)
    return found.withColumn("enough", F.min(F.when(F.col("running") >= k, F.col("most"))).over(by))


def hard_negatives(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    cell_rows: int = CELL_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``prepared`` rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    rows = rows.withColumn("label", F.col("label").cast("long"))
    space, shape = space_of(rows, cell_rows)
    made = f"key bigint, vec_id {kind}, label bigint, anchor boolean, v array<double>, n int, cell int, d double, home int, far double, square double"
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "anchor", "v", "n")
    rows = written(keyed.mapInArrow(space.cells, made), "negatives-rows")
    cells = written(rows.groupBy("n", "cell", "label").agg(F.count("*").alias("rows"), F.min("d").alias("low"), F.max("d").alias("high")), "negatives-cells")
    counts = rows.where("anchor").groupBy("n", "home").count().toPandas()  # a row a cell, of which there are as many as pivots
    teams = F.broadcast(rows.sparkSession.createDataFrame(space.teams(counts, group_rows), "n int, home int, parts int, team int"))
    anchors = rows.where("anchor").join(teams, ["n", "home"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("team", F.col("team") + F.col("part"))
    anchors = written(anchors.select(*HOME, "team", "key", "vec_id", "label", "v", "far", "square"), "negatives-anchors")

    def routed(found: DataFrame, lo: Column, hi: Column) -> DataFrame:
        """What each group is sent: of each cell and label the rows between the widest bounds of its members."""
        ways = found.select(*HOME, "cell", "theirs", "rows", "low", "high", (lo - F.col("slack")).alias("lo"), (hi + F.col("slack")).alias("hi")).where("low <= hi and high >= lo")
        ways = ways.join(teams, ["n", "home"]).withColumn("team", F.col("team") + F.col("part"))
        return ways.groupBy(*GROUP, "cell", F.col("theirs").alias("label")).agg(F.max("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    groups = anchors.groupBy(*HOME, "label").agg(F.max("far").alias("reach"))
    found = _enough(_pairs(groups, cells, shape, space, True), F.col("rows"), positives + 1)
    within = F.coalesce("enough", F.lit(float("inf")))
    routes = routed(found, F.col("gap") - F.col("reach") - within, F.col("gap") + F.col("reach") + within)
    near = _met(anchors.select(*GROUP, "key", "label", "v"), rows, routes, _positives(positives), f"anchor bigint, key bigint, vec_id {kind}, score bigint")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "key")
    near = written(near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives).select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    lists = near.groupBy(F.col("anchor").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    asking = anchors.join(lists, "key").join(shape.select("n", "norm"), "n")
    real = F.filter("positives", lambda s: s >= 0)  # a negative score has no numbers between its parts
    away = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.col("norm") * F.col("norm") - 2 * score))
    least, most = (lambda s: s.cast("double") * low / 100), (lambda s: s.cast("double") * high / 100)  # rounding is left to the exact join
    asking = asking.withColumn("real", real).where(F.size("real") > 0)
    asking = asking.withColumns({
        "nearest": away(most(F.array_max("real"))), "farthest": away(least(F.array_min("real"))),
        "sure_near": away(most(F.array_min("real"))), "sure_far": away(least(F.array_max("real"))),
    })
    bounds = asking.groupBy(*HOME, "label").agg(F.max("far").alias("reach"), F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"), F.max("sure_near").alias("sure_near"), F.min("sure_far").alias("sure_far"))
    found = _pairs(bounds, cells, shape, space, False)
    sure = (F.col("least") >= F.col("sure_near") + F.col("slack")) & (F.col("most") <= F.col("sure_far") - F.col("slack"))
    found = _enough(found, F.when(sure, F.col("rows")).otherwise(0), negatives)
    within = F.least("farthest", F.coalesce("enough", F.lit(float("inf"))))
    lo = F.greatest(F.col("gap") - F.col("reach") - within, F.col("nearest") - F.col("gap") - F.col("reach"))
    routes = routed(found, lo, F.col("gap") + F.col("reach") + within)
    hard = _met(asking.select(*GROUP, "key", "label", "v", "positives"), rows, routes, _negatives(negatives, low, high), f"anchor bigint, place int, vec_id {kind}, score bigint")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    hard = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    names = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hard.join(near, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(prepared(table(spark, sf_dir, "embeddings"), vec_id, shifted, F.col("embedding"), vec_id % 100 == 0))


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.key, a.vec_id AS anchor_id, a.label = b.label AS alike, b.vec_id, b.key AS other, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.key <> b.key AND len(a.x) = len(b.x)),
p AS (
  SELECT key, anchor_id, vec_id AS positive_id, other, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (key, anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW best AS (PARTITION BY key, p.other ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 10
"""
