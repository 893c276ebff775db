"""Quality by histogram gradient-boosted trees over statistics of documents.

``statistics_of`` reads a whole text once and gives ``FEATURES``: shares of character
classes, lengths and repetition of words and lines, entropy. A feature's values in the sample are cut into at
most ``BINS`` bins at their quantiles; trees of ``DEPTH`` levels grow level by level on histograms of
gradients and curvatures of the logistic loss, one ``bincount`` for all nodes and features of a level. The trees are flattened into
arrays of features, cuts and values, a row a tree, the children of node i at 2i+1 and 2i+2, so a batch
of documents goes down all trees at once, a level at a step, in numpy.

Learned from at most ``most`` (``MAX_SAMPLE``) labelled rows. Ids are chosen by hash before any text is read, and
only the numbers of their rows are gathered: ``MAX_SAMPLE`` rows of ``FEATURES`` doubles are the bound on what the driver holds.

Defined cases: null is the empty text, which has statistics (all 0) and a score like others; without labelled
rows of both kinds the score is the share of label 1 (0.5 without any); of labels for one id the greatest counts,
null labels don't; rows with a null id are scored and not learned from; rows that share an id are sample rows
each; repeated rows give a row each; an empty table gives no rows; texts of any length are read whole, in
slices of about ``SLICE`` bytes; ``score`` replaces columns that have the name of a result and keeps all others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, fold, table, written

MAX_SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, MIN_ROWS = 80, 4, 64, 0.15, 1.0, 8
SLICE = 1 << 20
WINDOW = 50

_CLASSES = ("upper", "lower", "digit", "space", "stop", "sign", "wide")
FEATURES = (
    "bytes", "words", *_CLASSES, "bangs", "bars", "entropy", "word_length", "long_words", "short_words", "sign_ends", "stop_ends",
    "distinct", "window_distinct", "top_word", "repeats", "lines", "line_length", "distinct_lines", "full_lines",
)


def _class_of() -> np.ndarray:
    kind = np.full(256, _CLASSES.index("wide"), np.uint8)
    for b in range(128):
        c = chr(b)
        name = "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "space" if c.isspace() else "stop" if c in ".,;:?" else "sign"
        kind[b] = _CLASSES.index(name)
    return kind


_KIND = _class_of()
_SPACE, _STOP, _SIGN = (_CLASSES.index(c) for c in ("space", "stop", "sign"))


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in pieces that end after a line or, without one in reach, a word."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            cut = max(data.rfind(b"\n", at, end), at) or at
            cut = cut if cut > at else data.find(b" ", end)
            end = cut + 1 if cut > at else len(data)
        yield data[at:end]
        at = end


def statistics_of(data: bytes) -> list[float]:
    """FEATURES of a text in UTF-8."""
    counts, pairs = np.zeros(256), np.zeros(2)
    words: Counter = Counter()
    lines: set[int] = set()
    n_lines = full = window = repeats = size = long = short = 0
    for part in _slices(data):
        a = np.frombuffer(part, np.uint8)
        counts += np.bincount(a, minlength=256)
        kind = _KIND[a]
        ends = kind[:-1][kind[1:] == _SPACE]
        pairs += np.count_nonzero(ends == _SIGN), np.count_nonzero(ends == _STOP)
        found = part.split()
        words.update(found)
        repeats += sum(map(eq, found, found[1:]))
        window += sum(len(set(found[i : i + WINDOW])) for i in range(0, len(found), WINDOW))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        size, long, short = size + int(lengths.sum()), long + np.count_nonzero(lengths > 20), short + np.count_nonzero(lengths < 3)
        rows = [r for r in part.split(b"\n") if r.strip()]
        n_lines += len(rows)
        lines.update(map(hash, rows))
        full += sum(r.rstrip()[-1:] in b".!?" for r in rows)
    total = counts.sum()
    if not total:
        return [0.0] * len(FEATURES)
    n, w = max(total, 1.0), max(words.total(), 1)
    share = counts[counts > 0] / n
    classes = np.bincount(_KIND, counts, len(_CLASSES)) / n
    return [
        float(np.log1p(total)), float(np.log1p(words.total())), *map(float, classes), counts[ord("!")] / n, counts[ord("|")] / n, float(-(share * np.log2(share)).sum()),
        size / w, long / w, short / w, pairs[0] / w, pairs[1] / w,
        len(words) / w, window / w, max(words.values(), default=0) / w, repeats / w,
        float(np.log1p(n_lines)), float(np.log1p(total / max(n_lines, 1))), len(lines) / max(n_lines, 1), full / max(n_lines, 1),
    ]


def _table_of(texts) -> np.ndarray:
    rows = [statistics_of((t or "").encode("utf-8", "surrogatepass")) for t in texts]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


@dataclass
class Trees:
    """A forest as arrays: a row a tree, nodes in the order of a heap, leaves in the last level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; greater values go right
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.value[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins: middles of neighbouring values, at quantiles where there are more values than bins."""
    known = np.unique(values)
    if len(known) > bins:
        known = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="nearest"))
    return (known[1:] + known[:-1]) / 2


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1. A node that no cut improves sends all rows left, and so down to one leaf."""
    n, width = x.shape
    inner, share = 2**depth - 1, float(y.mean()) if n else 0.5
    if share in (0.0, 1.0) or not n:
        return Trees(80.0 * share - 40.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [_edges(x[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
    cell = binned + bins * np.arange(width)
    base = float(np.log(share / (1 - share)))
    out = Trees(base, np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, int)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = ((node - first) * width * bins)[:, None] + cell
            sums = [np.bincount(at.ravel(), np.repeat(w, width), wide * width * bins).reshape(wide, width, bins).cumsum(axis=2) for w in (g, h, np.ones(n))]
            (gl, hl, nl), (gt, ht, nt) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = 0
            best = gain.reshape(wide, -1).argmax(axis=1)
            found = np.flatnonzero(gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9)
            for k in found:
                f, b = divmod(int(best[k]), bins)
                out.feature[t, first + k], out.cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        leaf = node - inner
        out.value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        raw += out.value[t, leaf]
    return out


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_SAMPLE) -> DataFrame:
    """x (FEATURES) and y of at most ``most`` labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 1).cast("int").alias("y"))
    chosen = written(known.orderBy(F.xxhash64("_id"), "_id").limit(most), "quality-ids")
    chosen = F.broadcast(chosen) if fits(chosen) else chosen
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id").select("text", "y")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _table_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    found = written(rows.mapInArrow(measured, "x array<double>, y int"), "quality-sample")
    n = found.count()
    if n > most:  # ids that many rows share: as many of these rows as the bound allows, by a hash of their place
        kept = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)) < most
        found = written(found.where(kept).limit(most), "quality-sample")
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_SAMPLE) -> Trees:
    """Trees from the rows of ``docs`` that ``labels`` covers."""
    rows = labelled_statistics(docs, labels, id_col, text_col, label_col, most).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    order = np.lexsort([rows["y"].to_numpy(), *x.T])  # sums don't depend on the order in which tasks ended
    return grow(x[order], rows["y"].to_numpy(float)[order])


def score(docs: DataFrame, trees: Trees, text_col: str = "text", threshold: float = 0.3, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs``, with score and predicted (columns of these names are replaced)."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.score(_table_of(texts)))

    return docs.withColumn(into[0], scored(F.col(text_col))).withColumn(into[1], (F.col(into[0]) >= threshold).cast("int"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "quality")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = learn(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, trees).select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
