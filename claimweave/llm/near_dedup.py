"""Near-duplicate detection by min-max hashing.

A document is its set of word shingles. Each of ``PERMUTATIONS`` hash permutations
gives two signature values, the least and the greatest hash, so half as many hashes
make a signature of the same length. ``BANDS`` bands of four values pick the
candidates: two sets of similarity 0.8 share no band with a probability under 1e-7.
Every link is then confirmed on the full sets.

Equal sets form a class first, so copies cost one row; a class is known by 128 bits of its set. In
each bucket the members are compared with one class of it, its hub. Those that don't end up in the hub's
component are then compared with all others that met this component in a bucket, in
blocks through an inverted index. That loses no link that matters for a component:
of two candidates in different components, one isn't in their hub's. A large neighbourhood is
compared with one block of its members first, which joins most of what is left, and only the rest with all
blocks. A group of near copies so costs its size; a group whose members meet in buckets but are not alike
costs its members times its blocks, which is the price of losing no link.

Sets are 64-bit hashes of shingles; buckets, classes and hubs are found by partial
aggregates and joins that adaptive execution splits; nothing but counts reaches the driver.

Defined cases: null or empty texts have no shingles and are linked with nothing; a text
of fewer words than a shingle is one shingle; rows that share an id are one node in ``near_duplicates``,
so the links of all their texts are joined, while ``keep_one`` judges row by row; rows with a null id link
others and get the least id of their component, or null if it has none; repeated rows give a row each; texts
of any length go in whole; other columns are neither needed nor returned (``keep_one`` returns them all).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, forget, private, remembered, table, text_key, without, words, written
from .components import components

PERMUTATIONS, BANDS, ROWS = 64, 32, 4
BLOCK_ROWS = 256


def _constants() -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20240229).integers(0, 1 << 64, (2, PERMUTATIONS), np.uint64, endpoint=False)
    return draws[0] | np.uint64(1), draws[1]


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of all runs of k words, or of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    k, out = min(k, n), np.full(max(1, n - k + 1), k, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 2048):
        v = s[at : at + 2048, None] * a + b
        np.minimum(low, v.min(axis=0), out=low)
        np.maximum(high, v.max(axis=0), out=high)
    return np.concatenate([low, high])


def _bands(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sig = _signature(s, a, b).reshape(ROWS, BANDS)  # two minima and two maxima, of four permutations or two
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for row in sig:
        key = (key ^ row) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (which text) and the text itself."""
    return docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def _hashes() -> Column:
    return F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at = column.offsets.to_numpy()
    return (values[at[i] : at[i + 1]] for i in range(len(column)))


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, key (which text), n_shingles, set_key (128 bits of the sorted set) and bands; the last two null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("near_dedup")
        a, b = _constants()
        for batch in batches:
            n, keys, bands = [], [], []
            for h in _lists(batch.column("h")):
                s = shingles(h, k)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(_bands(s, a, b).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "key", "n_shingles", "set_key", "bands"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = _named(docs, id_col, text_col).select("id", "key", _hashes())
    return rows.mapInArrow(run, f"id {kind}, key struct<a:bigint,b:bigint>, n_shingles bigint, set_key binary, bands array<bigint>")


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, h): the word hashes of one document of each class, written; what is asked for is broadcast if it fits."""
    asked = written(classes.join(nodes.distinct(), F.col("set_key") == F.col("node"), "left_semi").select("set_key", "doc.id", "doc.key"), "candidates")
    names = asked.select(F.col("set_key").alias("node"), F.col("id").alias("_id"), F.col("key").alias("_key"))
    rows = _named(docs, id_col, text_col).join(F.broadcast(names) if fits(asked) else names, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    out = written(rows.select("node", _hashes()).dropDuplicates(["node"]), "candidate-words")
    forget(asked)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (hub, node) whose full sets are similar enough."""
    first = pairs.join(sets, "node")
    both = first.join(sets.select(F.col("node").alias("hub"), F.col("h").alias("hub_h")), "hub").select("hub", "node", "hub_h", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("near_dedup")
        last, hub_set = object(), None
        for batch in batches:
            keep = []
            for hub, hub_h, h in zip(batch.column("hub").to_pylist(), _lists(batch.column("hub_h")), _lists(batch.column("h")), strict=True):
                if hub != last:
                    last, hub_set = hub, shingles(hub_h, k)
                s = shingles(h, k)
                if 100 * min(len(s), len(hub_set)) < percent * max(len(s), len(hub_set)):
                    keep.append(False)
                    continue
                at = np.searchsorted(hub_set, s)
                at[at == len(hub_set)] = 0
                inter = int((hub_set[at] == s).sum())
                keep.append(100 * inter >= percent * (len(s) + len(hub_set) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node")], names=["hub", "node"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "hub binary, node binary")


def _neighbourhoods(named: DataFrame, larger_than: int) -> DataFrame:
    """The rows of ``named`` whose neighbourhood has members outside its own component, with its number of blocks."""
    shape = named.groupBy("around").agg(F.count("*").alias("members"), F.count_if(F.col("component") != F.col("around")).alias("rest"))
    cut = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    shape = shape.where("rest > 0 and members > 1").select("around", cut("members").alias("m_blocks"), cut("rest").alias("r_blocks"))
    return written(named.join(shape.where(F.col("m_blocks") > larger_than), "around"), "neighbourhoods")


def _rest_against(here: DataFrame, sets: DataFrame, k: int, percent: int, first_only: bool) -> DataFrame:
    """Links between members of a neighbourhood that aren't in its own component and its other members.

    ``here`` is (around, node, component): those that met the component ``around`` in a bucket. Both sides of a
    neighbourhood are cut into blocks of ``BLOCK_ROWS``, and each block of one meets each of the other (or, with
    ``first_only``, one block of the members) in an inverted index, so a task holds two blocks, and what goes in
    and out is blocks of rows, not pairs.
    """
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["around", "m_block", "r_block", "side", "node", "component"]
    members = here.select("*", block("m_blocks").alias("m_block"), every("r_blocks").alias("r_block"), F.lit(0).alias("side"))
    rest = here.where("component <> around").select("*", block("r_blocks").alias("r_block"), (F.lit(0) if first_only else every("m_blocks")).alias("m_block"), F.lit(1).alias("side"))
    if first_only:
        members = members.where("m_block = 0")
    rows = members.select(*columns).unionAll(rest.select(*columns)).join(sets, "node")
    keys = ["around", "m_block", "r_block"]
    dealt = rows.select(F.xxhash64(*keys).alias("task"), *columns, "h").repartition("task").sortWithinPartitions(*keys, "side")
    return written(dealt.mapInArrow(_compare_blocks(k, percent), "hub binary, node binary"), "confirmed")


def _compare_blocks(k: int, percent: int):
    def links(ids, comps, sets, first: int) -> list[tuple]:
        """Links of rows from ``first`` on to those before it, one for each component met."""
        if not first or first == len(ids):
            return []
        sizes = np.array([len(s) for s in sets[:first]])
        tokens = np.concatenate(sets[:first])
        order = np.argsort(tokens, kind="stable")
        owner = np.repeat(np.arange(first), sizes)[order]
        words, start = np.unique(tokens[order], return_index=True)
        ends = np.append(start[1:], len(tokens))
        out = []
        for i in range(first, len(ids)):
            s = sets[i]
            at = np.searchsorted(words, s)
            at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == s)]
            runs = ends[at] - start[at]
            places = np.arange(runs.sum()) + np.repeat(start[at] - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
            inter = np.bincount(owner[places], minlength=first)
            met = {}
            for j in np.flatnonzero(100 * inter >= percent * (len(s) + sizes - inter)).tolist():
                if comps[j] != comps[i] and ids[j] != ids[i]:
                    met[comps[j]] = ids[j]
            out += [(min(ids[i], y), max(ids[i], y)) for y in met.values()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("near_dedup")
        key, ids, comps, sets, first = None, [], [], [], 0

        def done() -> pa.RecordBatch:
            found = links(ids, comps, sets, first if any_rest else len(ids))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["hub", "node"])

        any_rest = False
        for batch in batches:
            names = ("around", "m_block", "r_block", "side", "node", "component")
            for around, m, r, side, id_, comp, h in zip(*(batch.column(c).to_pylist() for c in names), _lists(batch.column("h")), strict=True):
                if (around, m, r) != key:
                    if key is not None:
                        yield done()
                    key, ids, comps, sets, first, any_rest = (around, m, r), [], [], [], 0, False
                if side and not any_rest:
                    first, any_rest = len(ids), True
                ids.append(id_)
                comps.append(comp)
                sets.append(shingles(h, k))
        if key is not None:
            yield done()

    return run


def _linked(classes: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, component) of the classes that are linked with another, both set keys."""
    members = classes.select(F.explode("bands").alias("bucket"), F.col("set_key").alias("node"), "n")
    hubs = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    crowded = written(members.join(hubs.select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "bucket"), "buckets")
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = written(crowded.where(F.col("node") != F.col("hub")).where(alike).select("hub", "node").distinct(), "pairs")
    sets = _sets(pairs.select("node").unionAll(pairs.select(F.col("hub").alias("node"))), classes, docs, id_col, text_col)
    links = written(_confirmed(pairs, sets, k, percent), "confirmed")
    found = written(components(links, "hub", "node"), "components")
    forget(pairs, sets, links)

    # What isn't in the component of its bucket's hub, against what shares a bucket with that component: one
    # block of it first where it is large, then all of it.
    for first_only in (True, False):
        named = crowded.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = named.join(found.select(F.col("node").alias("hub"), F.col("component").alias("around")), "hub", "left")
        named = written(named.withColumn("around", F.coalesce("around", "hub")).where("node <> hub").select("around", "node", "component").distinct(), "named")
        here = _neighbourhoods(named, larger_than=0 if first_only else 1)
        forget(named)
        if not here.limit(1).count():
            break
        sets = _sets(here.select("node"), classes, docs, id_col, text_col)
        more = _rest_against(here, sets, k, percent, first_only)
        stars = found.select(F.col("node").alias("hub"), F.col("component").alias("node"))
        before, found = found, written(components(more.unionAll(stars), "hub", "node"), "components")
        forget(sets, here, more, before)
    forget(crowded)
    return found


def _groups(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows; classes (set_key, doc, n, bands), doc the first row of each set by id, null last; linked classes."""
    sig = written(signatures(docs, k, id_col, text_col), "signatures")
    doc = F.struct(F.col("id").isNull().alias("nameless"), "id", "key")
    classes = sig.where("set_key is not null").groupBy("set_key").agg(F.min(doc).alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    return sig, classes, _linked(classes, docs, k, percent, id_col, text_col)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id (least id reachable) and kept for every row."""
    sig, classes, found = _groups(docs, k, percent, id_col, text_col)
    # An id with several sets links them.
    several = sig.where("set_key is not null and id is not null").groupBy("id").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("last")).where("hub <> last")
    several = written(several.select("id", "hub"), "repeated-ids")
    if several.limit(1).count():
        same = sig.join(several, "id").where("set_key <> hub").select("hub", F.col("set_key").alias("node"))
        stars = found.select(F.col("node").alias("hub"), F.col("component").alias("node"))
        found = written(components(same.unionAll(stars), "hub", "node"), "components")
    least = found.join(classes.select(F.col("set_key").alias("node"), "doc.id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    owner = classes.select(F.col("set_key").alias("node"), "doc.id").join(found.join(least, "component"), "node", "left")
    owner = owner.select(F.col("node").alias("set_key"), F.coalesce("least", "id").alias("component_id"))
    out = sig.select("id", "n_shingles", "set_key").join(owner, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked rows, that of the least id (null ids last), then of the least text key; rows
    without shingles stay. Of rows that repeat both id and text one stays."""
    sig, classes, found = _groups(docs, k, percent, id_col, text_col)
    group = classes.select(F.col("set_key").alias("node"), "doc").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = group.groupBy("component").agg(F.min("doc").alias("best"))
    judged = sig.where("set_key is not null").join(group.select(F.col("node").alias("set_key"), "component").join(best, "component"), "set_key")
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    judged = written(judged.select("id", "key", stays.alias("stays")), "judged")
    ours = {"id": F.col(id_col), "key": text_key(F.col(text_col))}
    left = without(docs, judged.where("not stays"), ours)
    repeated = written(judged.where("stays").groupBy("id", "key").count().where("count > 1"), "repeated")
    if repeated.limit(1).count():
        names = [private(f"_row_{c}", docs) for c in ours]
        rows = left.withColumns(dict(zip(names, ours.values(), strict=True)))
        again = repeated.select(*(F.col(c).alias(f"{n}r") for c, n in zip(ours, names, strict=True)))
        same = F.col(names[0]).eqNullSafe(F.col(f"{names[0]}r")) & F.col(names[1]).eqNullSafe(F.col(f"{names[1]}r"))
        once = rows.join(again, same, "left_semi").dropDuplicates(names)
        left = rows.join(again, same, "left_anti").unionAll(once).select(*docs.columns)
    return left


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=2)
