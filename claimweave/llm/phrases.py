"""Phrase collocations: which words stand together more often than their parts would.

Words that are frequent in their language get an id, a dictionary of (language, word). Texts become ids; a piece is
broken at every word without one, as no frequent phrase holds such a word. At each position the window of the next
``MAX_WORDS`` ids up to a break is packed into a key of fixed width, four bytes an id, big-endian. A task
sorts the keys of some million positions by radix, 16 bits a pass, and counts runs, so a phrase that fills the corpus
leaves a task as one row. Keys are then range-partitioned and sorted, where every shorter phrase is a prefix: one
sweep counts the runs of all prefixes of two words and more. Only the first and last run of a range may go on in its
neighbour; they are added up afterwards. So one row a window is shuffled, not one for each length of phrase.

A candidate is a phrase of 2 to ``max_words`` words with a count of ``min_count`` at least. Its score is that of its worst
cut in two, ``floor(1000 * a * n / (l * r))`` in decimals of 38 digits. It is dropped if a longer candidate that holds it is as
frequent. Counts don't grow with length, so then a candidate with one word more is as frequent, and only those are joined.

The dictionary goes to all tasks if it has at most ``max_broadcast`` bytes, measured; beyond that the words of each text, with
their places, are joined with it. Both give the same ids.

Defined cases: a null text is empty, a null language is ``und``; words are compared by bytes, so accents in other compositions are
other words, and bytes that are no UTF-8 are kept as they are; repeated rows count each; an empty table and texts without words give no rows; texts
of any length are read in slices that end with a piece, a piece of any length in one; ties go to the greater count, then
to the phrase in byte order; other columns are neither read nor returned, whatever their names; more than 2^32 - 1 frequent words are an error.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_BYTES, fits, table, written

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
SLICE, POSITIONS, ENTRIES = 1 << 19, 1 << 19, 100_000

#: A-Z in lower case, ends of pieces as a line feed, a tab as a space.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")


def tokens(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, in slices that end with a piece; ``\\n`` ends a piece, and an empty word says nothing."""
    plain = (text or b"").translate(_PLAIN)
    at = 0
    while at < len(plain):
        cut = plain.find(b"\n", at + SLICE)
        end = len(plain) if cut < 0 else cut + 1
        yield plain[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | None]]:
    for batch in batches:
        yield from zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n: partial counts; those of a null word are all words of the language."""
    sums: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        rows = []
        for lang, words in sums.items():
            words.pop(b"", None), words.pop(b"\n", None)
            rows += [(lang, w, n) for w, n in words.items()] + [(lang, None, words.total())]
        sums.clear()
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["lang", "word", "n"])

    for lang, text in _rows(batches):
        for part in tokens(text):
            sums[lang].update(part)
            if sum(map(len, sums.values())) > ENTRIES:
                yield flush()
    yield flush()


def dictionary(texts: DataFrame, min_count: int) -> DataFrame:
    """lang, word, key (four bytes of a dense id from 1), f and n (all words of the language) of words with that count at least."""
    counted = texts.mapInArrow(_count_words, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    kept = written(counted.where(F.col("word").isNull() | (F.col("f") >= min_count)).withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    part, bits = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["count"]) for r in kept.groupBy(part.alias("part")).count().collect())  # a row for each task of the count
    starts = dict(zip([p for p, _ in sizes], np.cumsum([1, *(n for _, n in sizes)]).tolist(), strict=False))
    if sum(n for _, n in sizes) >= 1 << 32:
        raise ValueError("more frequent words than ids of four bytes")
    spark = texts.sparkSession
    offsets = F.broadcast(spark.createDataFrame(list(starts.items()), "part bigint, start bigint"))
    totals = kept.where("word is null").select("lang", F.col("f").alias("n"))
    totals = F.broadcast(totals) if fits(totals) else totals
    numbered = kept.where("word is not null").withColumn("part", part).join(offsets, "part").withColumn("id", F.col("start") + bits)
    return written(numbered.join(totals, "lang").select("lang", "word", F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f", "n"), "phrase-dictionary")


def _sorted_runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, and how often each is there: least significant digit first, 16 bits a pass."""
    order = np.arange(len(columns[0]))
    for column in reversed(columns):
        for shift in (0, 16):
            digit = (column >> np.uint32(shift)).astype(np.uint16)
            if digit.any():
                order = order[np.argsort(digit[order], kind="stable")]  # radix sort, as these are 16 bits
    rows = np.stack(columns, axis=1)[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, int)
    return rows[starts], np.diff(np.append(starts, len(rows)))


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of ids as bytes."""
    data = np.ascontiguousarray(rows, ">u4")
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (4 * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _windows(ids: Iterable[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """key and n of the windows of texts as ids, 0 being a break."""

    def packed(some: list[np.ndarray]) -> pa.RecordBatch:
        line = np.concatenate([*some, np.zeros(width, np.uint32)])
        long = len(line) - width
        columns, open_ = [], np.ones(long, bool)
        for j in range(width):
            open_ = open_ & (line[j : long + j] != 0)
            columns.append(np.where(open_, line[j : long + j], np.uint32(0)))
        keep = columns[1] != 0
        rows, n = _sorted_runs([c[keep] for c in columns])
        return pa.RecordBatch.from_arrays([_binary(rows), pa.array(n, pa.int64())], names=["key", "n"])

    some, size = [], 0
    for one in ids:
        some += [one, np.zeros(1, np.uint32)]
        size += len(one) + 1
        if size >= POSITIONS:
            yield packed(some)
            some, size = [], 0
    if some:
        yield packed(some)


def _windows_with(words: dict[str, dict[bytes, int]], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for lang, text in _rows(batches):
            if known := words.get(lang):
                for part in tokens(text):
                    yield np.fromiter([known.get(w, 0) for w in part if w], np.uint32)

    return lambda batches: _windows(encoded(batches), width)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, lang, word and its places in the text, a place between pieces left free."""
    for batch in batches:
        for row, lang, text in zip(batch.column("row").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            at: dict[bytes, list[int]] = defaultdict(list)
            i = 0
            for part in tokens(text):
                for w in filter(None, part):
                    if w != b"\n":
                        at[w].append(i)
                    i += 1
            made = [[row] * len(at), [lang] * len(at), list(at), list(at.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["row", "lang", "word", "at"])


def _windows_joined(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for found in batch.column("found").to_pylist():
                line = np.zeros(1 + max(f["at"][-1] for f in found), np.uint32)
                for f in found:
                    line[f["at"]] = int.from_bytes(f["key"], "big")
                yield line

    return lambda batches: _windows(encoded(batches), width)


def windows(texts: DataFrame, known: DataFrame, max_words: int = MAX_WORDS, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """key and partial n of the windows of all texts."""
    made = "key binary, n bigint"
    if fits(known.select("lang", "word", "key"), max_broadcast):
        words: dict[str, dict[bytes, int]] = defaultdict(dict)
        for r in known.select("lang", "word", "key").collect():  # measured just before
            words[r["lang"]][bytes(r["word"])] = int.from_bytes(r["key"], "big")
        shared = texts.sparkSession.sparkContext.broadcast(dict(words))
        return texts.mapInArrow(lambda batches: _windows_with(shared.value, max_words)(batches), made)
    places = texts.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_places, "row bigint, lang string, word binary, at array<bigint>")
    found = places.join(known.select("lang", "word", "key"), ["lang", "word"]).groupBy("row").agg(F.collect_list(F.struct("key", "at")).alias("found"))
    return found.select("found").mapInArrow(_windows_joined(max_words), made)


def _prefix_runs(width: int, min_count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """key and n of all prefixes of two ids and more of sorted keys: those with ``min_count``, and at either end of the range all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, tuple[bytes, int, bool]] = {}  # by length: the run that isn't over, whether the range began with it

        def single(k: int, key: bytes, n: int) -> Iterator[pa.RecordBatch]:
            if key[-4:] != b"\0\0\0\0":
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([n], pa.int64())], names=["key", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(-1, width)
            n = batch.column("n").to_numpy()
            differs = rows[1:] != rows[:-1]
            new = differs[:, 0]
            for k in range(2, width + 1):
                new = new | differs[:, k - 1]
                starts = np.concatenate([[0], np.flatnonzero(new) + 1])
                sums = np.add.reduceat(n, starts)
                first, last = rows[0, :k].tobytes(), rows[starts[-1], :k].tobytes()
                held = pending.get(k)
                opens = held is None
                if held and held[0] == first:
                    sums[0] += held[1]
                    opens = held[2]
                elif held and (held[2] or held[1] >= min_count):
                    yield from single(k, held[0], held[1])
                pending[k] = last, int(sums[-1]), opens and len(starts) == 1
                keep = (sums >= min_count) & (rows[starts, k - 1] != 0)
                keep[-1] = False
                if opens and len(starts) > 1:
                    keep[0] = rows[0, k - 1] != 0
                if keep.any():
                    yield pa.RecordBatch.from_arrays([_binary(rows[starts[keep], :k]), pa.array(sums[keep], pa.int64())], names=["key", "n"])
        for k, (key, n, _) in pending.items():
            yield from single(k, key, n)

    return run


def candidates(texts: DataFrame, known: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """key and f of all phrases of two words and more with that count."""
    keys = windows(texts, known, max_words, max_broadcast).repartitionByRange("key").sortWithinPartitions("key")
    runs = written(keys.mapInArrow(_prefix_runs(max_words, min_count), "key binary, n bigint"), "phrase-runs")
    return written(runs.groupBy("key").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count), "phrase-candidates")


def _part(key: Column, first: Column, words: Column) -> Column:
    return F.substring(key, 4 * first + 1, 4 * words)


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, max_broadcast: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` phrases of each language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    known = dictionary(texts, min_count)
    found = candidates(texts, known, max_words, min_count, max_broadcast)
    counts = found.unionByName(known.select("key", "f"))
    near = fits(counts, max_broadcast)
    side = lambda df: F.broadcast(df) if near else df
    key, m = F.col("key"), (F.octet_length("key") / 4).cast("int")
    longer = found.withColumn("m", m).where("m > 2").select("f", F.explode(F.array(_part(key, F.lit(0), F.col("m") - 1), _part(key, F.lit(1), F.col("m") - 1))).alias("key"))
    kept = found.join(longer.distinct(), ["key", "f"], "left_anti").select("key", F.col("f").alias("a"), m.alias("m"))
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", _part(key, F.lit(0), F.lit(1)).alias("first"), _part(key, F.lit(0), F.col("k")).alias("left"), _part(key, F.col("k"), F.col("m") - F.col("k")).alias("right"))
    cuts = cuts.join(side(counts.select(F.col("key").alias("left"), F.col("f").alias("l"))), "left")
    cuts = cuts.join(side(counts.select(F.col("key").alias("right"), F.col("f").alias("r"))), "right")
    cuts = cuts.join(side(known.select(F.col("key").alias("first"), "lang", "n")), "first")
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cuts = cuts.withColumns({"top": whole("a", 16) * whole("n", 18) * F.lit(1000).cast("decimal(4,0)"), "below": whole("l", 18) * whole("r", 18)}).withColumn("score", F.expr("top div below"))
    worst = cuts.groupBy("key", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("key", "a", "lang", "n", "cut.score", "cut.l", "cut.r")
    # The first of each language among a share of its candidates, with all ties, before those of a language meet.
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(shares))).orderBy(F.desc("score"), F.desc("a"))
    first = worst.withColumn("place", F.rank().over(dealt)).where(F.col("place") <= top).drop("place")
    spelled = first.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), m - 1), lambda i: _part(key, i, F.lit(1)))).alias("i", "one"))
    spelled = spelled.join(side(known.select(F.col("key").alias("one"), F.col("word").cast("string").alias("word"))), "one")
    numbers = ["key", "lang", "a", "l", "r", "n", "score"]
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda s: s["word"]), " ")
    named = spelled.groupBy(*numbers).agg(phrase.alias("phrase"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS m, ws, i FROM places),
f AS (
  SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
gone AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c WHERE m > 2))),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * cuts.a * n.n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.lp AND x.m = cuts.k
  JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.rp AND y.m = cuts.m - cuts.k JOIN n ON n.lang = cuts.lang
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = cuts.lang AND gone.phrase = cuts.phrase AND gone.a >= cuts.a)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank, phrase, a, l, r, n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
