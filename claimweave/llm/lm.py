"""Language-model scoring by a weighted backoff automaton.

The automaton has a start state, a state for each word that was seen in training and
a root. An arc from state h by word w, for each pair seen, weighs
log10((1 - L(h)) c(hw) / c(h) + L(h) U(w)) and leads to w's state; for any other word the
state's failure arc, log10 L(h), leads to the root, whose arc by w weighs log10 U(w) and leads to
w's state, or back to the root if w was never seen. U is the add-one-half unigram model, and
L(h) falls with the count of h by a fixed rule, so the weights of a state's words sum to one.
A text is one traversal from the start to its end, left to right: the state is carried from word to
word, and the weights of the arcs taken add up.

The model grows with the corpus, so it is never in one place. Documents are dealt
into blocks of a few MB; a block asks the shards of the automaton for the arcs that
its own words and pairs can take, in sorted delta-coded keys with its training counts;
a shard adds up what all blocks sent and answers each with the totals; the block then
builds its part of the automaton and runs its texts over it, in slices of ``SLICE`` tokens with the
state carried from one to the next, so that a very long text costs no more memory than short ones.
Frequent words are one key a block, so no shard is hot, and copies of a row go to the blocks of the
input partitions they stand in. There are as many shards as blocks up to ``MAX_SHARDS``, so messages
grow with the input, not with its square. Nothing but a byte count reaches the driver.

Defined cases: null and empty texts are the end token alone; documents with a null id
are scored and learned from; repeated rows are learned from and scored each time; without
training tokens every word has the unigram model's even share; texts of any length are scored whole;
other columns are neither needed nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, words

BLOCK_BYTES, MAX_SHARDS, SLICE = 24 << 20, 1 << 16, 1 << 18
#: Fixed values of the backoff rule: L(h) = max(FLOOR, 1 / (1 + (c(h) / HALF) ** POWER)).
HALF, POWER, FLOOR = 1000.0, 0.3, 0.2
START, END, ROOT = np.uint64(0x5354415254), np.uint64(0x454E44), np.uint64(0x524F4F54)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pair(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(0x9E3779B97F4A7C15) ^ tokens)


def slices(texts: pa.ListArray, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token keys of all texts one after the other, the end token of each included, ``size`` at a time: the row of
    each token, the tokens, and the places at which texts begin. A long text goes on in the next slice."""
    at = texts.offsets.to_numpy().astype(np.int64)
    values = texts.values.to_numpy(zero_copy_only=False).view(np.uint64)[at[0] : at[-1]]
    start = at - at[0] + np.arange(len(at))
    for a in range(0, int(start[-1]), size):
        b = min(a + size, int(start[-1]))
        i, j = int(np.searchsorted(start, a, "right")) - 1, int(np.searchsorted(start, b, "left"))
        last = start[i + 1 : j + 1] - 1 - a
        last = last[last < b - a]
        tokens, inside = np.empty(b - a, np.uint64), np.ones(b - a, bool)
        inside[last] = False
        tokens[inside] = _mix(values[a - i : b - i - len(last)])
        tokens[last] = END
        first = start[i:j] - a
        rows = np.repeat(np.arange(i, j), np.minimum(start[i + 1 : j + 1], b) - np.maximum(start[i:j], a))
        yield rows, tokens, first[first >= 0]


def with_before(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """rows, tokens and pair keys of each slice."""
    carried = START
    for rows, tokens, first in parts:
        before = np.concatenate([[carried], tokens[:-1]])
        before[first] = START
        carried = tokens[-1]
        yield rows, tokens, _pair(before, tokens)


class Tally:
    """Distinct keys with their counts; what is added is merged when it has grown as large as what there is."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > len(self.keys) + SLICE:
            self.merge()

    def add_tokens(self, keys: np.ndarray, train: np.ndarray) -> None:
        every, place = np.unique(keys, return_inverse=True)
        self.add(every, np.bincount(place[train], minlength=len(every)))

    def merge(self) -> Tally:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(keys) else counts
        return self


def tallied(rows: pa.Table) -> tuple[Tally, Tally]:
    """Words and pairs of a block, with how often each stands in training texts."""
    seen, pairs = Tally(), Tally()
    for batch in rows.select(["h", "held_out"]).to_batches():
        train = ~np.asarray(batch.column("held_out"))
        for at, tokens, keys in with_before(slices(batch.column("h"))):
            seen.add_tokens(tokens, train[at])
            pairs.add_tokens(keys, train[at])
    return seen.merge(), pairs.merge()


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of a fixed number of bytes."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=np.uint64(0))
    width = next(b for b in range(1, 9) if b == 8 or int(step.max()) < 1 << 8 * b)
    return bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.uint64)
    width = data[0]
    small = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    step = np.zeros((len(small), 8), np.uint8)
    step[:, :width] = small
    return np.cumsum(step.view(np.uint64)[:, 0], dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; few counts are large, so those are kept apart."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return len(counts).to_bytes(8, "little") + small.tobytes() + counts[counts >= 255].astype(np.int64).tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, offset=8 + n)
    return out


def _shard_edges(keys: np.ndarray, shards: int) -> np.ndarray:
    edges = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(np.int64)


_ASK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])
_REPLY = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("word_counts", pa.binary()), ("pair_counts", pa.binary()), ("total", pa.int64()), ("kinds", pa.int64())])
_SCORED = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _ask(shards: int):
    def ask(rows: pa.Table) -> pa.Table:
        sides = []
        for side in tallied(rows):
            edges = _shard_edges(side.keys, shards)
            sides.append([(_pack(side.keys[a:b]), _pack_counts(side.counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        block = rows.column("block")[0].as_py()
        made = [(i, block, *w, *p) for i, (w, p) in enumerate(zip(*sides, strict=True))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _ASK, strict=True)], schema=_ASK)

    return ask


def _answer(rows: pa.Table) -> pa.Table:
    """The sums over all blocks, to each block in the order of its keys; one block's keys are unpacked at a time."""
    replies, total, kinds = {}, 0, 0
    for side in ("word", "pair"):
        sums = Tally()
        for keys, counts in zip(rows.column(f"{side}s"), rows.column(f"{side}_counts"), strict=True):
            sums.add(_unpack(keys.as_py()), _unpack_counts(counts.as_py()))
        sums.merge()
        if side == "word":
            total, kinds = int(sums.counts.sum()), int((sums.counts > 0).sum())
        replies[side] = [_pack_counts(sums.counts[np.searchsorted(sums.keys, _unpack(keys.as_py()))]) for keys in rows.column(f"{side}s")]
    n = rows.num_rows
    return pa.Table.from_arrays(
        [rows.column("block"), rows.column("shard"), pa.array(replies["word"], pa.binary()), pa.array(replies["pair"], pa.binary()), pa.array([total] * n, pa.int64()), pa.array([kinds] * n, pa.int64())],
        schema=_REPLY,
    )


def backoff(history_counts: np.ndarray) -> np.ndarray:
    """L(h); one for a history that was never seen."""
    return np.where(history_counts > 0, np.maximum(FLOOR, 1 / (1 + (history_counts / HALF) ** POWER)), 1.0)


class Automaton:
    """The part of the automaton that some texts can reach. State i is that of word i; the start and the root follow.

    words and pairs are sorted keys of all words and pairs of these texts, with their counts in the whole training
    corpus. Arcs are found by pair key and weighed from their state's count when they are taken.
    """

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: int, kinds: int):
        if len(words) != len(word_counts) or len(pairs) != len(pair_counts):
            raise ValueError("a block's texts are not those that it asked for")
        n = len(words)
        self.words, self.start, self.root = words, n, n + 1
        self.key = np.concatenate([words, [START, ROOT]])
        ends = word_counts[np.searchsorted(words, END)]  # as many texts begin as end
        self.count = np.concatenate([word_counts, [ends, 0]])
        self.share = backoff(self.count)  # L of each state; the root's is one
        self.fail = np.log10(self.share)
        self.unigram = (word_counts + 0.5) / (total + 0.5 * (kinds + 1))
        self.emit = np.log10(self.unigram)
        self.known = word_counts > 0
        self.into = np.where(self.known, np.arange(n), self.root)
        self.arcs, self.arc_count = pairs[pair_counts > 0], pair_counts[pair_counts > 0]

    def _seen(self, state: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The count of the arc from each state by each token; zero where there is none."""
        if not len(self.arcs):
            return np.zeros(len(state), np.int64)
        keys, place = np.unique(_pair(self.key[state], tokens), return_inverse=True)
        at = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
        return np.where(self.arcs[at] == keys, self.arc_count[at], 0)[place]

    def run(self, tokens: np.ndarray, first: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray, int]:
        """From ``state`` over a slice: the word number and the weight of each token, and the state at the end.

        Where an arc leads depends on its word alone, so the states of a slice are known at once.
        """
        keys, place = np.unique(tokens, return_inverse=True)
        word = np.searchsorted(self.words, keys)[place]
        after = self.into[word]
        states = np.concatenate([[state], after[:-1]])
        states[first] = self.start
        seen = self._seen(states, tokens)
        arc = np.flatnonzero(seen)
        weight = self.fail[states] + self.emit[word]
        s, w = states[arc], word[arc]
        weight[arc] = np.log10((1 - self.share[s]) * seen[arc] / self.count[s] + self.share[s] * self.unigram[w])
        return word, weight, int(after[-1])


def _scorer(kind: pa.DataType):
    names = ["id", "held_out", *(name for name, _ in _SCORED)]

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (kind, pa.bool_(), *(t for _, t in _SCORED))], names=names)
        replies = replies.sort_by("shard")
        counts = [np.concatenate([_unpack_counts(c.as_py()) for c in replies.column(f"{side}_counts")]) for side in ("word", "pair")]
        total, kinds = (int(np.sum(replies.column(c).to_numpy())) for c in ("total", "kinds"))
        seen, pairs = tallied(rows)
        automaton = Automaton(seen.keys, counts[0], pairs.keys, counts[1], total, kinds)
        del seen, pairs, counts
        out = []
        for batch in rows.to_batches():
            sums = np.zeros((4, batch.num_rows))
            state = automaton.start
            for at, tokens, first in slices(batch.column("h")):
                word, weight, state = automaton.run(tokens, first, state)
                low, n = at[0], at[-1] - at[0] + 1
                for total_of, values in zip(sums, (None, automaton.known[word], automaton.emit[word], weight), strict=True):
                    total_of[low : low + n] += np.bincount(at - low, values, n)
            n_tokens, n_known, base, score = sums
            columns = [n_tokens.astype(np.int64), n_known.astype(np.int64), np.full(len(base), total), base, score]
            out.append(pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), *(pa.array(c, t) for c, (_, t) in zip(columns, _SCORED, strict=True))], names=names))
        return pa.Table.from_batches(out)

    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = int(-(-size // block_bytes)) or 1
    shards = min(blocks, MAX_SHARDS)
    block = F.pmod(F.xxhash64(id_col, text_col, F.spark_partition_id()), F.lit(blocks)).cast("int")
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), block.alias("block")).repartition(blocks, "block")
    rows = dealt.select("id", (fold(F.col("id"), folds) == held_fold).alias("held_out"), "block", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    ask = "shard int, block int, words binary, word_counts binary, pairs binary, pair_counts binary"
    asked = rows.groupBy("block").applyInArrow(_ask(shards), ask)
    replies = asked.groupBy("shard").applyInArrow(_answer, "block int, shard int, word_counts binary, pair_counts binary, total bigint, kinds bigint")
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = f"id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scorer(to_arrow_type(kind)), out)
    return scored.withColumnRenamed("id", id_col)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
