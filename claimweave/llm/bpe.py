"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so an Aho-Corasick automaton over all
tokens finds the longest token at each place in one pass. Encoding takes the longest
token while it is compatible with the one before it, else the next shorter
prefix token, else steps back by one token; places from which no encoding goes on are
marked and never tried again. Two tokens are compatible if merging the bytes of both
by rank would leave just these two; answers are remembered. The ids are those of
the rank-by-rank merges.

Each match of the pattern is encoded separately. A match that is a token is that
token. Encodings of short matches are remembered in a table of bounded size.

Defined cases: null is the empty text; an empty text has no ids and decodes to
no bytes; every row gives one row; texts are never cut, and one match of millions of bytes takes time in proportion;
columns that are kept, and have the name of a result, are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import remembered, table

MAX_VOCABULARY_BYTES = 64 << 20
#: Encodings that a worker remembers: beside the pipeline's other work, and where nothing else runs.
MEMO_ENTRIES = 60_000
MEMO_ENTRIES_ALONE = 200_000
MEMO_LENGTH = 40


class ByteBPE:
    """Encoder and decoder for ``token bytes -> rank``; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int | None = None):
        import ahocorasick
        import regex

        self.entries = MEMO_ENTRIES if entries is None else entries
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.length = [len(t) for t in self.token]
        self.longest = max(self.length)
        self.decimal = [str(r) for r in range(len(self.token))]
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.older_memo: dict[str, bytes] = {}
        self.code = "H" if len(self.token) <= 1 << 16 else "I"

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.halves:
            data, parts = self.token[token], None
            if len(data) > 1:
                parts = self._merged(data, below=token)
                if len(parts) != 2:
                    raise ValueError(f"token {token} is not a merge of two tokens")
            self.halves[token] = parts and (parts[0], parts[1])
        return self.halves[token]

    def _merged(self, data: bytes, below: int) -> list[int]:
        """Rank-by-rank merging; only for single tokens, whose length the vocabulary bounds."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves a border between the two tokens."""
        # Undo merges on both sides of the border, latest first. A token across the border
        # spoils it if its rank comes before the merge that would take one of its halves away.
        a, b, deadline, good = left, right, len(self.ranks) + 1, True
        while True:
            across = self.ranks.get(self.token[a] + self.token[b])
            if across is not None and across < deadline:
                good = False
                break
            a_halves, b_halves = self.split(a), self.split(b)
            if a_halves is None and b_halves is None:
                break
            # Of equal merges the left one happens first, so the right one is undone first.
            if b_halves is None or (a_halves is not None and a > b):
                deadline, a = a, a_halves[1]
            else:
                deadline, b = b + 1, b_halves[0]
        if len(self.fits) > self.entries:
            self.fits.clear()
        self.fits[left << 32 | right] = good
        return good

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        if token not in self.shorter:
            data = self.token[token]
            self.shorter[token] = next((r for n in range(len(data) - 1, 0, -1) if (r := self.ranks.get(data[:n])) is not None), -1)
        return self.shorter[token]

    def encode_piece(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        size, length, reach, matches = len(data), self.length, self.longest, self.automaton.iter_long
        text = data.decode("latin-1")
        fits, dead, out, at = self.fits, None, [], 0
        # A look at each place of a long match sees no more than the longest token, so that it takes linear time.
        long = size > reach
        token = next(matches(text[:reach]), (0, -1))[1]
        while at < size:
            if token >= 0:
                end = at + length[token]
                if dead is None or end not in dead:
                    if not out:
                        good = True
                    elif (good := fits.get(out[-1] << 32 | token)) is None:
                        good = self.compatible(out[-1], token)
                    if good:
                        out.append(token)
                        at = end
                        token = next(matches(text[at : at + reach]) if long else matches(text, at), (0, -1))[1] if at < size else -1
                        continue
                token = self.next_shorter(token)
            while token < 0:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead = dead or set()
                dead.add(at)
                last = out.pop()
                at -= length[last]
                token = self.next_shorter(last)
        return out

    def _remember(self, chunk: str) -> bytes:
        """The ids as machine words: a third of the memory of a tuple."""
        ids = []
        for piece in self.pieces(chunk):
            if (known := self.memo.get(piece)) is None:
                known = self.older_memo.get(piece) or array(self.code, self.encode_piece(piece.encode())).tobytes()
                if len(piece) <= MEMO_LENGTH:
                    self.memo[piece] = known
            ids.append(known)
        return b"".join(ids)

    def encode(self, text: str) -> list[int]:
        """A single space between two characters that aren't white space always begins a
        match, so what stands between such spaces is looked up as a whole."""
        first, *chunks = text.split(" ")
        if len(self.words) > self.entries:  # what is used goes on from the older half, the rest is forgotten
            self.older, self.words = self.words, {}
        if len(self.memo) > self.entries // 2:
            self.older_memo, self.memo = self.memo, {}
        words, older = self.words, self.older
        for chunk in set(chunks).difference(words):
            if (known := older.get(chunk)) is not None:
                words[chunk] = known
                continue
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                return self._ids(self._remember(text))
            if len(chunk) <= 4 * MEMO_LENGTH:
                words[chunk] = self._remember(" " + chunk)
        if first and first[-1].isspace() or not first and chunks:
            return self._ids(self._remember(text))
        begin = self._remember(first)
        try:
            return self._ids(begin + b"".join(map(words.__getitem__, chunks)))
        except KeyError:
            return self._ids(begin + b"".join(words[c] if c in words else self._remember(" " + c) for c in chunks))

    def _ids(self, data: bytes) -> list[int]:
        ids = array(self.code)
        ids.frombytes(data)
        return ids.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> tuple[bytes, str]:
    """The rank file's bytes, read on the driver, and its checked size."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def encoder_of(data: bytes, pattern: str, entries: int | None = None) -> ByteBPE:
    """One encoder for each worker process, so that what it remembers outlives a task, until another operator takes the worker."""
    kept = remembered("bpe")
    key = hashlib.sha256(data).hexdigest() + f"{entries} {pattern}"
    if key not in kept:
        kept[key] = ByteBPE(parse_ranks(data), pattern, entries)
    return kept[key]


def _mapper(data, pattern: str, work, fields: list[pa.Field], keep: list[str], text_col: str, entries: int | None):
    """Rows of ``keep`` with what ``work(encoder, text)`` gives, in slices of a few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data.value, pattern, entries)
        for batch in batches:
            at, texts = 0, batch.column(text_col)
            while at < batch.num_rows:
                n, size = 0, 0
                made = []
                while at + n < batch.num_rows and size < 4 << 20:
                    text = texts[at + n].as_py() or ""
                    made.append(work(encoder, text))
                    size += len(text)
                    n += 1
                columns = [batch.column(c).slice(at, n) for c in keep] + [pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in fields)])
                at += n

    return run


def _apply(docs: DataFrame, work, added: str, fields: list[pa.Field], keep: list[str], text_col: str, path: str | None, pattern: str | None, entries: int | None = None) -> DataFrame:
    import public_tokenizers

    data = docs.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    keep = [c for c in dict.fromkeys(keep) if c not in {f.name for f in fields}]
    run = _mapper(data, pattern or public_tokenizers.PATTERN, work, fields, keep, text_col, entries)
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, {added}" if kept else added)


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, path: str | None = None, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """``keep`` columns (all unless named) and the ids of each whole text."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c != out]
    return _apply(docs, lambda e, t: (np.array(e.encode(t), np.int32),), f"`{out}` array<int>", [pa.field(out, pa.list_(pa.int32()))], keep, text_col, path, pattern)


def decode(encoded: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the decoded bytes; null ids decode to no bytes."""
    import public_tokenizers

    data = encoded.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")))
    columns = [c for c in encoded.columns if c != out]

    def run(batches):
        token = {r: t for t, r in parse_ranks(data.value).items()}
        for batch in batches:
            made = [b"".join(map(token.__getitem__, ids.as_py() or [])) for ids in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(made, pa.binary())], names=[*columns, out])

    kept = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in columns)
    return encoded.select(*columns).mapInArrow(run, f"{kept}, `{out}` binary")


def digest(encoder: ByteBPE, text: str) -> tuple[int, str, str]:
    """Encodes, then decodes the ids; the digests of both. Ids stay inside the worker."""
    ids = encoder.encode(text)
    return len(ids), hashlib.sha256(" ".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def round_trip(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, pattern: str | None = None, entries: int | None = None) -> DataFrame:
    """``keep`` columns, n_tokens and the digests of the ids and of what they decode to."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _apply(docs, digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", fields, keep, text_col, path, pattern, entries)


def _checked(encoder: ByteBPE, text: str) -> tuple[int, np.ndarray, bool]:
    ids = encoder.encode(text)
    return len(ids), np.array(ids, np.int32), encoder.decode(ids) == text.encode()


def tokenize(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``keep`` columns, n_tokens, ids, and whether the ids decode to the text."""
    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.int32())), pa.field("round_trip", pa.bool_())]
    return _apply(docs, _checked, "n_tokens bigint, ids array<int>, round_trip boolean", fields, keep, text_col, path, pattern)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], entries=MEMO_ENTRIES_ALONE)
