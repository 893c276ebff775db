"""Queries that SQL can't state, as they are registered, over whole small tables against brute force."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from claimweave.llm import common, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"  # too few labels on the small one to learn from


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()}


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]


def test_op1(spark):
    """On the held-out fold, by labels that learning didn't see."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_toxicity"](spark, LARGER).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, LARGER, "labels").collect() if r["toxic"] is not None}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and i in labels]
    caught = sum(p == t == 1 for p, t in held)
    assert caught >= 0.8 * sum(t for _, t in held) and caught >= 0.8 * sum(p for p, _ in held) and len(held) > 50


def test_op4(spark, docs):
    import public_tokenizers as public
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    coder = tiktoken.Encoding("public", pat_str=public.PATTERN, mergeable_ranks=load_tiktoken_bpe(str(public.path("byte_bpe_50k.tiktoken"))), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = queries.QUERIES["op4_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        ids = coder.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def test_op5(spark, docs):
    tokens = {i: [*words(t), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = counts.total(), len(counts)
    rows = queries.QUERIES["op5_lm_score"](spark, SF).collect()
    assert len(rows) == len(docs)
    better = 0
    for r in rows:
        ws = tokens[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        better += r["score"] > r["base_score"]
    assert better > 0.9 * len(rows)


def test_op6(spark, docs):
    sets = {i: {tuple(w[j : j + 2]) for j in range(max(1, len(w) - 1))} if (w := words(t)) else set() for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.QUERIES["op6_minhash"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
