"""Phrases, hard negatives and quality against brute force, with nulls, long texts, ties, copies, empty tables and clashing columns."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import common, hard_negatives, phrases, quality

# 11: phrases


def brute_phrases(rows, max_words, min_count, top):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for i in range(len(words)):
                for m in range(1, max_words + 1):
                    if i + m <= len(words):
                        counts[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    held = {(lang, w[i : i + m]): max(a, 0) for (lang, w), a in sorted(found.items(), key=lambda f: f[1]) for m in range(2, len(w)) for i in range(len(w) - m + 1)}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if held.get((lang, w), -1) >= a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, of in out.items() for i, (s, a, p, left, right) in enumerate(sorted(of)[:top], 1))


def phrase_rows():
    rng = random.Random(3)
    words = ["a", "b", "B", "é", "é", "c\x01", "c", "dd", " x", "x\x1fy"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice([" ", "\t", "  ", ". ", "\r\n", ",", " "]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    return rows + [("en", None), ("en", ""), (None, "A b c a b c a b c"), ("xx", "hot hot hot hot hot hot hot")] * 4 + [("en", "a b c dd " * 400)]


@pytest.mark.parametrize("max_broadcast", [common.MAX_BROADCAST_BYTES, 0])
def test_phrases(spark, monkeypatch, max_broadcast):
    rows = phrase_rows()
    monkeypatch.setattr(phrases, "POSITIONS", 50)
    monkeypatch.setattr(phrases, "SLICE", 20)
    docs = spark.createDataFrame([(lang, t, 1, "k") for lang, t in rows], "lang string, text string, n int, key string").repartition(5)
    for top in (3, 2000):
        got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=4, top=top, max_broadcast=max_broadcast).collect())
        assert got == brute_phrases(rows, 5, 4, top) and len(got) > 5


def test_phrase_scores_pass_64_bits(spark):
    rows = [("en", "x y " * 3)] * 200
    got = {r["phrase"]: r for r in phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=200).collect()}
    assert got["x y x y x"]["a"] == 200 and got["x y x y x"]["n"] == 1200
    whole = spark.sql("SELECT cast(90000000000L as decimal(16,0)) * cast(9000000000000L as decimal(18,0)) * cast(1000 as decimal(4,0)) AS top, cast(3 as decimal(18,0)) * cast(7000000000000L as decimal(18,0)) AS below")
    assert whole.selectExpr("top div below").first()[0] == 90000000000 * 9000000000000 * 1000 // (3 * 7000000000000)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", ""), (None, None), ("en", "one word")], "lang string, text string")).count() == 0


def test_runs_over_the_ends_of_ranges():
    """Runs that begin or end a range come out however rare; all others from the least count on."""
    import pyarrow as pa

    rng = random.Random(5)
    rows = sorted(tuple([rng.randrange(1, 3) for _ in range(m)] + [0] * (4 - m)) for m in [rng.randrange(2, 5) for _ in range(200)])
    want = collections.Counter(r[:k] for r in rows for k in range(2, 5) if r[k - 1])
    for parts in (1, 3, 50):
        got = collections.Counter()
        for part in np.array_split(np.array(rows, np.uint32), parts):
            batches = [pa.RecordBatch.from_arrays([phrases._binary(b), pa.array([1] * len(b), pa.int64())], names=["key", "n"]) for b in np.array_split(part, 3)]
            for out in phrases._prefix_runs(4, 5)(iter(batches)):
                for key, n in zip(out.column("key").to_pylist(), out.column("n").to_pylist(), strict=True):
                    got[tuple(np.frombuffer(key, ">u4").tolist())] += n
        assert {k: n for k, n in got.items() if n >= 5} == {k: n for k, n in want.items() if n >= 5}


# 12: hard negatives

VECTORS = "vec_id bigint, label int, embedding array<float>, key string, cell int, v int"


def brute_negatives(rows, positives=5, negatives=10):
    out, good = [], []
    for i, (vec_id, label, x, *_) in enumerate(rows):
        if vec_id is not None and label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            good.append((i, vec_id, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    for i, a, label, x in good:
        if a % 10:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), b, other == label) for j, b, other, y in good if j != i and len(y) == len(x)]
        for s, p, _ in sorted(r for r in scored if r[2])[:positives]:
            fine = [r for r in sorted(scored) if not r[2] and 30 * -s <= 100 * -r[0] <= 90 * -s]
            out += [(a, p, rank, b, -s, -t) for rank, (t, b, _) in enumerate(fine[:negatives], 1)]
    return sorted(out)


def vectors(n=260, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 2
    rows = []
    for i in range(n):
        c = int(rng.integers(6))
        x = [float(v) for v in (centres[c] + rng.normal(size=8) * 0.3).astype(np.float32) * np.float32(scale)]
        rows.append((i, c % 4, x, "k", 1, 2))
    hot = rows[10][2]
    rows += [(300 + i, i % 3, hot, "k", 1, 2) for i in range(90)]  # a quarter of all is one vector
    rows += [(20, 1, rows[30][2], "k", 1, 2), (20, 1, rows[31][2], "k", 1, 2), (40, None, hot, "k", 1, 2), (None, 1, hot, "k", 1, 2), (50, 1, None, "k", 1, 2)]
    rows += [(60, 1, [1.0] * 7 + [float("nan")], "k", 1, 2), (70, 1, [1.0] * 7 + [None], "k", 1, 2), (80, 1, [0.0] * 8, "k", 1, 2), (90, 2, [float("-inf")] * 8, "k", 1, 2)]
    return rows + [(1000 + i, i % 2, [float(i), 1.0], "k", 1, 2) for i in range(25)] + [(2000, 1, [], "k", 1, 2), (2001, 1, [], "k", 1, 2), (2002, 2, [], "k", 1, 2)]


def mined(df, **how):
    rows = hard_negatives.prepared(df, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % 10 == 0)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(rows, **how).collect())


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 64)
    rows = vectors()
    got = mined(spark.createDataFrame(rows, VECTORS), cell_rows=20, group_rows=4)
    assert got == brute_negatives(rows) and len(got) > 200


def test_hard_negatives_one_cell_and_large_numbers(spark):
    rows = vectors(120, 2)
    assert mined(spark.createDataFrame(rows, VECTORS)) == brute_negatives(rows)
    large = [(i, lab, [c and c * 2.0**19 for c in x], *more) if x else (i, lab, x, *more) for i, lab, x, *more in vectors(60, 4)]
    assert mined(spark.createDataFrame(large, VECTORS)) == brute_negatives(large)


def test_no_hard_negatives(spark):
    assert mined(spark.createDataFrame([], VECTORS)) == []
    assert mined(spark.createDataFrame([(10, 1, [1.0], "k", 1, 2), (11, 1, [1.0], "k", 1, 2), (13, 1, None, "k", 1, 2)], VECTORS)) == []


def test_bounds_send_less_than_all(spark, monkeypatch):
    """Rows that the triangle inequality excludes are not sent."""
    sent = []
    met = hard_negatives._met

    def seen(anchors, rows, routes, *more):
        sent.append((routes.agg(F.sum("rows")).first()[0] or 0, anchors.select("n", "team").distinct().count() * rows.count()))
        return met(anchors, rows, routes, *more)

    monkeypatch.setattr(hard_negatives, "_met", seen)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 4)) * 40
    rows = [(i, i % 8, [float(v) for v in (centres[i % 8] + rng.normal(size=4) * 0.1)], "k", 1, 2) for i in range(400)]
    assert mined(spark.createDataFrame(rows, VECTORS), cell_rows=10, group_rows=8) == brute_negatives(rows)
    assert sent[0][0] < 0.5 * sent[0][1]


# 13: quality


def test_trees_as_arrays_are_the_trees():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 40, size=(500, len(quality.FEATURES))).astype(float)
    y = ((x[:, 3] > 20) ^ (x[:, 7] > 10)).astype(float)
    forest = quality.grow(x, y, trees=20, depth=3)
    for row, raw in zip(x[:50], forest.raw(x[:50]), strict=True):
        total = forest.base
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node - len(feature)]
        assert raw == pytest.approx(total)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_histogram_cuts_are_the_best_cuts():
    """With a bin for each value, the first cut is the best of all cuts, by brute force."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, size=(200, 5)).astype(float), rng.integers(0, 2, 200).astype(float)
    forest = quality.grow(x, y, trees=1, depth=1)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))

    def gain(f, c):
        left = x[:, f] <= c
        if min(left.sum(), (~left).sum()) < quality.MIN_ROWS:
            return 0
        return sum(g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE) for s in (left, ~left))

    best = max(gain(f, c) for f in range(5) for c in np.unique(x[:, f]))
    assert gain(forest.feature[0, 0], forest.cut[0, 0]) == pytest.approx(best)


def test_statistics(monkeypatch):
    one = dict(zip(quality.FEATURES, quality.statistics_of("The CAT, the cat!\nthe the | é %%%\n".encode()), strict=True))
    assert one["words"] == pytest.approx(math.log1p(9)) and one["repeats"] == pytest.approx(1 / 9) and one["lines"] == pytest.approx(math.log1p(2))
    assert one["top_word"] == pytest.approx(3 / 9) and one["distinct"] == pytest.approx(7 / 9) and one["full_lines"] == pytest.approx(1 / 2)
    assert quality.statistics_of(b"") == [0.0] * len(quality.FEATURES)
    text = ("some words of a line, " * 30 + "\n").encode() * 5 + b"x" * 500
    whole = quality.statistics_of(text)
    monkeypatch.setattr(quality, "SLICE", 64)
    cut = quality.statistics_of(text)
    for f, a, b in zip(quality.FEATURES, whole, cut, strict=True):
        if f not in ("window_distinct", "lines", "line_length", "distinct_lines", "full_lines", "sign_ends", "stop_ends"):
            assert a == pytest.approx(b), f


def test_quality_cases(spark):
    good, bad = "A line of plain words that ends well. And one more of them here.", "BUY!! NOW!! BUY!! NOW!! BUY!!"
    docs = [(i, good if i % 2 else bad, "x") for i in range(80)] + [(None, good, "x"), (500, None, "x"), (501, "", "x"), (502, "w " * 300_000, "x"), (3, good, "x")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, None), (None, 1), (999, 1)], "doc_id bigint, quality int")
    trees = quality.learn(docs, labels)
    got = quality.score(docs, trees).collect()
    assert len(got) == 85 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["text"] == good) for r in got if r["doc_id"] is not None and r["doc_id"] < 80)
    assert quality.labelled_statistics(docs, labels, most=10).count() <= 10
    many = spark.createDataFrame([(1, f"{good} {i}") for i in range(60)], "doc_id bigint, text string")
    assert 0 < quality.labelled_statistics(many, labels, most=20).count() <= 20
    for rows, share in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)):
        assert [r["score"] for r in quality.score(docs.limit(3), quality.learn(docs, rows)).collect()] == pytest.approx([share] * 3)
    assert quality.score(docs.limit(0), trees).count() == 0


def test_quality_as_registered(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op13_quality(spark, sf).join(common.table(spark, sf, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert held[0] > 0.97 and held[1] > 30
