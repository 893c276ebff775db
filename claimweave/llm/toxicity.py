"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters of other scripts, digits and signs that
stand for letters, zero-width characters, punctuation) and matched by one
Aho-Corasick automaton, longest match first. An entry is a beginning of a word, or a whole word
(written with a space after it), with a weight; an exception is a word or a phrase of several words and
of weight zero: as a longer match it covers the entry inside it. A text's weight and its weight for each
thousand words go through a logistic curve to a score from 0 to 1.

Lexicon, exceptions and curve are learned from a sample of at most ``most`` labelled rows (``MAX_SAMPLE``): ids are chosen first, by hash, and their
texts are written where they are read. Entries are word beginnings of ``prefix`` letters, and whole words that are shorter or longer
than those, which are at least ``MIN_ODDS`` times as frequent among toxic rows as among others, in as few
letters as that takes and as many as nearly all toxic uses share. Words with such a beginning that are mainly
used in other rows become exceptions, and so do they with the word before or after them. An
entry stands in ``min_docs`` toxic rows of the sample at least and an exception in as many others, for a share
of fewer rows says nothing. Features are counted and compared in Spark; only the entries, what lengthens them, and the exceptions come to the
driver, all of them, and an error is raised where they are more than may be broadcast, measured.

Defined cases: null is the empty text; without words there is no match, so the score
is the curve's at zero; without labelled rows of both kinds every score is 0; of labels for
one id the greatest counts, null labels don't; rows that share an id are sample rows each; repeated rows give
a row each; texts of any length are scored whole; ``score`` replaces columns that have the name of a result,
``drop_toxic`` returns the columns as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits, fold, private, remembered, table, written

MAX_SAMPLE = 20_000
MIN_ODDS = 12.0
MIN_DOCS = 5
PREFIX = (3, 14)

#: Look-alike letters and digits that stand for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ո": "n", "օ": "o", "ѵ": "v", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
ZERO_WIDTH = "​‌‍⁠﻿­"

#: 1, | and ! stand for i and l alike, so l is one letter with i on both sides, lexicon and text.
_LETTERS = LOOK_ALIKES | DIGITS | {"l": "i"}
_WIDE = {chr(0xFF01 + i): _LETTERS.get(c := chr(0x21 + i).lower(), c) for i in range(94)}
_FOLD = str.maketrans(_LETTERS | dict.fromkeys(ZERO_WIDTH) | _WIDE)
_SIGN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
_GAP = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Words apart by two spaces, with one at either end."""
    text = (text or "").lower()
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return _GAP.sub("  ", f" {text.translate(_FOLD)} ")


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # word beginning, or whole word and a space -> weight
    exceptions: list[str] = field(default_factory=list)  # whole words or phrases
    curve: tuple[float, float, float] | None = None

    def matcher(self):
        """text -> (weight, number of words), the automaton built once."""
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            automaton.add_word(f" {folded(entry).strip()}" + " " * entry.endswith(" "), weight)
        for phrase in self.exceptions:
            if words := folded(phrase).split():
                automaton.add_word(" " + "  ".join(words) + " ", 0.0)
        if not len(automaton):
            return lambda text: (0.0, folded(text).count("  ") - 1)
        automaton.make_automaton()
        found = automaton.iter_long

        def weigh(text: str | None) -> tuple[float, int]:
            text = folded(text)
            return sum(w for _, w in found(text)), max(0, text.count("  ") - 1)

        return weigh

    def score(self, weight: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(weight))
        return 1 / (1 + np.exp(-np.clip(_inputs(weight, words) @ np.array(self.curve), -40, 40)))


def _inputs(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000 * weight / (words + 20.0))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Newton's method with a small ridge, which separable data need."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _beginnings(text: str | None, prefix: tuple[int, int] = PREFIX) -> set[str]:
    """Beginnings of words, and with a space after them whole words that are no such beginning."""
    low, high = prefix
    words = set(folded(text).split())
    return {w[:n] for w in words for n in range(low, min(high, len(w)) + 1)} | {f"{w} " for w in words if not low <= len(w) <= high}


def _counted(count, wanted_label: int | None):
    """Partial counts of what ``count`` gives for each row, a flush before they grow large."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("toxicity")
        sums: Counter = Counter()
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                if wanted_label is None or toxic == wanted_label:
                    sums.update((f, toxic) for f in count(text))
                if len(sums) > 100_000:
                    yield _frame(sums)
                    sums.clear()
        yield _frame(sums)

    return run


def _frame(sums: Counter) -> pd.DataFrame:
    return pd.DataFrame([(f, int(t == 1) * n, int(t != 1) * n) for (f, t), n in sums.items()], columns=["feature", "toxic", "clean"])


def _totals(sample: DataFrame, count, wanted_label: int | None = None) -> DataFrame:
    rows = sample.mapInPandas(_counted(count, wanted_label), "feature string, toxic bigint, clean bigint")
    return rows.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MAX_SAMPLE) -> DataFrame:
    """text and toxic of at most ``most`` labelled rows, chosen by hash. No task gathers texts: ids are chosen before any is
    read, and where rows share ids, so that they are more, places of rows are."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = written(known.orderBy(F.xxhash64("_id"), "_id").limit(most), "toxicity-ids")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen) if fits(chosen) else chosen, "_id")
    found = written(rows.select("_id", "text", "toxic", F.monotonically_increasing_id().alias("place")), "toxicity-sample")
    if found.count() > most:
        kept = written(found.select("place").orderBy(F.xxhash64("place")).limit(most), "toxicity-places")
        found = found.join(F.broadcast(kept), "place")
    return found.drop("place")


def _on_driver(rows: DataFrame, what: str) -> list:
    """All rows of a table that a lexicon is made of."""
    if not fits(rows):
        raise ValueError(f"more {what} than may be broadcast")
    return rows.collect()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_SAMPLE, min_docs: int = MIN_DOCS, prefix: tuple[int, int] = PREFIX) -> Lexicon:
    """A lexicon from the rows of ``docs`` that ``labels`` (id, toxic) covers."""
    sample = labelled_sample(docs, labels, id_col, text_col, most)
    sample = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # few large files would be few tasks
    lexical = sample.where(F.pmod(F.xxhash64(F.lit("lexicon"), "_id"), F.lit(4)) != 0)
    n = {bool(t): c for t, c in lexical.groupBy(F.col("toxic") == 1).count().collect()}
    if not n.get(True) or not n.get(False):
        return Lexicon()
    toxic_rows, clean_rows = n[True], n[False]
    beginnings = lambda text: _beginnings(text, prefix)
    seen = written(_totals(lexical, beginnings, wanted_label=1).where(F.col("toxic") >= min_docs).select("feature", "toxic"), "toxicity-seen")
    count = beginnings
    if fits(seen):  # then other rows needn't count what no entry can be; the counts that are asked for are the same
        known = {r["feature"] for r in seen.collect()}
        count = lambda text: beginnings(text) & known
    clean = _totals(lexical, count, wanted_label=0).select("feature", "clean")
    odds = ((F.col("toxic") + 0.5) / (toxic_rows + 1)) / ((F.col("clean") + 0.5) / (clean_rows + 1))
    rated = written(seen.join(clean, "feature", "left").fillna(0, ["clean"]).withColumn("odds", odds), "toxicity-features")
    first = Lexicon(_entries(rated, prefix[0]))
    matched = _totals(lexical, _matched_phrases(first.weights))
    ratio = clean_rows / toxic_rows
    harmless = written(matched.where((F.col("clean") >= min_docs) & (F.col("clean") > F.col("toxic") * ratio)), "toxicity-exceptions")
    first.exceptions = sorted(r["feature"] for r in _on_driver(harmless.select("feature"), "exceptions"))
    weigh = first.matcher

    def weights(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        remembered("toxicity")
        of = weigh()
        for f in frames:
            found = [of(t) for t in f["text"]]
            yield pd.DataFrame({"w": [float(a) for a, _ in found], "n": [b for _, b in found], "toxic": f["toxic"]})

    points = sample.mapInPandas(weights, "w double, n bigint, toxic int").toPandas()  # three numbers for each row of the sample
    first.curve = _logistic(_inputs(points["w"].to_numpy(), points["n"].to_numpy(float)), (points["toxic"] == 1).to_numpy(float))
    return first


def _entries(rated: DataFrame, shortest: int) -> dict[str, float]:
    """Shortest beginnings that are telling, lengthened while nearly all toxic uses share a letter more, and telling whole words."""
    whole = F.endswith("feature", F.lit(" "))
    telling = rated.where(F.col("odds") >= MIN_ODDS)
    begin = telling.where(~whole)
    starts = lambda of, last: F.transform(F.sequence(F.lit(shortest), last), lambda i: F.substring(of, F.lit(1), i))
    size = F.char_length("feature")
    above = begin.where(size > shortest).select("feature", F.explode(starts(F.col("feature"), size - 1)).alias("start"))
    roots = written(begin.join(above.join(begin.select(F.col("feature").alias("start")), "start").select("feature").distinct(), "feature", "left_anti").select(F.col("feature").alias("root"), "toxic"), "toxicity-roots")
    under = rated.where(~whole).select("feature", "toxic", "odds", F.explode(starts(F.col("feature"), size)).alias("root"))
    # A letter more keeps nine tenths of the uses, so what lengthens a root by n letters has 0.9^n of them at least.
    under = under.join(roots.withColumnRenamed("toxic", "uses"), "root").where(F.col("toxic") >= 0.999 * F.col("uses") * F.pow(F.lit(0.9), F.char_length("feature") - F.char_length("root")))
    rows = _on_driver(written(under.select("root", "feature", "toxic", "odds").unionByName(telling.where(whole).select(F.col("feature").alias("root"), "feature", "toxic", "odds")), "toxicity-entries"), "entries")
    docs, odds = {r["feature"]: r["toxic"] for r in rows}, {r["feature"]: r["odds"] for r in rows}
    children: dict[str, list[str]] = {}
    for f in docs:
        if not f.endswith(" "):
            children.setdefault(f[:-1], []).append(f)
    out = {}
    for f in sorted({r["root"] for r in rows}):
        while not f.endswith(" ") and (longer := max(children.get(f, []), key=lambda c: (docs[c], c), default=None)) and docs[longer] >= 0.9 * docs[f]:
            f = longer
        out[f] = math.log(odds[f])
    return out


def _matched_phrases(entries: dict[str, float]):
    """text -> words that an entry matches, each alone, with the word before it and with the word after it."""
    lengths = sorted({len(e) for e in entries if not e.endswith(" ")})

    def count(text: str | None) -> set[str]:
        words = folded(text).split()
        known = {w: any(w[:n] in entries for n in lengths if n <= len(w)) or f"{w} " in entries for w in set(words)}
        out: set[str] = set()
        for i, w in enumerate(words):
            if known[w]:
                out.add(w)
                if i:
                    out.add(f"{words[i - 1]} {w}")
                if i + 1 < len(words):
                    out.add(f"{w} {words[i + 1]}")
        return out

    return count


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs``, with score and predicted (columns of these names are replaced)."""
    from pyspark.sql.types import DoubleType

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        remembered("toxicity")
        weigh = lexicon.matcher()
        for texts in batches:
            found = [weigh(t) for t in texts]
            yield pd.Series(lexicon.score(np.array([a for a, _ in found], float), np.array([b for _, b in found], float)))

    return docs.withColumn(into[0], scored(F.col(text_col))).withColumn(into[1], (F.col(into[0]) >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays under the threshold."""
    into = private("_score", docs), private("_predicted", docs)
    return score(docs, lexicon, text_col, threshold, into).where(F.col(into[1]) == 0).select(*docs.columns)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, training_labels(table(spark, sf_dir, "labels")))
    return score(docs, lexicon).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
