"""Distant supervision: labels of tokens by the values that are known of their page.

A value claims the first run of tokens that spells it and of which none is claimed; longer values (in characters) go first,
among equals those whose path comes first. Letters are compared by full case folding, without ``.,:;`` at the ends of words.

A page's tokens and its values meet in one row, so tokens are dealt by page once and nothing else is sent. There a value looks only at
the places of its first word. Pages are the only groups that meet in one task.

Defined cases: a null or blank value, or one on a page without tokens, claims nothing; null texts are empty words; of equal
(page, path) rows each value claims a place of its own; pages with a null key have no labels; columns besides are kept for tokens, whatever their names but ``label``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, let, tokens
from ..schema import FIELD_PATHS, LINE_ITEM_FIELDS

#: Fixed value: what is cut from the ends of words.
EDGES = ".,:;"
PLACES = {p: i for i, p in enumerate((*FIELD_PATHS, *(f"line_items.{f}" for f in LINE_ITEM_FIELDS)))}


def bare(word: Column) -> Column:
    return F.btrim(let(F.coalesce(word, F.lit("")), casefold), F.lit(EDGES))


def _place(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in PLACES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, path), F.lit(len(PLACES)))


def placed(words: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, pos, bare, row): each token's place on its page from 0, how it is compared, and all its columns."""
    by = Window.partitionBy(page_col).orderBy("idx")
    row = F.struct(*(F.col(f"`{c}`") for c in words.columns)).alias("row")
    return words.where(f"`{page_col}` is not null").select(page_col, (F.row_number().over(by) - 1).alias("pos"), bare(F.col("text")).alias("bare"), row)


def claim(words: list[str], wanted: list[list[str]]) -> list[tuple[int, int]]:
    """(which, start) of each value's first place that is free when its turn comes, in their order."""
    places: dict[str, list[int]] = {want[0]: [] for want in wanted}
    for i, word in enumerate(words):
        if word in places:
            places[word].append(i)
    taken: set[int] = set()
    out = []
    for which, want in enumerate(wanted):
        size = len(want)
        for start in places[want[0]]:
            if words[start : start + size] == want and taken.isdisjoint(range(start, start + size)):
                taken.update(range(start, start + size))
                out.append((which, start))
                break
    return out


def _wanted(values: Column) -> Column:
    """Of an array of (path, value): path and words of those that have words, in the order in which they claim."""
    rows = F.transform(values, lambda v: F.struct((-F.char_length(v["value"])).alias("chars"), _place(v["path"]).alias("place"), v["path"].alias("path"), v["value"].alias("value"), F.transform(tokens(v["value"]), bare).alias("want")))
    return F.sort_array(F.filter(rows, lambda r: F.size(r["want"]) > 0))


def _marks(pages: DataFrame, words: Column) -> DataFrame:
    """Adds ``marks``, (pos, label) of each token that a value of ``wanted`` claims."""

    @F.pandas_udf("array<struct<which:int,start:int>>")
    def claimed(words: pd.Series, wanted: pd.Series) -> pd.Series:
        found = (claim(list(w), [list(x) for x in v]) if v is not None and len(v) else [] for w, v in zip(words, wanted, strict=True))
        return pd.Series([[{"which": i, "start": at} for i, at in f] for f in found], dtype=object)

    found = pages.withColumn("_claims", claimed(words, F.transform("wanted", lambda v: v["want"])))

    def of(c: Column) -> Column:
        value = F.element_at("wanted", c["which"] + 1)
        return F.transform(value["want"], lambda _, i: F.struct((c["start"] + i).alias("pos"), F.concat(F.when(i == 0, "B-").otherwise("I-"), value["path"]).alias("label")))

    return found.withColumn("marks", F.flatten(F.transform("_claims", of))).drop("_claims")


def label_pages(pages: DataFrame, page_col: str = "page_id") -> DataFrame:
    """(page, idx, label) of the tokens that values claim, from rows that hold a page each: its ``words``, and its ``values`` as (path, value)."""
    rows = pages.where(f"`{page_col}` is not null").select(page_col, F.transform("words", bare).alias("bare"), _wanted(F.col("values")).alias("wanted")).where(F.size("wanted") > 0)
    return _marks(rows, F.col("bare")).select(page_col, F.inline("marks").alias("idx", "label"))


def label_tokens(words: DataFrame, values: DataFrame, page_col: str = "page_id") -> DataFrame:
    """All columns of ``words`` (page, idx, text and others), with ``label``."""
    token = F.struct("pos", "bare", "row")
    by_place = lambda a, b: (a["pos"] - b["pos"]).cast("int")
    pages = placed(words, page_col).groupBy(page_col).agg(F.array_sort(F.collect_list(token), by_place).alias("tokens"))
    known = values.where(f"`{page_col}` is not null").groupBy(page_col).agg(_wanted(F.collect_list(F.struct("path", "value"))).alias("wanted"))
    marked = _marks(pages.join(known, page_col, "left"), F.transform("tokens", lambda t: t["bare"]))
    named = F.map_from_entries(F.coalesce("marks", F.array().cast("array<struct<pos:int,label:string>>")))
    labelled = marked.select(named.alias("named"), F.inline("tokens")).select("row.*", F.coalesce(F.try_element_at("named", F.col("pos").cast("int")), F.lit("O")).alias("label"))
    nowhere = words.where(f"`{page_col}` is null").withColumn("label", F.lit("O"))
    return labelled.unionByName(nowhere)


def values_of(records: DataFrame, page_col: str = "page_id", record_col: str = "truth") -> DataFrame:
    """(page, path, value) of a raw record's header fields and of the fields of its line items."""
    record = F.col(record_col)
    head = [F.struct(F.lit(p).alias("path"), record[p.split(".")[0]][p.split(".")[1]].alias("value")) for p in FIELD_PATHS]
    rows = F.flatten(F.transform(record["line_items"], lambda i: F.array(*(F.struct(F.lit(f"line_items.{f}").alias("path"), i[f].alias("value")) for f in LINE_ITEM_FIELDS))))
    every = F.concat(F.array(*head), F.coalesce(rows, F.array().cast("array<struct<path:string,value:string>>")))
    return records.select(page_col, F.inline(every)).where("value is not null")
