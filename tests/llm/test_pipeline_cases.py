"""The stages of the pipeline on rows with nulls, repeats, long texts and other columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import common

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [0, 1])
def test_stages(spark, rows):
    docs = common.table(spark, SF, "documents")
    long = " ".join(f"t{i}" for i in range(60_000))
    odd = [(-1, None, "en", "s", 0), (-2, "", "en", "s", 0), (-3, long, "en", None, len(long)), (None, "a text without an id that stays", None, "s", None), (-5, "the same row", "en", "s", 12), (-5, "the same row", "en", "s", 12), (-5, "an id twice", "en", "s", 11)]
    docs = docs.limit(60).unionByName(spark.createDataFrame(odd, docs.schema)) if rows else docs.limit(0)
    docs = docs.withColumns({"score": F.lit(0.77), "n_lines": F.lit(5), "_id": F.lit("x"), "key": F.lit(1)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
    assert {(r["score"], r["n_lines"], r["_id"], r["key"]) for r in docs.collect()} == ({(0.77, 5, "x", 1)} if rows else set())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.where("not round_trip").count() == 0 and out.count() == docs.count()
    if rows:
        left = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert all(left.count(x) == 1 for x in [(-1, None), (-2, ""), (-3, long), (None, "a text without an id that stays"), (-5, "the same row"), (-5, "an id twice")])


# Workers are used again, and what one stage left in them stood beside the memory of the next


def test_a_worker_remembers_for_one_operator_at_a_time():
    import public_tokenizers

    from claimweave.llm import bpe, toxicity

    data = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    first = bpe.encoder_of(data, public_tokenizers.PATTERN)
    assert bpe.encoder_of(data, public_tokenizers.PATTERN) is first
    list(toxicity._counted(toxicity._beginnings, None)(iter([])))
    assert bpe.encoder_of(data, public_tokenizers.PATTERN) is not first


def test_stages_with_whole_texts_in_python_hand_over_few_rows_at_a_time(spark):
    docs = common.table(spark, SF, "documents").limit(20)
    for name in ("toxicity", "byte-level bpe"):
        assert "written_to" in vars(dict(corpus_pipeline.STAGES)[name](spark, docs, SF)), name
