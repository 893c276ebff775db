"""Documents to token ids: five stages, each written as Parquet and read by the next.

Toxic documents go, boilerplate lines of a source go, one document of each group of near
duplicates stays, documents that hold a passage of a benchmark item go, and what is left is
encoded. Stages that hand whole texts to Python write their results themselves: ``written`` hands over few rows at a
time, where a plan that is run later would hand over 10,000. All stages but the last return the columns of ``documents``, those that came besides included.

Defined cases: a null or empty text is neither toxic nor a copy nor contaminated, and is encoded as no
tokens; rows with a null id or source are judged like others; of rows that repeat id and text one stays, and rows
that only share an id are judged one by one; empty tables give empty results; texts of any length go in whole;
columns that have the name of one of an operator's results keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from claimweave.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))
    return written(toxicity.drop_toxic(docs, lexicon), "toxicity")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(docs, F.col("source"), whole=True)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written(bpe.tokenize(docs, ["doc_id", "lang", "source", "n_chars"]), "byte-level-bpe")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: The lexicon is learned and min-max hashing draws its permutations, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if "written_to" not in vars(docs):
            docs = written(docs, name.replace(" ", "-"))
    return docs
