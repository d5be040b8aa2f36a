"""A corpus pipeline of five stages; each reads what the one before it kept.

1. Toxic documents go. 2. Of each group of near copies one document stays. 3. Byte strings that repeat anywhere are
cut out of the texts. 4. Documents with windows of two or more benchmark items go; of others the spans of such
windows are cut out. 5. What is left is encoded. SQL cannot express the first, third and last stage.

Each stage states its rules in its operator. In short: null texts count as empty, pass every filter and are encoded as
such; documents without words are copies of nothing; of copies the one of the least id stays (an id before none, then any
one row of equal ids); rows of equal ids are rows of their own; empty tables give an empty table; other columns stay as they are
up to the last stage, but for n_chars, which is counted anew where a text was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import shared_dir, table, written
from veilspark.llm.decontaminate import clean
from veilspark.llm.jaccard import distinct_documents
from veilspark.llm.queries import tokenizer_model
from veilspark.llm.sentencepieces import encode_documents
from veilspark.llm.suffixdedup import without_repeats
from veilspark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_documents(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, tokenizer_model(), remember=False)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
