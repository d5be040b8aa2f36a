"""The queries of this subpackage, each an operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import table


def tokenizer_model() -> str:
    """Where the public tokenizer files of this machine lie; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.pagediff import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.sentencepieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_model())


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.warcfixity import drill

    return drill(table(spark, sf_dir, "pages"))


def op6_warc_fixity_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.warcfixity import drill_both

    return drill_both(table(spark, sf_dir, "pages"))


def op7_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.brown import score_corpus

    return score_corpus(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.jaccard import link_components

    return link_components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.suffixdedup import report

    return report(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from veilspark.llm import decontaminate, jaccard, warcfixity

    return {"op4_decontamination": decontaminate.ORACLE, "op6_warc_fixity": warcfixity.ORACLE, "op8_ngram_jaccard": jaccard.ORACLE}
