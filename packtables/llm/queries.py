"""Registered queries of the corpus operators: thin wrappers over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packtables.llm import chatformat, decontaminate, qualityrules
from packtables.session import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.pii import extract

    return extract(read_table(spark, sf_dir, "documents"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.tokenfile import token_file_round_trip

    return token_file_round_trip(read_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.bytebpe import digests

    return digests(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.qualityrules import verdicts

    return verdicts(read_table(spark, sf_dir, "documents"), policy="v1")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy versions of operator 4 and what each of their rules does, over all documents."""
    from packtables.llm.qualityrules import ledger, policy_report

    return policy_report(ledger(read_table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.langid import held_out_column, identify, train

    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out_column().alias("held_out"), "lang_pred", "score", "spans")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.chatformat import format_chats

    return format_chats(read_table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.gam import classify

    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.secretscan import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.decontaminate import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.mixing import allocation

    return allocation(read_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.resampling import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packtables.llm.whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_pii, op2_token_file, op3_byte_bpe, op4_quality_rules, op5_language_id, op6_chat_format, op7_simhash,
    op8_quality_classifier, op9_secret_scan, op10_decontamination, op11_mixing, op12_importance_resampling, op13_whitening,
    quality_ablations)}

#: Where DuckDB can give a query's rows over whole tables.
ORACLE = {
    "op4_quality_rules": qualityrules.ORACLE,
    "quality_ablations": qualityrules.ABLATIONS_ORACLE,
    "op6_chat_format": chatformat.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
}
