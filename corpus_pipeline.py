"""From raw documents to a training mix: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cratebind.llm import decontam, langid, mixing, near_dedup, secret_scan
from cratebind.llm.common import bounded, keep, table


def settled(docs: DataFrame, name: str) -> DataFrame:
    """docs worked out now and kept in small row groups. Batches to Python hold bytes, not rows, only where a stage ends within `bounded`:
    a stage that is left to its reader goes in batches of 10 000 whole texts, which add up in the memory of an executor's workers."""
    return keep(docs, f"pipeline-{name}", large=True)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, texts without a letter, and those whose trigrams no language
    holds more of than chance gives. Repeated rows go or stay together; without labelled texts nothing is recognised, so all go; an
    empty table stays empty."""
    with bounded(spark):
        return settled(langid.keep_known(docs), "language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest doc_id. Null texts are one class, empty ones another; of rows
    that repeat doc_id and text one stays; an empty table stays empty."""
    with bounded(spark):
        return settled(near_dedup.drop_near(docs), "near_duplicates")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none, and null and blank items are in none; repeated rows go or
    stay together; an empty table on either side changes nothing."""
    with bounded(spark):
        return settled(decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark")), "decontaminate")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every row stays, null and empty texts and repeated rows as they are; an empty table stays
    empty."""
    with bounded(spark):
        return settled(secret_scan.redact_secrets(docs), "secrets")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of each and the `copies` that these make: whole texts and, last, a part. Documents of
    which it takes none go, so null and blank texts go; repeated rows are taken apart; an empty table stays empty."""
    return mixing.with_copies(mixing.mix_sources(docs).where("taken > 0"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("mix", mix)]

#: Order MinHash and automata inference are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
