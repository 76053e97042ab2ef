"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import common, exact_dedup, langid, mixing, near, packing, tokens
from maskwell.llm.common import remove, temp_name, write_table


def _begin(spark: SparkSession, docs: DataFrame, first: bool = False) -> None:
    """A stage's intermediate tables go when the next stage begins: its result has been written by then. Tables that
    ``docs`` itself reads stay. (Stages of two pipelines must not run side by side in one session.)"""
    if not first:
        read = docs.inputFiles()
        remove(spark, *[p for p in common.made_paths if not any(p.rpartition("/")[2] in f for f in read)])
    common.made_paths.clear()


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found. Rejected: texts without a letter, and texts none of whose n-grams
    is in the profile of any language. Learns from all labelled documents, a bounded sample of each language."""
    _begin(spark, docs, first=True)
    profiles = langid.fit(docs)
    name = temp_name(docs, "language")
    marked = docs.withColumn(name, langid.predict(F.col("text"), profiles))
    return marked.where((F.col(f"{name}.lang_pred") != langid.UND) & (F.col(f"{name}.score") > 0)).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    _begin(spark, docs)
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    _begin(spark, docs)
    return near.drop_near_duplicates(docs, shingle=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes; a row each time one is taken."""
    _begin(spark, docs)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with their token ids."""
    _begin(spark, docs)
    return packing.pack(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Fingerprints, language profiles and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
