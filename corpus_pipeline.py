"""A cleaning pipeline over documents: each stage reads what the one before has written.

All stages take texts of any length whole, a null text as an empty one, and rows with a null id or that repeat like any
other; extra columns stay as they are, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import near_copies, packing, quality_rules, toxicity
from tidegrid.llm.common import dropped, shipped, written_alone


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The labelled rows that models are learned from: the whole input's, whatever earlier stages have dropped."""
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; empty ones have no toxic words and stay."""
    return toxicity.without_toxic(docs, toxicity.learn(*_given(spark, sf_dir)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go, empty ones among them."""
    return quality_rules.kept(docs, quality_rules.learn(*_given(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    Fingerprints within two bits are found as the operator of op5_simhash finds them; that pairs further apart are found as
    well, near_copies adds MinHash bands. Whole shingle sets decide.
    """
    shipped(spark)
    return near_copies.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence for every piece of every document that is left; rows that repeat are packed each on its own."""
    shipped(spark)
    return packing.packed(docs, special=True)


STAGES = [("toxicity", clean_language), ("quality_rules", good_quality), ("simhash_near_dedup", near_duplicates), ("best_fit_packing", packed)]
#: The stages rest on trained models, fingerprints and a tokenizer, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents of a folder; labels are learned from its table labels.

    Each stage's result is written; what it wrote on the way, and what the stage before has written, is deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written_alone(partial(stage, spark, docs, sf_dir), name)
        if k:
            dropped(before)
    return docs
