"""Corpus pipeline: quality rules, near-duplicates, repeated passages, private data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. A stage works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import curve_packing, pseudonyms, quality_votes, repeats, set_join
from tideline.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A cluster sets its own secret; equal secrets give equal pseudonyms.
KEY_CONF, DEFAULT_KEY = "spark.tideline.pseudonym.key", "tideline-pipeline-key"


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted again."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep.

    The measures are written once, beside the texts: fitting and judging both read
    them, and a filter on verdicts would else be pushed into them.
    """
    measured = materialize(quality_votes.measure(docs), "measured")
    return quality_votes.score(measured, quality_votes.fit(measured)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates; rows without an id stay."""
    kept = set_join.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that an earlier one has."""
    return _columns(repeats.remove_repeats(docs))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for private data."""
    return _columns(pseudonyms.hide_private(docs, spark.conf.get(KEY_CONF, DEFAULT_KEY)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training sequences, with their ids."""
    return curve_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("private_data", private_data),
    ("packing", packing),
]

#: The last stages (byte-level matches, keyed permutations, a learned tokenizer) are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
