"""A corpus from raw documents to packed sequences: quality rules, near duplicates, personal data, mixing, packing.

Each stage takes (spark, documents, folder of the tables) and works on all that the one before it kept; between
stages the documents are written as Parquet to the shared folder and read again.

Defined results: a null or blank text fails the quality rules and goes; where a stage is given one, it keeps it
(near duplicates: repeated rows are one; mixing: it follows its block; packing: its end id alone).  Null ids,
languages and sources are values of their own.  Of near duplicates the smallest doc_id stays, a null one only if
there is no other.  Further columns pass all stages but the last, whatever their names.  Empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kairograph.llm.common import stored, table
from kairograph.llm.mixing import remix
from kairograph.llm.ngram_join import deduplicate
from kairograph.llm.packing import pack
from kairograph.llm.pii import redact
from kairograph.llm.quality import keep_good
from kairograph.llm.tokens import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles with a similarity of 0.8 join, one stays."""
    return deduplicate(docs, width=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated up to their weight; every document stays."""
    return remix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages on sets of shingles, vote patterns and tokens have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
