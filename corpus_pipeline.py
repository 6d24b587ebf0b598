"""A training-corpus pipeline over ``documents``: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and gives the columns of documents, but
for the last, which gives the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import langid, ngram_join, packing, quality, secrets
from plumbline.llm.common import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table rejects go.

    Rows are judged one by one: null, empty and short texts go, of repeated rows all or none, nulls elsewhere don't
    matter. An empty table stays empty.
    """
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go.

    Rows of one doc_id (null is one) go only if none of them is identified. Models are fitted on the labels that are
    there; without any, and for null, empty or very short texts, nothing is identified. A null source is a host of its
    own. Ties go to the first language by name. An empty table stays empty.
    """
    return langid.keep_identified(docs, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of its least doc_id.

    Rows are judged one by one, so other rows of the same doc_id don't matter; null doc_ids come last, ties go to the
    text of least digest, then to the other columns as JSON. Repeated rows are copies. Texts without words stay. An
    empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are masked in the text, and n_chars follows; all rows stay.

    Null and empty texts stay as they are, and so does a null n_chars. Null sources are one owner. Repeated rows are
    masked each. An empty table stays empty.
    """
    return secrets.mask_live(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences.

    A null or empty text is its end mark alone; rows of null or repeated doc_ids are packed each, ties in size in any
    order. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_join", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack),
]
#: No SQL: links of near copies and packing can't be said in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
