"""From raw documents to tokens in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next one's docs.
Every stage works on all that its predecessor kept; all but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, mixing, quality, simhash, toxicity
from lexforge.llm.queries import WORD_BPE, tokenizer
from lexforge.llm.shared import discard, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.clean(docs.select(COLUMNS), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.sample(docs.select(COLUMNS), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs.select(COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document stays as often as its count says."""
    return mixing.mixed(docs.select(COLUMNS), copy_col=None, key_col=None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the decoded text."""
    return bpe.encode_decode(docs, tokenizer(WORD_BPE), keep_ids=True)


STAGES = [
    ("toxicity", not_toxic),
    ("quality", good_quality),
    ("near_duplicates", no_near_duplicates),
    ("mixing", mixed_sources),
    ("tokens", tokens),
]

#: No SQL expresses the learned stages; tests compare the run with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            discard(before)
    return docs
