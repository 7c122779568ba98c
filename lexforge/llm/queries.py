"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, jaccard, langid, mixing, periodic, quality, simhash, sstable, tiff, token_counts, topk, toxicity, trie
from lexforge.llm.shared import held_out, table
from pyspark.sql import functions as F

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.learned_scores(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op4_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.resampled(docs, labels)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identified(docs, langid.train(docs))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.longest_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_toxicity, op2_simhash, op3_bpe, op4_tiff, op5_token_counts, op6_sstable, op7_mixing, op8_quality, op9_language, op10_top_k, op11_jaccard_join, op12_conversation_trie, op13_periodic_runs, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": mixing.oracle(), "op10_top_k": topk.ORACLE, "op11_jaccard_join": jaccard.ORACLE, "op12_conversation_trie": trie.ORACLE}
