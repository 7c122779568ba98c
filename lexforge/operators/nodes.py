"""Nodes: the pieces of documents that search and extraction work on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T


def chunk_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1800) -> DataFrame:
    """(node_id, doc_id, order_index, type, heading, node_path, text): each
    document's chunks of up to ``size`` characters, in order."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(T.chunks(T.text_of(text_col), size)).alias("order_index", "text"))
    return _named(parts)


def line_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with one node for each line that is not empty."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(T.text_of(text_col), "\n")).alias("order_index", "text"))
    return _named(parts.filter(F.trim("text") != ""))


def _named(parts: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("order_index").cast("string"))
    return parts.select(key.alias("node_id"), "doc_id", "order_index", F.lit("paragraph").alias("type"), F.lit("").alias("heading"), F.lit("").alias("node_path"), "text")


def sentence_list(text: Column, minimum: int = 12, per_node: int = 5) -> Column:
    """Claim sentences of a text: split at sentence ends, at least ``minimum``
    characters and a letter or digit, the first ``per_node``."""
    parts = F.split(text, r"[。！？!?;；\n]+|\.\s+")
    flat = F.when(T.plain(text), F.transform(parts, lambda x: F.trim(x))).otherwise(F.transform(parts, T.compact))  # line ends are between parts
    return F.slice(F.filter(flat, lambda s: (F.length(s) >= minimum) & F.regexp_like(s, F.lit(r"[\p{L}\p{N}]"))), 1, per_node)


def sentences(nodes: DataFrame, keep: list[str], minimum: int = 12, per_node: int = 5) -> DataFrame:
    """The claim sentences of nodes, one a row."""
    return nodes.select(*keep, F.posexplode(sentence_list(F.col("text"), minimum, per_node)).alias("position", "sentence"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 120, times: int = 2) -> DataFrame:
    """Lines that repeat within a document: (id, noise_key, n_lines).

    A line's key is the line in lower case with digits as #; keys of lines of up
    to ``limit`` characters that occur ``times`` times or more are noise.
    """
    lines = docs.select(id_col, F.explode(F.split(T.text_of(text_col), "\n")).alias("line")).select(id_col, T.compact(F.col("line")).alias("line"))
    keyed = lines.filter((F.col("line") != "") & (F.length("line") <= limit)).select(id_col, noise_key(F.col("line")).alias("noise_key"))
    return keyed.groupBy(id_col, "noise_key").agg(F.count("*").alias("n_lines")).filter(F.col("n_lines") >= times)


def noise_key(line: Column) -> Column:
    return F.regexp_replace(F.lower(T.compact(line)), r"\d+", "#")
