"""Upkeep of a lexical index by a log of changes.

The index is a log of batches. A batch holds the nodes of what its changes add,
with their tokens, and the names of all documents that it touches; a node stands
until a later batch touches its document. So a batch is written without a look at
those before, and counts, document frequencies and lengths come of the nodes that
stand, without a rebuild. A batch is written under its number and replaces itself,
so a batch that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexforge.functions import text as T
from lexforge.operators import lexical
from lexforge.operators.nodes import chunk_nodes

NODES = "doc_id string, node_id string, tokens array<string>"
TOUCHED = "doc_id string"


def _read(spark: SparkSession, path: str, schema: str, before: int | None) -> DataFrame:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], schema + ", batch long")
    rows = spark.read.schema(schema + ", batch long").parquet(path)
    return rows if before is None else rows.filter(F.col("batch") < before)


def tokens(spark: SparkSession, index: str, before: int | None = None) -> DataFrame:
    """(doc_id, node_id, tokens) of the nodes that stand."""
    made, touched = _read(spark, f"{index}/nodes", NODES, before), _read(spark, f"{index}/touched", TOUCHED, before)
    first = touched.agg(F.min("batch")).first()[0]  # supersedes nothing
    last = touched.filter(F.col("batch") > F.lit(first)).groupBy("doc_id").agg(F.max("batch").alias("_last")).withColumnRenamed("doc_id", "_doc")
    return made.join(last, (F.col("doc_id") == F.col("_doc")) & (F.col("_last") > F.col("batch")), "left_anti").select("doc_id", "node_id", "tokens")


def postings(spark: SparkSession, index: str, terms: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """(doc_id, node_id, term, tf, node_len) of the index, or of ``terms`` alone."""
    rows = tokens(spark, index, before).select("doc_id", "node_id", F.size("tokens").cast("long").alias("node_len"), F.explode("tokens").alias("term"))
    rows = rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("doc_id", "node_id", "term", "node_len").agg(F.count("*").alias("tf")).select("doc_id", "node_id", "term", "tf", "node_len")


def nodes(spark: SparkSession, index: str, before: int | None = None) -> DataFrame:
    """(doc_id, node_id, node_len) of the index."""
    return tokens(spark, index, before).select("doc_id", "node_id", F.size("tokens").cast("long").alias("node_len"))


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each document: ``changes`` (doc_id, op, text[, seq])."""
    order = [F.col("seq").desc()] if "seq" in changes.columns else []
    last = Window.partitionBy("doc_id").orderBy(*order, F.col("op"), F.col("text"))
    return changes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(F.col("doc_id").cast("string").alias("doc_id"), "op", "text")


def apply_batch(spark: SparkSession, index: str, batch: int, changes: DataFrame) -> None:
    """Write one batch of changes: op is ``upsert`` (a new document or a new text
    of one) or ``delete``; deleting what is not there does nothing."""
    now = latest(changes)
    made = chunk_nodes(now.filter("op = 'upsert'")).select("doc_id", "node_id", lexical.index_tokens(T.text_of("text")).alias("tokens"))
    made.write.mode("overwrite").parquet(f"{index}/nodes/batch={batch}")
    now.select("doc_id").write.mode("overwrite").parquet(f"{index}/touched/batch={batch}")


def keep_up(changes: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Follow a stream of changes until there is no more of it."""
    spark = changes.sparkSession
    return changes.writeStream.foreachBatch(lambda rows, number: apply_batch(spark, index, number, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bm25(queries: DataFrame, index: str, k: int = 8) -> DataFrame:
    """(query_id, rank, node_id, doc_id, score): the best ``k`` nodes of each
    query, as a rebuilt index would give them."""
    return lexical.fts_nodes(queries, tokens(queries.sparkSession, index), k)
