"""The driver's tables, seen as what the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.nodes import chunk_nodes, line_nodes


#: Below so many bytes for each core, a table of texts is dealt out anew: a small file is often one row group, hence one task.
SMALL = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """A small table of texts over all cores, so that work on its rows is not
    left to one; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_nodes(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_nodes(table(spark, sf_dir, "documents"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as a batch of queries: (query_id, query)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as queries, each with a word that shows an intent."""
    words = F.array(*[F.lit(w) for w in TURN_WORDS])
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.concat_ws(" ", F.col("text"), F.element_at(words, (F.pmod("conv_id", F.lit(len(TURN_WORDS))) + 1).cast("int"))).alias("query"))


TURN_WORDS = ["compare", "survey", "cite", "limitation", "metric 5", "model", "and more", "difference of method", "overview"]

# Pieces of SQL that give the same inputs in DuckDB.

SQL_CHUNKS = r"""trimmed AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
sliced AS (SELECT doc_id, list_filter(list_transform(range(0, (length(t) + 1799) // 1800), lambda i: regexp_replace(substr(t, (i * 1800 + 1)::BIGINT, 1800), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS c FROM trimmed),
nodes AS (SELECT doc_id || ':' || i AS node_id, doc_id, i AS order_index, text FROM (SELECT doc_id, unnest(c) AS text, unnest(range(len(c))) AS i FROM sliced))"""

SQL_LINES = r"""nodes AS (SELECT doc_id || ':' || i AS node_id, doc_id, i AS order_index, text FROM (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE trim(text) <> '')"""

SQL_PASSAGES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

SQL_TURNS = "queries AS (SELECT conv_id || '-' || turn AS query_id, text || ' ' || (" + str(TURN_WORDS) + ")[conv_id % " + str(len(TURN_WORDS)) + " + 1] AS query FROM conversations)"

SQL_QUERY_TERMS = r"""asked AS (SELECT query_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT query_id, regexp_extract_all(query, '[\p{L}\p{N}_]+') AS w FROM queries)),
firsts AS (SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS r FROM asked GROUP BY query_id, token),
wanted AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(strip_accents(lower(token)), '[\p{L}\p{N}]+')) AS term FROM firsts WHERE r <= 16)"""

SQL_BM25 = r"""tokens AS (SELECT node_id, doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') AS w FROM nodes),
stats AS (SELECT count(*) AS n, avg(len(w)) AS average FROM tokens),
tfs AS (SELECT node_id, doc_id, term, len(any_value(w)) AS node_len, count(*) AS tf FROM (SELECT node_id, doc_id, w, unnest(w) AS term FROM tokens) WHERE term IN (SELECT term FROM wanted) GROUP BY node_id, doc_id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
bm25 AS (SELECT query_id, node_id, doc_id, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * node_len / average))) AS score
  FROM wanted JOIN tfs USING (term) JOIN dfs USING (term) CROSS JOIN stats GROUP BY query_id, node_id, doc_id)"""
