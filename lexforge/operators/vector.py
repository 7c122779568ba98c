"""Vector search: hash embeddings, similarity, and the embedding index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import config as C
from lexforge.functions import text as T
from lexforge.operators.best import PAIRS, Best, rounded
from lexforge.operators.lexical import ranked

#: Query vectors up to which a batch is broadcast (256 doubles each: 16 MB).
BROADCAST_QUERIES = 8_192


def hash_bucket(token: Column, dim: int = C.HASH_DIM) -> Column:
    """First four bytes of SHA-256, big-endian, modulo ``dim``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_sign(token: Column) -> Column:
    """+1 if the fifth byte of SHA-256 is even, else -1."""
    return F.when(F.conv(F.substring(F.sha2(token, 256), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def hash_features(rows: DataFrame, id_col: str, text: Column, dim: int = C.HASH_DIM) -> DataFrame:
    """(id, idx, value): the non-zero sums of each text's signed hashes."""
    each = rows.select(id_col, F.explode(T.embedding_tokens(text)).alias("token"))
    return each.groupBy(id_col, hash_bucket(F.col("token"), dim).alias("idx")).agg(F.sum(hash_sign(F.col("token"))).alias("value")).filter("value <> 0")


def hash_embeddings(rows: DataFrame, id_col: str, text: Column, dim: int = C.HASH_DIM) -> DataFrame:
    """(id, vector): unit vectors of ``dim``, rounded to 8 digits; a text
    without tokens has a vector of zeros. One row at a time, no shuffle."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hash_provider(b.column(1).to_pylist(), dim), pa.list_(pa.float64()))], names=["id", "vector"])

    return rows.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, f"id {kind}, vector array<double>").withColumnRenamed("id", id_col)


def normalized(v: Column, digits: int | None = 8) -> Column:
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(v, lambda x: F.round(x / norm, digits) if digits is not None else x / norm)
    return F.when(norm > 0, unit).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 if either is empty or their lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), product).otherwise(0.0)


def vector_top_k(queries: DataFrame, nodes: DataFrame, k: int = 8, positive: bool = True) -> DataFrame:
    """(query_id, rank, node_id, score) by cosine of unit vectors.

    ``queries`` (query_id, vector) are searched in blocks of at most
    ``BROADCAST_QUERIES`` against ``nodes`` (node_id, vector), which stay where
    they are; a task passes on its k best of a query.
    """
    spark = nodes.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // BROADCAST_QUERIES))
    kinds = {f.name: f.dataType.simpleString() for f in [queries.schema["query_id"], nodes.schema["node_id"]]}
    schema = f"query_id {kinds['query_id']}, node_id {kinds['node_id']}, score double"
    out = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", F.col("vector").cast("array<double>").alias("vector")).toArrow()
        shipped = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            table = shipped.value
            if not table.num_rows:
                return
            q = np.array(table.column("vector").to_pylist())
            best, step = Best(len(q), k, "node_id"), max(1, PAIRS // len(q))
            for whole in batches:
                for first in range(0, whole.num_rows, step):
                    batch = whole.slice(first, step)
                    vectors = batch.column(1)
                    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
                    flat = vectors.flatten()
                    if flat.null_count:  # a vector that holds a null takes no part
                        row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
                        hole = np.zeros(len(size), bool)
                        hole[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
                        size = np.where(hole, -1, size)
                    rows = np.flatnonzero(size == q.shape[1])
                    if not len(rows):
                        continue
                    flat = batch.column(1).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                    score = flat.reshape(len(rows), -1) @ q.T
                    at, query = np.nonzero(score > 0) if positive else np.divmod(np.arange(score.size), len(q))
                    value = score[at, query]
                    best.add(batch.select(["node_id"]), rows[at], query, rounded(-value, 9), score=value)
            own = table.column("query_id").combine_chunks()
            for out in best.rows(["_q", "node_id", "score"]):
                yield pa.RecordBatch.from_arrays([own.take(out.column("_q")), out.column("node_id"), out.column("score")], names=["query_id", "node_id", "score"])

        one = nodes.select("node_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return ranked(out, k, F.round("score", 9).desc(), F.col("node_id")).select("query_id", "rank", "node_id", "score")


Provider = Callable[[list[str]], list[list[float]]]


@lru_cache(1 << 18)
def _hashed(token: str, dim: int) -> tuple[int, int]:
    d = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(d[:4], "big") % dim, 1 if d[4] % 2 == 0 else -1


def hash_provider(texts: list[str | None], dim: int = C.HASH_DIM) -> list[list[float]]:
    """Hash embeddings of a list of texts; also the provider to pass where one is asked for."""
    out = []
    for text in texts:
        low = re.sub(r"\s+", " ", text or "").strip().lower()
        tokens = re.findall(C.EMBEDDING_TOKEN, low)
        if not low.isascii():
            tokens = [x for t in tokens for x in ([t] if len(t) < 3 or t.isascii() else [t, *(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))])]
        pairs = [_hashed(t, dim) for t in tokens[:1000]]
        v = np.bincount([p[0] for p in pairs], [p[1] for p in pairs], dim) if pairs else np.zeros(dim)
        norm = float(np.sqrt((v * v).sum()))
        out.append(np.round(v / norm, 8).tolist() if norm else v.tolist())
    return out


def build_index(rows: DataFrame, existing: DataFrame | None, provider: Provider | None = None, name: str = "hash", model: str = "hash-ngram-v1", batch: int = 16) -> DataFrame:
    """Embed what the index lacks: rows (id, text) -> (id, provider, model,
    content_hash, dim, vector) of all rows.

    Rows whose text has the hash they have in ``existing`` are kept as they
    are; the others go to ``provider`` in batches, or become hash embeddings.
    """
    hashed = rows.select("id", T.content_hash(T.text_of("text")).alias("content_hash"), "text")
    same = None
    if existing is not None:
        mine = existing.filter((F.col("provider") == name) & (F.col("model") == model))
        same = mine.join(hashed.select("id", "content_hash"), ["id", "content_hash"], "left_semi")
        hashed = hashed.join(mine.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
    if provider is None:
        made = hash_embeddings(hashed, "id", T.text_of("text")).join(hashed.select("id", "content_hash"), "id")
    else:
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, vectors = [t or "" for t in b.column(2).to_pylist()], []
                for at in range(0, len(texts), batch):
                    vectors += provider(texts[at : at + batch])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "content_hash", "vector"])

        made = hashed.mapInArrow(run, f"id {kind}, content_hash string, vector array<double>")
    fresh = made.select("id", F.lit(name).alias("provider"), F.lit(model).alias("model"), "content_hash", F.size("vector").alias("dim"), "vector")
    return fresh if same is None else same.select(fresh.columns).unionByName(fresh)


def index_status(rows: DataFrame, index: DataFrame, name: str = "hash", model: str = "hash-ngram-v1") -> DataFrame:
    """One row: rows, embedded rows, largest dimension, coverage, needs_rebuild.

    A row counts as embedded if the index has it with its present text."""
    hashed = rows.select("id", T.content_hash(T.text_of("text")).alias("content_hash"))
    mine = index.filter((F.col("provider") == name) & (F.col("model") == model)).select("id", "content_hash", "dim")
    both = hashed.join(mine, ["id", "content_hash"], "left")
    n, done = F.count("*"), F.count("dim")
    return both.agg(n.alias("n_rows"), done.alias("n_embedded"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim"), F.round(done / F.greatest(n, F.lit(1)), 4).alias("coverage"), (done < n).alias("needs_rebuild"))
