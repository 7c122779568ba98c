"""Quality by importance resampling.

Two generative models over hashed word and word-pair counts are fitted, one to
target text (documents labelled good) and one to all raw text. A document's log
importance weight is the log ratio of its likelihoods; documents are sampled
without replacement in proportion to the weights by Gumbel top-k: the k rows
with the largest log weight plus Gumbel noise stay. The noise comes from a
hash of the identifier, so a run can be repeated.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.caches import Kept, enter
from lexforge.llm.shared import OWN, discard, written

BUCKETS = 1 << 14
#: Labelled rows that the target model is fitted on at most, chosen by a hash of the identifier.
MAX_TARGET = 20_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
STRIP = 1 << 16


def _tokens(piece: str) -> bytes:
    return b"".join(zlib.crc32(t.encode("utf-8", "surrogatepass")).to_bytes(4, "little") for t in _TOKEN.findall(piece))


_PIECES = Kept(_tokens, "quality")


def grams(text: str | None) -> np.ndarray:
    """Buckets of the words and word pairs of a whole text, repeats included."""
    known = _PIECES.new
    h = np.frombuffer(b"".join([known[p] for p in (text or "").lower().split()]), "<u4").astype(np.uint64)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h % np.uint64(BUCKETS), (pairs >> np.uint64(40)) % np.uint64(BUCKETS)]).astype(np.int64)


@dataclass
class Model:
    """``ratio``: log of target over raw probability of each bucket."""

    ratio: np.ndarray
    seed: int

    def weight(self, text: str | None) -> float:
        return float(self.ratio[grams(text)].sum())

    def noise(self, doc_id) -> float:
        u = (xxhash.xxh64_intdigest(str(doc_id), self.seed) + 0.5) / 2.0**64
        return float(-np.log(-np.log(min(u, 1 - 2.0**-53))))


def order_key(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    bits = values.astype(np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def fit(docs: DataFrame, labels: DataFrame, max_target: int = MAX_TARGET, seed: int = 11) -> Model:
    """Bucket counts of all of ``docs`` (doc_id, text), and of the documents
    that ``labels`` (doc_id, quality) marks 1, in one pass.

    The raw counts cover every row; a task adds up its own and returns at most
    one row a bucket. The target set is bounded by ``max_target`` identifiers,
    which may therefore be broadcast.
    """
    target = labels.filter("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(max_target)
    marked = docs.join(F.broadcast(target.withColumn(f"{OWN}good", F.lit(True))), "doc_id", "left").select(F.col("text").cast("string").alias("text"), F.coalesce(f"{OWN}good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.bincount(grams(text.as_py()), minlength=BUCKETS)
                raw += found
                if is_good:
                    good += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])

    got = marked.mapInArrow(run, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.ones(BUCKETS), np.ones(BUCKETS)  # add-one smoothing
    at = got.column("bucket").to_numpy()
    raw[at] += got.column("raw").to_numpy()
    good[at] += got.column("good").to_numpy()
    if good.sum() <= BUCKETS:  # nothing to aim at: all weights are equal
        return Model(np.zeros(BUCKETS), seed)
    return Model(np.log(good / good.sum()) - np.log(raw / raw.sum()), seed)


def good_share(docs: DataFrame, labels: DataFrame) -> float:
    """Upper end (two standard errors) of the share of good documents among the
    labelled ones of ``docs``; 1 if there are none."""
    joined = docs.select("doc_id").join(labels.filter("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    n, good = joined.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    if not n:
        return 1.0
    share = good / n
    return min(1.0, share + 2 * (max(share * (1 - share), 0.25 / n) / n) ** 0.5)


def weighed(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, log_weight, gumbel_key, order_key) of each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        m = shipped.value
        for batch in batches:
            w = np.array([m.weight(t.as_py()) for t in batch.column(1)], np.float64)
            key = w + np.array([m.noise(i) for i in batch.column(0).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w), pa.array(key), pa.array(order_key(key))], names=["id", "log_weight", "gumbel_key", "order_key"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, log_weight double, gumbel_key double, order_key long").withColumnRenamed("id", id_col)


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column, exactly; None if there are fewer.

    Four counts over 16 bits each narrow it down: no sort, and at most 65,536
    counts come to the driver at a time.
    """
    low, here = -(1 << 63), df.select(F.col(column).alias("v"))
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(F.col("v"), shift) if shift == 48 else F.shiftright(F.col("v"), shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        counts = sorted(((r[0], r[1]) for r in here.groupBy(digit.alias("d")).agg(F.count("*")).collect()), reverse=True)
        for d, n in counts:
            if n >= k:
                break
            k -= n
        else:
            return None
        low = (d << 48) if shift == 48 else low + (d << shift)
        here = here.filter(F.col("v").between(low, low + (1 << shift) - 1))
    return low


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: (id_col, log_weight, gumbel_key, kept).

    ``kept`` marks the k rows of largest key, k = ``share`` of all rows, by
    default the upper end of the share that the labels call good. Rows that tie
    with the k-th are all kept.

    Defined results: null and empty texts weigh 0; null ids hash as one id;
    repeated rows get equal keys; without any label for a good document all
    weights are 0, and all rows are kept where no row has a label at all; an
    empty table gives an empty result; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(own, labels)
    keys = written(weighed(docs, model, id_col, text_col), "weights")
    floor = threshold(own, labels, keys, share)
    return keys.select(id_col, "log_weight", "gumbel_key", (F.col("order_key") >= F.lit(floor)).alias("kept"))


def threshold(docs: DataFrame, labels: DataFrame, keys: DataFrame, share: float | None = None) -> int:
    share = good_share(docs, labels) if share is None else share
    rows = keys.count()
    k = min(rows, int(np.ceil(rows * share)))
    if rows and k <= 0:
        return (1 << 63) - 1
    found = kth_largest(keys, "order_key", k) if rows else None
    return -(1 << 63) if found is None else found


def sample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`resampled` keeps, with all columns.

    Rows are written with their keys, from which the k-th is found and rows are
    dropped. Null and empty texts, null ids, repeated rows, ties, missing labels
    and empty tables are as in :func:`resampled`.
    """
    own = docs.select("doc_id", "text")
    model = fit(own, labels)
    shipped, names, key = docs.sparkSession.sparkContext.broadcast(model), docs.columns, f"{OWN}key"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        m = shipped.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(f"{OWN}text" if cast else "text"))
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            keys = np.array([m.weight(t.as_py()) + m.noise(i) for t, i in zip(texts, ids)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(names))] + [pa.array(order_key(keys))], names=[*names, key])

    cast = docs.schema["text"].dataType.simpleString() != "string"  # a text goes to the workers once
    keyed = (docs.withColumn(f"{OWN}text", F.col("text").cast("string")) if cast else docs).mapInArrow(run, docs.withColumn(key, F.lit(0).cast("long")).schema)
    rows = written(keyed, "keyed")
    floor = threshold(own, labels, rows.select(F.col(key).alias("order_key")), share)
    return rows.filter(F.col(key) >= F.lit(floor)).select(names)
