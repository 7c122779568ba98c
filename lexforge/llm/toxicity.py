"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents are unlabelled,
whatever a label says. With the class prior p, the risk of a classifier is
p R+(positives) + max(0, R-(unlabelled) - p R-(positives)); where the second
part falls below zero the step goes against it, which keeps a flexible model
from driving it negative. The loss is logistic, so the output is a probability.

Features are the presence of words (hashed), of which those that differ most
between positives and unlabelled text are kept; their number is the model's
capacity. Every row that may be learned from takes part in the counts and in
every step of the training: texts are hashed once, rows of equal features
become one with its number, and a step adds up the gradient where the rows lie.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.caches import Kept, enter
from lexforge.llm.shared import OWN, discard, held_out, written

BUCKETS = 1 << 18
#: Identifiers of positives at most (they are broadcast), chosen by a hash.
MAX_POSITIVE = 100_000
#: Features of the model, the least score (in deviations) of one, and steps of the training.
FEATURES, LEAST_Z, STEPS, RATE = 1024, 4.0, 60, 0.2
#: Strength of the weights' Gaussian prior, shared out among the positives: the fewer there are, the more it counts.
SHRINK = 0.1
THRESHOLD = 0.3
_OTHER = re.compile(r"[\W\d_]+")


def _bucket(piece: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in _OTHER.split(piece) if w)


_PIECES = Kept(_bucket, "toxicity")


def buckets(text: str | None) -> np.ndarray:
    """Hashed distinct words of a whole text: runs of letters, lower-cased."""
    known = _PIECES.new
    found: set[int] = set()
    for got in [known[p] for p in set((text or "").lower().split())]:
        found.update(got)
    return np.fromiter(found, np.int32, len(found))


@dataclass
class Model:
    """``place`` maps a bucket to a feature (-1: none); a score is the logistic
    of ``bias`` plus the weights of the features present."""

    place: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, found: np.ndarray) -> float:
        at = self.place[found]
        z = self.bias + float(self.weights[at[at >= 0]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def hashed(docs: DataFrame, text_col: str = "text", found_col: str = f"{OWN}found") -> DataFrame:
    """``docs`` with the hashed words of each whole text; a narrow map."""

    def run(texts: pa.Array) -> pa.Array:
        enter("toxicity")
        return pa.array([buckets(t.as_py()) for t in texts], pa.list_(pa.int32()))

    # only the texts go to Python and only the words come back
    return docs.withColumn(found_col, F.arrow_udf(run, "array<int>")(F.col(text_col).cast("string")))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))


def word_counts(marked: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Rows (found, positive) that hold each bucket, positive and all, and the
    numbers of both kinds of rows. A task adds up its own; at most one row a
    bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            values, row = _lists(batch.column(0))
            n[0, :-1] += np.bincount(values[positive[row]], minlength=BUCKETS)
            n[1, :-1] += np.bincount(values, minlength=BUCKETS)
            n[:, -1] += (int(positive.sum()), len(positive))
        at = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "p", "u"])

    got = marked.mapInArrow(run, "bucket int, p long, u long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    n = np.zeros((2, BUCKETS + 1), np.int64)
    n[:, got.column("bucket").to_numpy()] = (got.column("p").to_numpy(), got.column("u").to_numpy())
    return n[0, :-1], n[1, :-1], int(n[0, -1]), int(n[1, -1])


def chosen(df_p: np.ndarray, df_u: np.ndarray, n_p: int, n_u: int, features: int = FEATURES) -> np.ndarray:
    """The buckets whose shares among positives and all rows differ most."""
    p, u = df_p / n_p, df_u / n_u
    both = (df_p + df_u + 1) / (n_p + n_u + 2)
    z = (p - u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    z[(df_p + df_u) < 5] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:features]
    return best[np.abs(z[best]) >= LEAST_Z]


def gradient(rows: list[np.ndarray], positive: np.ndarray, count: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    """Sums over rows of equal features: positive loss and its gradient, and
    negative loss and its gradient over positives and over all rows.

    Laid out as three parts of [loss, slope by the bias, slopes by the weights].
    """
    lengths = np.fromiter((len(r) for r in rows), np.int64, len(rows))
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    own = np.repeat(np.arange(len(rows)), lengths)
    g = np.clip(np.bincount(own, weights=w[flat], minlength=len(rows)) + b, -60, 60)
    s = 1 / (1 + np.exp(-g))
    parts = []
    for loss, slope, weight in ((np.logaddexp(0, -g), s - 1, count * positive), (np.logaddexp(0, g), s, count * positive), (np.logaddexp(0, g), s, count)):
        d = slope * weight
        parts.append(np.concatenate([[(loss * weight).sum(), d.sum()], np.bincount(flat, weights=d[own], minlength=len(w))]))
    return np.concatenate(parts)


def descend(sums, n_features: int, n_p: float, n_u: float, prior: float, steps: int = STEPS, rate: float = RATE, beta: float = 0.0, gamma: float = 1.0, decay: float | None = None) -> tuple[np.ndarray, float, list[float]]:
    """Weights and bias of the step of least risk whose second part is not
    negative, and the risk of each step. ``sums(w, b)`` gives what
    :func:`gradient` does over all rows. Steps shrink to nothing by the last;
    ``decay`` is ``SHRINK`` by positives if not given."""
    decay = SHRINK / n_p if decay is None else decay
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v, risks = np.zeros(n_features + 1), np.zeros(n_features + 1), []
    for t in range(1, steps + 1):
        plus, minus_p, minus_u = np.split(sums(w, b), 3)
        plus, minus = prior * plus / n_p, minus_u / n_u - prior * minus_p / n_p
        risks.append(float(plus[0] + max(0.0, minus[0])))
        if t == 1 or minus[0] >= -beta and risks[-1] <= least:
            best, least = (w, b), risks[-1]
        slope = -gamma * minus[1:] if minus[0] < -beta else plus[1:] + minus[1:]
        slope = np.append(slope[1:] + decay * w, slope[0])
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = rate * (1 - (t - 1) / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return *best, risks


def _design(marked: DataFrame, place: np.ndarray) -> DataFrame:
    """(key, positive, n): rows of equal features are one; ``key`` is their
    feature numbers. Counts are summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for x in batch.column(0):
                at = place[np.asarray(x.values, np.int64)] if x.is_valid else np.zeros(0, np.int32)
                keys.append(np.sort(at[at >= 0]).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(1)], names=["key", "positive"])

    return marked.mapInArrow(run, "key binary, positive boolean").groupBy("key", "positive").agg(F.count("*").alias("n"))


def train(docs: DataFrame, labels: DataFrame, features: DataFrame | None = None) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Only rows that are not held out are learned from. Positives are the rows
    whose identifier is labelled 1 (at most ``MAX_POSITIVE`` identifiers, chosen
    by a hash), the prior is the share of 1 among the labelled rows, and every
    row is unlabelled text. ``features`` may bring what :func:`hashed` gives for
    ``docs``. Without positives all scores are 0.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    nothing = Model(np.full(BUCKETS, -1, np.int32), np.zeros(0, np.float32), -60.0, 0.0)
    if not toxic:
        return nothing
    mine = features is None
    features = written(hashed(docs.select("doc_id", "text")).drop("text"), "words") if mine else features
    positives = known.filter("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(MAX_POSITIVE)
    rows = features.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col(f"{OWN}found").alias("found"))
    marked = rows.join(F.broadcast(positives.withColumn("positive", F.lit(True))), "doc_id", "left").select("found", F.coalesce("positive", F.lit(False)).alias("positive"))
    df_p, df_u, n_p, n_u = word_counts(marked)
    if not n_p:
        return nothing
    best = chosen(df_p, df_u, n_p, n_u)
    place = np.full(BUCKETS, -1, np.int32)
    place[best] = np.arange(len(best))
    design = written(_design(marked, place), "design")

    def sums(w: np.ndarray, b: float) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(3 * (len(w) + 2))
            for batch in batches:
                keys = [np.frombuffer(k, "<i4") for k in batch.column(0).to_pylist()]
                total += gradient(keys, batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(2).to_numpy().astype(float), w, b)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        # one row of a few kilobytes for each task
        return np.sum([np.frombuffer(r[0]) for r in design.mapInArrow(run, "part binary").collect()], axis=0)

    prior = float(np.clip(toxic / n, 1e-4, 0.9))
    w, b, _ = descend(sums, len(best), n_p, n_u, prior)
    discard(design)
    if mine:
        discard(features)
    return Model(place, w.astype(np.float32), b, prior)


def _scores(model: Model, column) -> np.ndarray:
    return np.array([model.score(np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64)) for x in column], np.float64)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", features: DataFrame | None = None) -> DataFrame:
    """(id_col, score, predicted) of each whole text; a narrow map.

    ``features`` may bring what :func:`hashed` gives for ``docs``.

    Defined results: null and empty texts get the score of a text without
    words; null ids and repeated rows stay; an empty table gives an empty
    result; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    found = f"{OWN}found"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        for batch in batches:
            scores = _scores(shipped.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    rows = features if features is not None else hashed(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), "text")
    return rows.select(F.col(id_col).alias("id"), found).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def learned_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``docs`` and ``labels`` and score all of ``docs``, hashing each
    text once: (doc_id, score, predicted)."""
    features = written(hashed(docs.select("doc_id", "text")).drop("text"), "words")
    return scored(docs, train(docs, labels, features), features=features)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that a model trained on them rejects (score >=
    0.3); all columns and all other rows stay.

    Each text is hashed once: rows are written with their words, and dropped
    when that is read again. Nulls, empty texts and repeated rows are as in
    :func:`scored`; an empty table gives an empty result.
    """
    features = written(hashed(docs), "words")
    model = train(docs, labels, features)
    shipped, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def kept(found: pa.Array) -> pa.Array:
        enter("toxicity")
        return pa.array(_scores(shipped.value, found) < THRESHOLD, pa.bool_())

    return features.filter(F.arrow_udf(kept, "boolean")(f"{OWN}found")).select(names)
