"""Language identification as a mixture of languages.

Each language has a model of hashed character trigrams. Expectation
maximisation estimates which proportions of a document's trigrams come from
which language; the set of languages is that of the best penalised likelihood
(a Bayesian criterion: half the log of the trigram count for each language).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.caches import enter
from lexforge.llm.shared import held_out

BUCKETS = 1 << 15
#: Characters looked at a time.
STRIP = 1 << 18
#: Each character is in three trigrams, which are therefore not independent.
OVERLAP = 3.0
NONE = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not _LETTERS:
        points = np.arange(0x110000, dtype=np.uint32)
        is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _LETTERS.append(np.where(is_letter, points, np.uint32(32)))
    return _LETTERS[0]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the lower-cased letters of a whole text, with counts.

    What is no letter parts words; a trigram has a letter in its middle.
    """
    total = np.zeros(BUCKETS, np.int64)
    text = f" {(text or '').lower()} "
    for at in range(0, max(1, len(text) - 2), STRIP):
        points = np.frombuffer(text[at : at + STRIP + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _letters()[points]
        a, b, d = c[:-2], c[1:-1], c[2:]
        h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (d * np.uint32(0xC2B2AE35))
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
        total += np.bincount(h[b != 32], minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def mixture(p: np.ndarray, counts: np.ndarray, rounds: int = 60, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` (trigram by language) and the log-likelihood."""
    n = counts.sum()
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds if p.shape[1] > 1 else 0):
        after = share * (p.T @ (counts / (p @ share))) / n
        done = np.abs(after - share).max() < tolerance
        share = after
        if done:
            break
    return share, float(counts @ np.log(p @ share))


@dataclass
class Model:
    """``p``: probability of each bucket in each of the languages ``names``."""

    names: list[str]
    p: np.ndarray

    def mix(self, text: str | None) -> list[tuple[str, float]]:
        """The languages chosen, with proportions, largest first (ties by name).

        No letter, or no language learned: no language.
        """
        found, counts = trigrams(text)
        if not len(found) or not self.names:
            return []
        p, n = self.p[found], counts.sum()
        cost = 0.5 * np.log(n + 1)
        singles = counts @ np.log(p)
        best = int(np.argmax(singles))
        chosen, shares, value = [best], np.ones(1), singles[best] / OVERLAP - cost
        if len(self.names) > 1:
            full, all_of = mixture(p, counts)
            # no set of two or more can beat the single one by more than all of them do
            if all_of / OVERLAP - 2 * cost > value:
                order = np.argsort(-full, kind="stable")
                for size in range(2, len(order) + 1):
                    if all_of / OVERLAP - size * cost <= value:
                        break
                    some = order[:size]
                    share, got = (full[some], all_of) if size == len(order) else mixture(p[:, some], counts)
                    if got / OVERLAP - size * cost > value:
                        chosen, shares, value = list(some), share, got / OVERLAP - size * cost
        return sorted(((self.names[k], float(s)) for k, s in zip(chosen, shares)), key=lambda x: (-x[1], x[0]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Trigram counts of each language over all rows with a non-null language
    that are not held out. A task adds up its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                found, counts = trigrams(text.as_py())
                if len(found):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))[found] += counts
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    got = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(got["lang"].unique())
    p = np.full((BUCKETS, len(names)), 0.5)  # smoothing
    for k, name in enumerate(names):
        own = got[got["lang"] == name]
        p[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return Model(names, p / p.sum(axis=0) if names else p)


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score, languages) of each whole text.

    ``lang_pred`` is the language of the largest proportion, ``score`` that
    proportion, ``languages`` the set chosen ("en:0.90 fr:0.10").

    Defined results: ``und`` with score 0 where the text is null or has no
    letter, or nothing was learned; ties go to the name that sorts first; null
    ids count as held out; repeated rows stay; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("langid")
        for batch in batches:
            mixes = [shipped.value.mix(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([m[0][0] if m else NONE for m in mixes], pa.string()),
                    pa.array([min(1.0, m[0][1]) if m else 0.0 for m in mixes], pa.float64()),
                    pa.array([" ".join(f"{k}:{s:.2f}" for k, s in m) for m in mixes], pa.string()),
                ],
                names=["id", "held_out", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, languages string").withColumnRenamed("id", id_col)
