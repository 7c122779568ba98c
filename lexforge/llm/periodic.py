"""Runs of repeated words in a text, by probing harmonic grids.

A run is a stretch of consecutive words with smallest period q and at least
``max(LEAST, TIMES * q)`` words that no neighbouring word extends. For each
period p the words at jp and (j + 1)p are compared, for all j: a run of period
p holds ``TIMES`` consecutive points of that grid, so it shows as ``TIMES - 1``
equal neighbours in a row. All grids of n words have n(1 + 1/2 + 1/3 + ...)
points. What survives is extended in both directions by comparing arrays in
chunks that double, as far as words stay equal at distance p. Grid pairs that
lie within one run already found, whose period divides p, are skipped: they are
equal for that reason, and a run of smallest period p shares fewer than p words
with such a run, so it keeps all of its own pairs.

Texts of a batch are probed together: their words are numbered and laid end to
end, longest text first, with a number of its own between two texts, so no run
crosses a border and period p meets only the texts that are long enough for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.caches import enter

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Bytes of text that are probed together.
BATCH_BYTES = 4 << 20
#: Words compared at first when a survivor is extended.
CHUNK = 32


def _equal_ahead(w: np.ndarray, at: int, p: int, end: int) -> int:
    """The first i >= at with i + p == end or w[i] != w[i + p]."""
    step = CHUNK
    while at + p < end:
        to = min(at + step, end - p)
        apart = np.flatnonzero(w[at:to] != w[at + p : to + p])
        if len(apart):
            return at + int(apart[0])
        at, step = to, step * 2
    return at


def _equal_behind(w: np.ndarray, at: int, p: int) -> int:
    """The smallest s with w[i] == w[i + p] for all i in s..at-1."""
    step = CHUNK
    while at:
        low = max(0, at - step)
        apart = np.flatnonzero(w[low:at] != w[low + p : at + p])
        if len(apart):
            return low + int(apart[-1]) + 1
        at, step = low, step * 2
    return at


def runs_of(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in ``words``, texts laid end to end.

    ``lengths`` are the texts' lengths in descending order, each with the one
    number after it that occurs nowhere else.
    """
    found: dict[tuple[int, int], int] = {}
    upcoming: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ends = np.cumsum(lengths)
    longest = int(lengths[0]) - 1 if len(lengths) else 0
    for p in range(1, longest // TIMES + 1):
        texts = int(np.searchsorted(-lengths, -(max(LEAST, TIMES * p) + 1), side="right"))
        if not texts:
            break
        end = int(ends[texts - 1])
        points = words[:end:p]
        same = points[:-1] == points[1:]
        for start, stop, q in upcoming.pop(p, ()):
            same[-(-start // p) : (stop - 1) // p] = False  # both points within that run
            if p + q < stop - start:
                upcoming[p + q].append((start, stop, q))
        in_a_row = same[: len(same) - TIMES + 2].copy()
        for k in range(1, TIMES - 1):
            in_a_row &= same[k : len(same) - TIMES + 2 + k]
        done = 0
        for j in np.flatnonzero(in_a_row).tolist():
            if j * p < done:
                continue  # within the stretch just compared
            right = _equal_ahead(words, j * p, p, end)
            left = _equal_behind(words, j * p, p)
            done = max(done, right)
            stop = right + p
            if stop - left >= max(LEAST, TIMES * p) and (left, stop) not in found:
                found[left, stop] = p
                if 2 * p < stop - left:
                    upcoming[2 * p].append((left, stop, p))
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that the contract asks for."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(numbers, lengths, order) of texts laid end to end for :func:`runs_of`."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    known: dict[bytes, int] = {}
    number = known.setdefault
    out = np.empty(sum(map(len, texts)) + len(texts), np.int32)
    at = 0
    for k, i in enumerate(order):
        n = len(texts[i])
        out[at : at + n] = [number(w, len(known)) for w in texts[i]]
        out[at + n] = -1 - k
        at += n + 1
    return out, np.array([len(texts[i]) + 1 for i in order], np.int64), order


def found_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each text its runs as (start, length, period), by start, then period."""
    words, lengths, order = numbered(texts)
    starts = np.cumsum(lengths) - lengths
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, e, q in runs_of(words, lengths):
        k = int(np.searchsorted(starts, s, side="right")) - 1
        out[order[k]].append((s - int(starts[k]), e - s, q))
    return [sorted(rows, key=lambda r: (r[0], r[2])) for rows in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: each run keeps its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    dropped = np.cumsum(change[:-1]) > 0
    return [words[k] for k in np.flatnonzero(~dropped)]


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0), batch.column(1)):
        text = t.as_py()
        ids.append(i.as_py())
        texts.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= BATCH_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def with_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, plant: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its runs, and the text without them.

    Columns: the identifier, ``runs`` (array of start, length, period, by start,
    then period), ``collapsed`` (null unless ``keep_text``), ``runs_sha256`` and
    ``collapsed_sha256``. Words are runs of bytes other than space and 9 to 13.
    ``plant`` repeats words by the identifier first, as the query asks.

    Nothing is shuffled. A batch of texts is held at a time; one text is held
    whole, whatever its length. Null and empty texts have no runs and collapse
    to nothing; a null identifier stays null and nothing is planted in its
    text; repeated rows each give a row; an empty table gives an empty result;
    other columns are ignored whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("periodic")
        for whole in batches:
            for ids, texts in _batches(whole):
                cut = [t.split() for t in texts]
                if plant:
                    cut = [planted(w, i) for i, w in zip(ids, cut)]
                runs = found_runs(cut)
                left = [b" ".join(collapsed(w, r)) for w, r in zip(cut, runs)]
                lists = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                logs = ["".join(f"{s},{n},{q}\n" for s, n, q in r).encode() for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, batch_type),
                        pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        pa.array([t.decode("utf-8", "replace") if keep_text else None for t in left], pa.string()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in logs]),
                        pa.array([hashlib.sha256(t).hexdigest() for t in left]),
                    ],
                    names=["id", "runs", "collapsed", "runs_sha256", "collapsed_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    batch_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    ids = F.col(id_col).cast("long" if batch_type == pa.int64() else "string").alias("id")
    source = docs.select(ids, F.col(text_col).cast("string").alias("text"))
    schema = f"id {'long' if batch_type == pa.int64() else 'string'}, runs array<struct<start: long, length: long, period: long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"
    return source.mapInArrow(run, schema).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def longest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """The longest run of each row (ties: smallest start, then period), with the
    digests of all runs and of the collapsed text; four nulls without a run."""
    # the greatest by length, then by the negated start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = with_runs(docs, id_col, text_col, plant=plant).withColumn("__lf_best", best)
    start, length, period = -F.col("__lf_best.start"), F.col("__lf_best.length"), -F.col("__lf_best.period")
    return out.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * __lf_best.length) div (-__lf_best.period)").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
