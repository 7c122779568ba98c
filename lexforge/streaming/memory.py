"""Memory writes: one item for each scope, type and subject, folded in order.

A write merges with the item that is there: text that the item has already is
left out, text that holds the item takes its place, other text is added; importance
and confidence keep their maximum. A forced write takes the item's place. An
item expires at its ``ttl``: a later write begins anew. A write older than the
item is late and changes nothing.

The same fold runs over a table, a streaming pass over rows sorted by key and
order that holds one item at a time, and over a stream with keyed state, where
a timer drops items whose time has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["scope", "type", "subject_key"]
#: Times are milliseconds; a null ttl never expires.
WRITE = "seq long, at long, content string, importance double, confidence double, ttl long, refs string, force boolean"
LOG = "scope string, type string, subject_key string, seq long, at long, action string, content string, importance double, confidence double, ttl long, refs string"
FIELDS = [x.split()[0] for x in WRITE.split(", ")]


def merged_text(old: str, new: str) -> str:
    old, new = " ".join(old.split()), " ".join(new.split())
    if not old or old in new:
        return new or old
    return old if not new or new in old else f"{old}\n{new}"


def step(item: tuple | None, write: dict) -> tuple[str, tuple | None]:
    """(action, item) after a write; an item is (at, content, importance,
    confidence, ttl, refs)."""
    content, refs = write["content"] or "", write["refs"] or ""
    weight, sure = write["importance"], write["confidence"]
    weight, sure = 0.5 if weight is None or weight != weight else weight, 1.0 if sure is None or sure != sure else sure
    ttl = None if write["ttl"] is None or write["ttl"] != write["ttl"] else int(write["ttl"])
    at = int(write["at"])
    if item is not None and at < item[0]:
        return "late", item
    if item is not None and item[4] is not None and at >= item[4]:
        item = None  # its time had come
    if item is None or write["force"]:
        return "accepted", (at, content, weight, sure, ttl, refs)
    return "merged", (at, merged_text(item[1], content), max(item[2], weight), max(item[3], sure), ttl, refs or item[5])


def _log(key: tuple, write: dict, action: str, item: tuple) -> tuple:
    return (*key, int(write["seq"]), int(write["at"]), action, item[1], item[2], item[3], item[4], item[5])


def _shaped(writes: DataFrame) -> DataFrame:
    return writes.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in KEYS], *[F.col(x.split()[0]).cast(x.split()[1]) for x in WRITE.split(", ")])


#: Characters of items that go out in one batch: each row of the log holds the item after it.
CHARACTERS = 8 << 20


def _logged(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a log in batches that hold few characters, as items may be long."""
    types = [pa.string()] * 3 + [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in LOG.split(", ")]
    made = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[6])
        if size >= CHARACTERS or len(out) >= 10_000:
            yield made(out)
            out, size = [], 0
    if out:
        yield made(out)


def folded(writes: DataFrame) -> DataFrame:
    """The log of all writes of a table: what each did and the item after it.

    ``writes`` has KEYS and the columns of WRITE; ``seq`` is the order in which
    writes came. Rows of one key go through one task in order, which keeps no
    more than the item.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, item = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in KEYS)
                if own != key:
                    key, item = own, None
                action, item = step(item, row)
                yield _log(key, row, action, item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _logged(steps(batches))

    return _shaped(writes).repartition(*KEYS).sortWithinPartitions(*KEYS, "seq").mapInArrow(run, LOG)


def followed(writes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """The same log of a stream of writes, with a row ``expired`` when a timer
    drops an item; ``delay`` is how late the event time ``at`` may be."""
    timed = _shaped(writes).withColumn("event", F.timestamp_millis("at")).withWatermark("event", delay)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in LOG.split(", ")]
        if state.hasTimedOut:
            item = state.get
            state.remove()
            yield pd.DataFrame([(*key, -1, int(item[4]), "expired", item[1], item[2], item[3], int(item[4]), item[5])], columns=columns)
            return
        rows = pd.concat(list(frames)).sort_values("seq").astype(object)
        item = tuple(state.get) if state.exists else None
        out = []
        for row in rows[FIELDS].where(rows[FIELDS].notna(), None).to_dict("records"):
            action, item = step(item, row)
            out.append(_log(key, row, action, item))
        state.update(item)
        if item[4] is not None and item[4] > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(item[4])
        yield pd.DataFrame(out, columns=columns).astype({"ttl": "Int64"})

    held = "at long, content string, importance double, confidence double, ttl long, refs string"
    return timed.groupBy(*KEYS).applyInPandasWithState(run, LOG, held, "append", GroupStateTimeout.EventTimeTimeout)


def items(log: DataFrame, now: int | None = None) -> DataFrame:
    """The items after a log, those that have expired by ``now`` left out."""
    last = F.max_by(F.struct("at", "action", "content", "importance", "confidence", "ttl", "refs"), F.col("seq"))
    rows = log.filter("action NOT IN ('late', 'expired')").groupBy(*KEYS).agg(last.alias("m")).select(*KEYS, "m.*").drop("action")
    return rows if now is None else rows.filter(F.col("ttl").isNull() | (F.col("ttl") > F.lit(now)))


def duplicates(items_: DataFrame) -> DataFrame:
    """(content, n, subjects): items of different subjects that say the same,
    white space and case aside."""
    key = F.lower(F.trim(F.regexp_replace("content", r"\s+", " ")))
    return items_.withColumn("_k", key).filter("_k <> ''").groupBy("_k").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("subject_key")).alias("subjects")).filter("n > 1").select(F.col("_k").alias("content"), "n", "subjects")
