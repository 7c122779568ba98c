"""The trie of conversations' prefixes, by names of blocks that double.

Each turn gets a dense name (a number from 0) for its role and text. A block of
2^k turns that begins at a multiple of 2^k is named by the names of its two
halves, so equal blocks have equal names after a logarithm of the longest
conversation's joins. A prefix of d turns is the blocks of d's binary digits,
longest first; from the highest digit to the lowest, the prefixes whose lowest
set digit is k are named by the prefix without that digit and the block of that
digit. Names are unique over all prefixes, so a name is a node of the trie. All
rounds together hold twice the turns.

Sums over subtrees need no walk. Each node has one representative, its smallest
member, whose path holds the node. What a node contributes is therefore given
to one row (conversation, depth) below it, and a subtree's sum is the sum, over
its members, of what their paths hold from its depth on: a running total along
each conversation, then one grouping.

No task gets a whole conversation, or all members of a node: turns are numbered
by a sort over ranges, running totals are carried over the ranges' borders, and
groupings are combined before they are shuffled. Digests alone need the members
of a node that end there in one place, in order: they are joined into blocks of
text by ranges first, and the blocks of a node go through one hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.shared import OWN, discard, written

#: Rows of a partition that monotonically_increasing_id tells apart, as a power of two.
ROW_BITS = 33
#: Bytes of identifiers that are joined before they are hashed.
BLOB = 1 << 20


def _starts(made: DataFrame, part: Column, size: Column) -> DataFrame:
    """(part, start): what all partitions before it hold. One row a partition."""
    counts = sorted(made.groupBy(part.alias("part")).agg(size.alias("n")).collect())
    starts, at = [], 0
    for part_no, n in counts:
        starts.append((part_no, at))
        at += n
    return F.broadcast(made.sparkSession.createDataFrame(starts, "part long, start long"))


def numbered(rows: DataFrame, name: str, base: int = 0) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a dense number from ``base`` on, in the order that their
    partitions have them; and the written table to discard once it has been read."""
    made = written(rows.withColumn(f"{OWN}at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned(f"{OWN}at", ROW_BITS)
    starts = _starts(made, part, F.count("*"))
    number = F.lit(base) + F.col("start") + F.col(f"{OWN}at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return made.join(starts, part == F.col("part")).select(*rows.columns, number.alias(name)), made


def named(rows: DataFrame, keys: list[str], name: str, base: int = 0) -> tuple[DataFrame, int]:
    """``rows`` with a dense name for each distinct value of ``keys``, in place
    of these, written; and the number of names."""
    names, made = numbered(rows.select(*keys).distinct(), name, base)
    out = written(rows.join(names, keys).drop(*keys), "named")
    n = made.count()
    discard(made)
    return out, n


def placed(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos, key, bytes), written: turns numbered from 0 in each
    conversation. ``key`` is a SHA-256 of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", "turn", "key"]
    ordered, made = numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order), "at")
    first = ordered.groupBy("conv_id").agg(F.min("at").alias("first"))
    out = written(ordered.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "key", "bytes"), "placed")
    discard(made)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations that the query asks for, from :func:`placed` turns.

    The first h turns of conversation c - c % 5, then c's own after its first h;
    h is the CRC32 of the decimal c, modulo 9. Returns turns (conv_id, depth
    from 1, key, bytes) and conversations (conv_id, turns), both written.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.withColumn("h", h).withColumn("base", base).join(of_base, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "convs")
    head = turns.filter("pos < 8").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").filter("pos < h")
    tail = turns.join(convs.select("conv_id", "h", "head"), "conv_id").filter("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("head"))
    columns = ["conv_id", (F.col("pos") + 1).alias("depth"), "key", "bytes"]
    return written(head.select(*columns).unionByName(tail.select(*columns)), "rebuilt"), convs.select("conv_id", "turns")


def prefixes(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, node): a name from 1 for the first ``depth`` turns of each
    conversation, for ``turns`` (conv_id, depth from 1, key)."""
    spark = turns.sparkSession
    level, _ = named(turns.select("conv_id", (F.col("depth") - 1).alias("block"), "key"), ["key"], "name")
    levels = [level]
    while 2 ** len(levels) <= longest:
        half = F.col("block") % 2
        halves = level.groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        level, _ = named(halves.filter("right IS NOT NULL"), ["left", "right"], "name")
        levels.append(level)
    found, names = [], 1
    for k in reversed(range(len(levels))):
        # multiples of 2^(k+1) that are named already; zero is the root, name 0
        before = spark.createDataFrame([], "conv_id long, block long, prefix long")
        for rows in found:
            before = before.unionByName(rows.select("conv_id", (F.shiftright("depth", k + 1)).alias("block"), F.col("node").alias("prefix")))
        odd = levels[k].filter("block % 2 = 0").select("conv_id", F.shiftright("block", 1).alias("block"), "name")
        keyed = odd.join(before, ["conv_id", "block"], "left").withColumn("prefix", F.coalesce("prefix", F.lit(0)))
        keyed = keyed.select("conv_id", ((2 * F.col("block") + 1) * 2**k).alias("depth"), F.col("block").alias("place"), "prefix", "name")
        rows, n = named(keyed, ["place", "prefix", "name"], "node", names)
        found.append(rows.select("conv_id", "depth", "node"))
        names += n
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    out = written(out, "prefixes")
    for rows in levels:
        discard(rows)
    return out


def from_here_on(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, rest): ``rest`` is the sum of ``w`` over the rows of
    the conversation from this depth on, for rows (conv_id, depth, node, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            w = batch.column(3).to_numpy(zero_copy_only=False)
            sums = np.cumsum(w, dtype=np.int64) + total
            if len(sums):
                total = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=["conv_id", "depth", "node", "w", "so_far"])

    order = ["conv_id", "depth"]
    sums = rows.select("conv_id", "depth", "node", "w").repartitionByRange(*order).sortWithinPartitions(*order)
    sums = sums.mapInArrow(run, "conv_id long, depth long, node long, w long, so_far long")
    made = written(sums.withColumn("part", F.spark_partition_id().cast("long")), "sums")
    starts = _starts(made, F.col("part"), F.sum("w"))
    totals = made.join(starts, "part").withColumn("so_far", F.col("so_far") + F.col("start"))
    ends = totals.groupBy("conv_id").agg(F.max("so_far").alias("all"))
    return totals.join(ends, "conv_id").select("conv_id", "depth", "node", (F.col("all") - F.col("so_far") + F.col("w")).alias("rest"))


def digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ascending identifiers, joined by
    commas, of each node's rows in ``ends`` (node, conv_id)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, 0, [], 0

        def flush(out):
            if ids:
                out.append((node, first, ",".join(ids)))

        for batch in batches:
            out: list[tuple] = []
            for n, c in zip(*(batch.column(k).to_pylist() for k in range(2))):
                if n != node or size > BLOB:
                    flush(out)
                    node, first, ids, size = n, c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _rows(out, [pa.int64(), pa.int64(), pa.string()], ["node", "first", "ids"])
        out = []
        flush(out)
        yield _rows(out, [pa.int64(), pa.int64(), pa.string()], ["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            out = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if n != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield _rows(out, [pa.int64(), pa.string()], ["node", "ends_sha256"])
        if node is not None:
            yield _rows([(node, state.hexdigest())], [pa.int64(), pa.string()], ["node", "ends_sha256"])

    ranged = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    blobs = ranged.mapInArrow(joined, "node long, first long, ids string")
    return blobs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node long, ends_sha256 string")


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, depth from 1, key,
    bytes) of ``convs`` (conv_id, turns), which may have no turn.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256, as the contract of the
    query defines them.
    """
    longest = convs.agg(F.max("turns")).first()[0] or 0
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"))
    paths = root.unionByName(prefixes(turns, longest)) if longest else root
    groups = paths.groupBy("node").agg(F.min("conv_id").alias("first"), F.count("*").alias("n_convs"))
    whole = paths.join(groups, "node").join(turns.select("conv_id", "depth", "bytes"), ["conv_id", "depth"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    whole = written(whole.select("conv_id", "depth", "node", "first", "n_convs", F.when(F.col("conv_id") == F.col("first"), F.lit(0)).otherwise(F.col("bytes")).cast("long").alias("w")), "paths")

    above = whole.select(F.col("conv_id").alias("first"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("first").alias("parent_conv_id"))
    nodes = written(whole.filter("conv_id = first").select("node", "first", "depth", "n_convs").join(above, ["first", "depth"], "left"), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # a childless node is where its smallest member ends
    leaves = nodes.filter("n_children = 0").select(F.col("first").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))
    rests = from_here_on(whole).join(leaves, "conv_id", "left")
    sums = rests.groupBy("node").agg(F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum("rest").alias("saved_tokens"))
    ends = digests(whole.select("conv_id", "depth", "node").join(convs.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"]))
    out = nodes.join(sums, "node").join(ends, "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """The trie of all conversations; ``rebuild`` joins them first, as the query asks.

    Turns are ordered by ``turn``, null first; rows of equal turn by the SHA-256
    of role and text, so repeated rows are repeated turns. Null roles and texts
    are empty. Rows with a null conversation take no part; an empty table gives
    an empty result (there is no root without a member); other columns are
    ignored whatever their names.
    """
    at = placed(conversations, conv_col, turn_col, role_col, text_col)
    if rebuild:
        turns, convs = rebuilt(at)
    else:
        turns = at.withColumn("depth", F.col("pos") + 1)
        convs = written(at.groupBy("conv_id").agg(F.count("*").alias("turns")), "convs")
    return trie(turns, convs)


ORACLE = """
WITH ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM ordered GROUP BY conv_id),
table8 AS (
  WITH RECURSIVE t(b, k, c) AS (
    SELECT b, 0, b::BIGINT FROM range(256) r(b)
    UNION ALL SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM t WHERE k < 8)
  SELECT b, c FROM t WHERE k = 8),
crc AS (
  WITH RECURSIVE s(conv_id, k, c) AS (
    SELECT conv_id, 0, 4294967295::BIGINT FROM sizes
    UNION ALL
    SELECT s.conv_id, s.k + 1, xor(t.c, s.c >> 8) FROM s JOIN table8 t
      ON t.b = xor(s.c & 255, ascii(substr(s.conv_id::VARCHAR, s.k + 1, 1))::BIGINT) WHERE s.k < strlen(s.conv_id::VARCHAR))
  SELECT conv_id, xor(c, 4294967295::BIGINT) % 9 AS h FROM s WHERE k = strlen(conv_id::VARCHAR)),
convs AS (
  SELECT s.conv_id, s.conv_id - ((s.conv_id % 5) + 5) % 5 AS base, h, least(h, coalesce(b.n, 0)) AS head
  FROM sizes s JOIN crc USING (conv_id) LEFT JOIN sizes b ON b.conv_id = s.conv_id - ((s.conv_id % 5) + 5) % 5),
turns AS (
  SELECT c.conv_id, o.pos + 1 AS depth, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, o.pos - c.h + c.head + 1, o.role, o.text FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND o.pos >= c.h),
lists AS (
  SELECT c.conv_id, coalesce(list({'r': t.role, 't': t.text} ORDER BY t.depth) FILTER (WHERE t.depth IS NOT NULL), []) AS l
  FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY c.conv_id),
paths AS (SELECT conv_id, d AS depth, l[1:d] AS p, len(l) = d AS last, coalesce(strlen(l[d].t), 0) AS bytes FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM lists)),
nodes AS (
  SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ends
  FROM paths GROUP BY depth, p),
named AS (SELECT *, row_number() OVER () AS node FROM nodes),
member AS (SELECT x.conv_id, x.depth, n.node FROM paths x JOIN named n ON n.depth = x.depth AND n.p = x.p),
edges AS (
  SELECT DISTINCT b.node, a.node AS parent FROM member a JOIN member b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1),
fans AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM member a JOIN member b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT top AS node, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens, count(*) FILTER (WHERE f.node IS NULL) AS n_leaves
  FROM below b JOIN named n ON n.node = b.node LEFT JOIN fans f ON f.node = b.node GROUP BY top)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM named n LEFT JOIN edges e ON e.node = n.node LEFT JOIN named q ON q.node = e.parent LEFT JOIN fans f ON f.node = n.node JOIN sums s ON s.node = n.node"""
