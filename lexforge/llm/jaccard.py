"""Exact Jaccard join of word n-gram sets by blocked sparse matrix products.

The matrix has a row for each distinct set and a column for each n-gram; two
rows overlap by the product of one with the other. Two sets of n and m n-grams
link when their overlap reaches ``need(n, m)``, which bounds everything here:

* Sizes. Linked sets differ in at most ``(n + m) * (100 - p) / (100 + p)``
  n-grams, ``p`` being the similarity in per cent. n-grams are dealt by ranges
  of their hash into more parts than that, so linked sets agree on some whole
  part. A set gives one signature for each part, for its own class of sizes and
  for each next one that a partner may be in. ``spare`` parts more than needed
  let parts of at most ``WEAK`` n-grams go, which unlike sets share by chance; a
  set with more such parts than that keeps all of its signatures.
* Blocks. Sets that share a signature are joined by a star, and components of
  these stars are the blocks of the product: no linked pair lies across blocks,
  and a set goes to one block once, not to one for each signature.
* Overlap. In a block, a row is multiplied with all rows: first the columns that
  are rarest there, as many as a linked partner cannot all lack; rows that these
  do not touch, of other sizes, or of the row's own component go; overlaps of the
  rest are summed over the other columns. Rows of the commonest component need
  no product with each other, so a group of near copies costs a few products
  for each row instead of all pairs. A block returns one link for each merge.

Blocks above ``TILE`` n-grams are cut into tiles. A first round multiplies each
tile with itself and with the block's first row; a second one multiplies rows
outside a block's commonest component with every tile, two tiles in a task.
After it every pair of different components has been multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.caches import enter
from lexforge.llm.components import components
from lexforge.llm.shared import discard, written

WIDTH, PERCENT = 3, 90
#: n-grams of a part that does not tell sets apart; growth of the classes of sizes.
WEAK, STEP = 2, 1.25
#: n-grams of a tile: at most two tiles are multiplied in one task, with some 40 bytes for each n-gram.
TILE = 1 << 21
#: Identifiers that may be broadcast: some tens of bytes each.
BROADCAST = 1 << 20

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _D
    return x ^ (x >> np.uint64(29))


def ngrams(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text.

    A-Z is lower-cased, words are runs of bytes other than space and 9 to 13;
    fewer than ``width`` words are one n-gram, none give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if n else [], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    out = _mix(one[: n - width + 1] * _A)
    for k in range(1, width):
        out = _mix((out + one[k : n - width + 1 + k]) * _B)
    return np.unique(out)


def class_of(grams: np.ndarray) -> int:
    """Equal for equal sets: a signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(grams.tobytes(), 2)
    return h - (1 << 64) if h >> 63 else h


def need(n, m, percent: int = PERCENT):
    """The least overlap of linked sets of n and m n-grams."""
    return -((-percent * (n + m)) // (100 + percent))


def size_classes(n: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(class, parts, spare) for every class of sizes that a set of n n-grams or
    a larger partner of it may be in; none where only equal sets can link."""
    low, number, out = 1, 0, []
    while percent * low <= 100 * n:
        high = max(low + 1, int(low * STEP))
        if high > n:
            apart = 2 * (high - 1) * (100 - percent) // (100 + percent)
            if apart:
                spare = (apart + 1) // 5
                out.append((number, apart + 1 + spare, spare))
        low, number = high, number + 1
    return out


def signatures(grams: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signed 64-bit signatures of a sorted set: linked sets that are not equal
    have one in common."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(grams * _C), dtype=np.uint64)])
    out = []
    for number, parts, spare in size_classes(len(grams), percent):
        edges = np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)
        at = np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])
        place = np.uint64(number << 32) + np.arange(parts, dtype=np.uint64)
        signed = _mix((sums[at[1:]] - sums[at[:-1]]) * _A + _mix(place * _B))
        strong = np.diff(at) > WEAK
        out.append(signed[strong] if parts - strong.sum() <= spare else signed)
    return np.concatenate(out or [np.zeros(0, np.uint64)]).view(np.int64)


def with_signatures(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, class, n, signatures): the class is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            classes, sizes, signed = [], [], []
            for text in batch.column(1):
                grams = ngrams(text.as_py(), width)
                classes.append(class_of(grams) if len(grams) else None)
                sizes.append(len(grams))
                signed.append(signatures(grams, percent))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in signed], dtype=np.int32)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signed or [np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["id", "class", "n", "signatures"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, class long, n long, signatures array<long>")


def stars(keyed: DataFrame) -> DataFrame:
    """Links (a, b) from the classes of each signature to the smallest of them.

    Each batch joins its own classes first and passes on one row a signature, so
    a signature that many sets share is one row a batch in the shuffle.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            signed = lists.flatten().to_numpy()
            classes = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((classes, signed))
            signed, classes = signed[order], classes[order]
            first = np.append(True, signed[1:] != signed[:-1])[: len(signed)]
            hub = classes[np.maximum.accumulate(np.where(first, np.arange(len(signed)), 0))]
            # a class may meet a hub by many signatures and in many copies: one link says it
            pairs = np.unique(np.stack([classes, hub], axis=1)[classes != hub], axis=0)
            for sig, a, b in ((signed[first], classes[first], classes[first]), (pairs[:, 0], pairs[:, 0], pairs[:, 1])):
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(a), pa.array(b)], names=["sig", "a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_hub = None, None
        for batch in batches:
            sig, a, b = (batch.column(k).to_numpy() for k in range(3))
            own = a == b  # the others are links already
            s, c = sig[own], a[own]
            hub = np.zeros(0, np.int64)
            if len(s):
                first = np.append(s[0] != last, s[1:] != s[:-1])
                at = np.maximum.accumulate(np.where(first, np.arange(len(s)), -1))
                hub = np.where(at < 0, last_hub if last_hub is not None else 0, c[np.maximum(at, 0)])
                last, last_hub = s[-1], hub[-1]
            far = c != hub
            yield pa.RecordBatch.from_arrays([pa.array(np.append(c[far], a[~own])), pa.array(np.append(hub[far], b[~own]))], names=["a", "b"])

    rows = keyed.filter("class IS NOT NULL").select("class", "signatures").mapInArrow(local, "sig long, a long, b long")
    return rows.repartition("sig").sortWithinPartitions("sig", "a").mapInArrow(across, "a long, b long")


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[k] .. starts[k] + lengths[k] - 1, for all k in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Block:
    """The rows of a block and their product with it."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.m = percent, len(sets)
        self.n = np.array([len(s) for s in sets], np.int64)
        self.row_at = np.concatenate([[0], np.cumsum(self.n)])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
        column = np.cumsum(first) - 1
        self.col_at = np.append(np.flatnonzero(first), len(flat))
        self.df = np.diff(self.col_at)
        self.rows = (np.searchsorted(self.row_at, order, side="right") - 1).astype(np.int32)
        self.columns = np.empty(len(flat), np.int32)
        self.columns[order] = column

    def linked(self, i: int, component: np.ndarray) -> np.ndarray:
        """Rows of other components that link with row i."""
        n = int(self.n[i])
        columns = self.columns[self.row_at[i] : self.row_at[i + 1]]
        columns = columns[self.df[columns] > 1]
        # no partner needs less overlap than the smallest that sizes allow
        least = int(need(n, -((-self.percent * n) // 100), self.percent))
        spare = len(columns) - least
        if spare < 0:
            return np.zeros(0, np.int64)
        columns = columns[np.argsort(self.df[columns], kind="stable")]
        rare, rest = columns[: spare + 1], columns[spare + 1 :]
        both = np.bincount(self.rows[_spans(self.col_at[rare], self.df[rare])], minlength=self.m)
        able = (component != component[i]) & (100 * self.n >= self.percent * n) & (self.percent * self.n <= 100 * n)
        # what is still to come may lift a pair to its bound, or the pair goes
        able &= (both > 0) & (both + len(rest) >= need(n, self.n, self.percent))
        if not able.any():
            return np.zeros(0, np.int64)
        both += np.bincount(self.rows[_spans(self.col_at[rest], self.df[rest])], minlength=self.m)
        return np.flatnonzero(able & (both >= need(n, self.n, self.percent)))


def merged(component: np.ndarray, a: int, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Components after row a has been linked with rows b, and those of b that
    stand for the links that joined something."""
    there, first = np.unique(component[b], return_index=True)
    new = there != component[a]
    return np.where(np.isin(component, there), component[a], component), b[first[new]].tolist()


def links_within(sets: list[np.ndarray], component: np.ndarray, percent: int = PERCENT) -> tuple[list[tuple[int, int]], int]:
    """(links, products): links that connect the rows as all links between rows
    of different components do, and how many rows were multiplied."""
    block, links, products = Block(sets, percent), [], 0
    component = np.unique(component, return_inverse=True)[1]
    waiting = np.ones(len(sets), bool)
    batch = 16
    while True:
        outside = np.flatnonzero(waiting & (component != np.bincount(component).argmax()))
        if not len(outside):
            return links, products
        for i in outside[:batch].tolist():
            waiting[i] = False
            products += 1
            component, used = merged(component, i, block.linked(i, component))
            links += [(i, j) for j in used]
        batch = min(256, batch * 2)


def multiplied(dealt: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the groups (block, g, tile) of rows (class, root, grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        place, classes, roots, sets = None, [], [], []

        def done():
            if len(sets) < 2:
                return []
            links, _ = links_within(sets, np.array(roots, np.int64), percent)
            return [(classes[i], classes[j]) for i, j in links]

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            pairs = []
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)))
            for k, (block, g, tile, one, root) in enumerate(keys):
                if (block, g, tile) != place:
                    pairs += done()
                    place, classes, roots, sets = (block, g, tile), [], [], []
                if not classes or one != classes[-1]:  # a row may have been dealt twice
                    classes.append(one)
                    roots.append(root)
                    sets.append(np.frombuffer(batch.column(5)[k].as_py(), np.uint64))
            yield out(pairs)
        yield out(done())

    columns = ["block", "g", "tile", "class", "root", "grams"]
    return dealt.select(*columns).repartition("block", "g", "tile").sortWithinPartitions("block", "g", "tile", "class").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``members`` with the n-grams of each class, as bytes. Only the texts of one
    identifier a class, and those without one, are cut again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            sets = [ngrams(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "grams"])

    ids = classes.join(members.select("class"), "class", "left_semi").select(F.col("first").alias("id")).filter("id IS NOT NULL").distinct()
    if ids.count() <= BROADCAST:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    some = texts.join(ids, "id", "left_semi").unionByName(texts.filter("id IS NULL")).select("text")
    cut = some.mapInArrow(run, "class long, grams binary").join(members.select("class"), "class", "left_semi")
    return members.join(cut.groupBy("class").agg(F.first("grams").alias("grams")), "class")


def class_links(docs: DataFrame, keyed: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect classes as all linked pairs do, written."""
    blocks = written(components(stars(keyed)), "blocks").select(F.col("node").alias("class"), F.col("root").alias("block"))
    sized = blocks.join(classes.select("class", "n"), "class")
    tiles = sized.groupBy("block").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"), F.min("class").alias("hub"))
    members = sized.join(tiles, "block").select("class", "block", "n", "tiles", "hub", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int").alias("tile"))
    rows = written(_sets(docs, written(members, "members"), classes, id_col, text_col, width), "sets")

    everywhere = F.when(F.col("class") == F.col("hub"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    dealt = rows.withColumn("tile", F.explode(everywhere)).withColumn("root", F.col("class")).withColumn("g", F.lit(0))
    links = written(multiplied(dealt, percent), "links")
    large = rows.filter("tiles > 1")
    if large.limit(1).count() == 0:
        discard(rows)
        return links

    rooted = components(links).withColumnRenamed("node", "class")
    large = written(large.drop("hub").join(rooted, "class", "left").withColumn("root", F.coalesce("root", "class")).drop("grams"), "large")
    counts = large.groupBy("block", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    left = counts.groupBy("block").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.sum("n").alias("all"), F.max_by("n", F.struct("c", "root")).alias("n_major"), F.count("*").alias("roots"))
    left = left.filter("roots > 1").select("block", "major", F.ceil((F.col("all") - F.col("n_major")) / TILE).cast("int").alias("groups"))
    again = large.join(left, "block").join(rows.select("class", "grams"), "class")
    every_g = again.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    every_tile = again.filter("root <> major").withColumn("g", F.pmod(F.xxhash64("class", F.lit(1)), F.col("groups")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    columns = ["block", "g", "tile", "class", "root", "grams"]
    more = multiplied(every_g.select(columns).unionByName(every_tile.select(columns)), percent)
    out = written(links.unionByName(more), "links")
    for frame in (rows, links, large):
        discard(frame)
    return out


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: (id_col, n_shingles, component_id).

    Two rows link when 100 * overlap >= percent * union of their sets of word
    ``width``-grams; ``component_id`` is the smallest id reachable over links,
    the row's own included.

    Defined results: a null or wordless text has no n-gram and links with
    nothing, not even its like; a null id takes part, and a component's id is
    the smallest that is not null, or null; repeated rows each stay, and are
    linked; an empty table gives an empty result; other columns are ignored
    whatever their names. Sets and n-grams are told apart by 64-bit hashes.
    """
    if not 50 <= percent < 100:
        raise ValueError("percent is 50 to 99")
    keyed = written(with_signatures(docs, id_col, text_col, width, percent), "keyed")
    classes = written(keyed.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    links = class_links(docs, keyed, classes, id_col, text_col, width, percent)
    roots = components(links).withColumnRenamed("node", "class")
    rooted = classes.join(roots, "class", "left").filter((F.col("copies") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "class"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"))
    mapped = written(rooted.join(smallest, "root").select("class", "component"), "mapped")
    out = keyed.select("id", "class", "n").join(mapped, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s"""
