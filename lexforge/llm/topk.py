"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into segments; with the mean and the deviation of each, the
Cauchy-Schwarz inequality bounds an inner product from above by the sum over
segments of length * (mean * mean + deviation * deviation), which is the usual
lower bound of the squared distance turned round. Bounds are evaluated from
one segment to many, a level being one product of two small matrices; what
stays above the query's floor goes on to the next level, and the survivors are
scored exactly. Where vectors are alike in all directions, segments of equal
width say little until they are two components wide, so the last levels take
single components at the front and segments of four behind: of a random pair
the front gives the product and the rest can add little to it.

How the work is laid out. A query's floor is its k-th best score in a bounded
sample of rows, so no tile starts from nothing. Queries are written in blocks
to the shared folder; a task reads its rows once, a few tiles at a time, and meets
them with the blocks in turn, so neither the driver nor a broadcast holds
the queries. A tile hands on the k best of each query, and those only if they
reach the floor.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.caches import enter
from lexforge.llm.shared import discard, opened_store, part_files, written

#: Bytes of query vectors in a block, of row vectors in a tile and of the sample that floors are taken from.
QUERY_BYTES, TILE_BYTES, SAMPLE_BYTES = 8 << 20, 8 << 20, 2 << 20


class Front(NamedTuple):
    """A level with single components in front, and segments of ``step`` behind."""

    eighths: int
    step: int


LEVELS = (1, 4, 16, Front(5, 4), Front(7, 4))
#: Queries that meet a tile at a time, and tiles that are held with their statistics (some four times their bytes).
STRIP, HELD = 512, 6
#: Above this share of pairs left, the next level's bounds come as one matrix product; below it the pairs left are gathered.
DENSE = 1 / 16
#: Pairs that are gathered at a time.
GATHER = 1 << 15
#: Integers up to here are exact in products and sums of doubles.
EXACT = float(1 << 53)
#: Components up to here have squares and sums that bounds can be taken of.
BOUNDED = 1e100
_LOW = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as doubles holding integers.

    Vectors that are null, empty or hold a null, an infinity or no number are
    left out.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    # floor() of a double column gives a long, which large components overflow: subtract the remainder instead
    return rows.select("id", F.transform("v", lambda x: _floor(x * scale)).alias("v"))


def _floor(y):
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def cuts_of(width: int, level: int | Front) -> np.ndarray:
    """Where the segments of a level begin."""
    if isinstance(level, Front):
        front = width * level.eighths // 8
        return np.concatenate([np.arange(front), np.arange(front, width, level.step)])
    return np.linspace(0, width, min(level, width) + 1).astype(int)[:-1]


def levels_of(width: int, levels) -> list:
    """The levels that have fewer segments than a vector has components."""
    return [n for n in levels if (width >= 16 if isinstance(n, Front) else n < width)]


def segments(x: np.ndarray, level: int | Front) -> np.ndarray:
    """Means and deviations of segments, weighted so that the inner product of
    two rows is the bound. A single component has no deviation."""
    cuts = cuts_of(x.shape[1], level)
    width = np.diff(np.append(cuts, x.shape[1]))
    mean = np.add.reduceat(x, cuts, axis=1) / width
    squares = np.add.reduceat(x * x, cuts, axis=1) / width
    wide = width > 1
    deviation = np.sqrt(np.maximum(0, squares - mean * mean))[:, wide]
    return np.concatenate([mean * np.sqrt(width), deviation * np.sqrt(width[wide])], axis=1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of row pairs as 64-bit integers (saturated outside)."""
    if len(q) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= EXACT:
        top = (1 << 63) - 1
        big = [sum(int(a) * int(b) for a, b in zip(r, s)) for r, s in zip(q, x)]
        return np.array([max(-top - 1, min(top, n)) for n in big], np.int64)
    return np.einsum("ij,ij->i", q, x).astype(np.int64)


class Block:
    """Queries of one length: identifiers, vectors, floors and statistics."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, levels=LEVELS):
        self.key, self.ids, self.q, self.floor = key, ids, vectors, floor.astype(np.float64)
        self.levels = levels_of(vectors.shape[1], levels)
        self.most = float(np.abs(vectors).max(initial=0))
        fine = self.most <= BOUNDED
        self.stats = [segments(vectors, n) if fine else None for n in self.levels]
        self.pairs = self.exact = 0
        self.passed = [0] * len(self.levels)

    def meet(self, ids: np.ndarray, x: np.ndarray, stats: list, k: int) -> tuple:
        """(query position, row position, score, own) of a tile: each query's k
        best other rows that reach its floor, and the rows equal to the query's
        own, which are marked."""
        own_q, own_x = self._own(ids, x, k)
        floor, alive, total = self.floor[:, None], None, len(self.ids) * len(ids)
        self.pairs += total
        for n, (a, b) in enumerate(zip(self.stats, stats)):
            if a is None or b is None:
                continue
            if alive is None or alive.dtype == bool:
                bound = a @ b.T
                here = bound + (1 + 1e-9 * np.abs(bound)) >= floor
                alive = here if alive is None else alive & here
                left = int(np.count_nonzero(alive))
                if left <= DENSE * total:
                    alive = np.stack(np.nonzero(alive))
            else:
                bound = _gathered(a, b, *alive)
                alive = alive[:, bound + (1 + 1e-9 * np.abs(bound)) >= self.floor[alive[0]]]
                left = alive.shape[1]
            self.passed[n] += left
        if alive is not None and alive.dtype == bool and np.count_nonzero(alive) <= total // 2:
            alive = np.stack(np.nonzero(alive))
        if alive is not None and alive.dtype != bool:
            qi, xi = alive
            score = np.concatenate([exact_scores(self.q[qi[s : s + GATHER]], x[xi[s : s + GATHER]]) for s in range(0, max(1, len(qi)), GATHER)])
            self.exact += len(qi)
            fine = score >= self.floor[qi]
            qi, xi, score = qi[fine], xi[fine], score[fine]
        else:
            self.exact += total
            qi, xi, score = self._dense(x, k)
        if len(own_q):  # the query's own row is none of its candidates
            other = ~np.isin(qi * len(ids) + xi, own_q * len(ids) + own_x)
            qi, xi, score = qi[other], xi[other], score[other]
        qi, xi, score = _best(qi, xi, score, ids, k)
        ends = np.searchsorted(qi, np.arange(len(self.ids)), side="right")
        full = ends - np.searchsorted(qi, np.arange(len(self.ids))) >= k
        self.floor[full] = np.maximum(self.floor[full], score[ends[full] - 1])
        mine = exact_scores(self.q[own_q], x[own_x])
        return np.append(qi, own_q), np.append(xi, own_x), np.append(score, mine), np.append(np.zeros(len(qi), bool), np.ones(len(own_q), bool))

    def _own(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(ids[order], self.ids), np.searchsorted(ids[order], self.ids, side="right")
        qi = np.repeat(np.arange(len(self.ids)), high - low)
        xi = order[np.arange(len(qi)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)] if len(qi) else np.zeros(0, np.int64)
        same = (self.q[qi] == x[xi]).all(axis=1)
        qi, xi = qi[same], xi[same]
        few = np.arange(len(qi)) - np.searchsorted(qi, qi) <= k  # equal rows: no more than k + 1 can matter
        return qi[few], xi[few]

    def _dense(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of the meeting that reach the floor; of a query without one, its best."""
        if self.most * float(np.abs(x).max(initial=0)) * x.shape[1] >= EXACT:
            qi, xi = (g.ravel() for g in np.meshgrid(np.arange(len(self.q)), np.arange(len(x)), indexing="ij"))
            return qi, xi, exact_scores(self.q[qi], x[xi])
        scores = self.q @ x.T
        floor, m = self.floor, 2 * k + 1  # own rows are among them, and are no candidates
        if len(x) > m and floor.min() == float(_LOW):
            floor = np.maximum(floor, np.partition(scores, -m, axis=1)[:, -m])
        hit = scores >= floor[:, None]
        qi, xi = np.nonzero(hit)
        return qi, xi, scores[qi, xi].astype(np.int64)


def _gathered(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", a[i[s : s + GATHER]], b[j[s : s + GATHER]]) for s in range(0, max(1, len(i)), GATHER)])


def _best(qi: np.ndarray, xi: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The k best of each query, ties to the smaller identifier."""
    order = np.lexsort((ids[xi], ~score, qi))  # ~s orders integers downwards, without overflow
    qi, xi, score = qi[order], xi[order], score[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], xi[keep], score[keep]


def tile_stats(x: np.ndarray, levels=LEVELS) -> list:
    fine = float(np.abs(x).max(initial=0)) <= BOUNDED
    return [segments(x, n) if fine else None for n in levels_of(x.shape[1], levels)]


def _arrays(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by their length: (positions, matrix)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.asarray(column.value_lengths())
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = (at, flat[(starts[at][:, None] + np.arange(n)[None, :])])
    return out


def _blocks(files: list[str], levels) -> Iterator[Block]:
    """The query blocks of some files, in strips; a worker holds one file at a time."""
    import pyarrow.parquet as pq

    for file in files:
        store, path = opened_store(file)
        with store.open_input_file(path) as source:
            table = pq.read_table(source)
        key, ids, floor = (table.column(c).to_numpy() for c in ("key", "id", "floor"))
        for _, (at, q) in _arrays(table.column("v")).items():
            for s in range(0, len(at), STRIP):
                own = at[s : s + STRIP]
                yield Block(key[own], ids[own], q[s : s + STRIP], floor[own], levels)


def _floors(sample: pa.Table, k: int):
    """A function that gives queries of a batch their k-th best score in the
    sample, whose rows of the query's own identifier do not count."""
    by_length = _arrays(sample.column("v"))
    ids = sample.column("id").to_numpy()

    def floors(own: np.ndarray, at_q: dict) -> np.ndarray:
        floor = np.full(len(own), _LOW, np.int64)
        for d, (at, q) in at_q.items():
            there, x = by_length.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
            if len(there) <= k or float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * d >= EXACT:
                continue
            for s in range(0, len(at), STRIP):
                scores = q[s : s + STRIP] @ x.T
                scores[own[at[s : s + STRIP]][:, None] == ids[there][None, :]] = -np.inf
                kth = np.partition(scores, -k, axis=1)[:, -k]
                floor[at[s : s + STRIP]] = np.where(np.isfinite(kth), kth, float(_LOW)).astype(np.int64)
        return floor

    return floors


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tiles (identifiers, matrix) of up to about ``TILE_BYTES`` from batches (id, v)."""
    held: dict[int, list] = {}

    def out(d: int) -> tuple[np.ndarray, np.ndarray]:
        parts = held.pop(d)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for batch in batches:
        own = batch.column(0).to_numpy()
        for d, (at, x) in _arrays(batch.column(1)).items():
            step = max(1, TILE_BYTES // (8 * d))
            for s in range(0, len(at), step):
                held.setdefault(d, []).append((own[at[s : s + step]], x[s : s + step]))
                if sum(len(p[0]) for p in held[d]) >= step:
                    yield out(d)
    for d in list(held):
        yield out(d)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, levels=LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but the query's own.

    Defined results: rows with a null id or without a usable vector take no
    part; vectors are compared with those of equal length; scores outside 64
    bits are saturated; ties go to the smaller id. Rows that repeat an id are
    candidates each, and queries each: every such query has its own ranks, and
    other rows of its id are among its candidates. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vector_col, scale).filter("id IS NOT NULL")
    width, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.sum((F.pmod("id", F.lit(every)) == 0).cast("long")), F.lit(0))).first()
    size = max(k + 1, SAMPLE_BYTES // (8 * width))
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(size).toArrow()
    shipped = spark.sparkContext.broadcast(sample)
    blocks = max(1, -(-n * (width + 3) * 8 // QUERY_BYTES))

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = _floors(shipped.value, k)
        for batch in batches:
            floor = floors(batch.column(1).to_numpy(), _arrays(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(floor)], names=["key", "id", "v", "floor"])

    asked = rows.filter(F.pmod(F.col("id"), F.lit(every)) == 0).repartition(blocks, F.xxhash64("id")).select(F.monotonically_increasing_id().alias("key"), "id", "v")
    queries = written(asked.mapInArrow(floored, "key long, id long, v array<double>, floor long"), "queries")
    files = part_files(queries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("topk")
        tiles = _rows(batches)
        # files outside, tiles inside: a file is read once for as many tiles as are held, and floors stay raised
        while held := list(itertools.islice(tiles, HELD)):
            stats = [tile_stats(x, levels) for _, x in held]
            for block in _blocks(files, levels):
                for (ids, x), own_stats in zip(held, stats):
                    if block.q.shape[1] != x.shape[1]:
                        continue
                    step = max(1, (64 << 20) // (8 * len(block.ids)))  # products of bounded size
                    for s in range(0, len(ids), step):
                        part = [None if b is None else b[s : s + step] for b in own_stats]
                        qi, xi, score, own = block.meet(ids[s : s + step], x[s : s + step], part, k)
                        yield pa.RecordBatch.from_arrays([pa.array(block.key[qi]), pa.array(block.ids[qi]), pa.array(ids[s : s + step][xi]), pa.array(score), pa.array(own)], names=["key", "query_id", "vec_id", "score", "own"])

    found = rows.mapInArrow(search, "key long, query_id long, vec_id long, score long, own boolean")
    # of the rows equal to the query's own, one is that row itself and the rest are candidates
    each = Window.partitionBy("key", "own").orderBy(F.col("score").desc(), "vec_id")
    others = found.withColumn("n", F.row_number().over(each)).filter((~F.col("own") & (F.col("n") <= k)) | (F.col("own") & (F.col("n") > 1) & (F.col("n") <= k + 1)))
    best = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    return others.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5"""
