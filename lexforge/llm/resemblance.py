"""Links between texts whose word shingles reach a Jaccard similarity, by
SimHash: the part of operator 2 for near copies that were edited.

At a similarity of 0.8, fingerprints differ by some ten bits of 64, which is too
many for cells of equal bits. Texts are therefore dealt into cells by minima of
their shingles' hashes (``BANDS`` bands of ``ROWS``: a pair of similarity 0.8
shares a cell with probability 0.9996). In a cell, fingerprints are compared
tile by tile with exclusive-or and bit counts; pairs within ``RADIUS`` bits and of
compatible sizes are candidates, which are then checked by their shingles. Here
a fingerprint folds distinct shingles, so that repeats, which the similarity does
not see, do not move it. At a similarity of 0.8 a bit differs with probability
0.19 at most (four shingles against the same and a fifth; 0.15 for long texts),
so more than 24 of 64 differ with a probability below 0.0002 (long texts:
0.000003). Both misses together are below 0.0006 for a pair at 0.8 exactly and
vanish above it: at 0.85 they are below 0.00004.

How it stays whole and bounded. Texts of equal words are one class. Cells are
found by one shuffle of (cell, class); only classes that share one are given
their fingerprints, sizes and keys. A task names the classes of a cell that have
a candidate there which shares no cell of an earlier band with them, and only
these bring their shingles, once to each such cell. There every candidate pair
of different components is checked, and a place gives back one link for each
merge: neither candidates nor failed pairs leave a task, however large a group
of texts is that are alike but not near. Places hold at most some ``LIMIT``
classes and ``SHINGLES`` shingles; larger cells are dealt into parts, each of
which meets the cell's smallest class. A second turn, for such cells alone,
brings the classes outside a cell's commonest component to every part, in tiles
of the same size, two tiles in a place; that component needs no check within.
After it every candidate pair of different components has been checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.llm.caches import enter
from lexforge.llm.components import components
from lexforge.llm.shared import discard, written

SEED = 42
WIDTH, LEAST = 5, 0.8
BANDS, ROWS, RADIUS = 20, 5, 24
#: Classes, and distinct shingles, of a part of a cell.
LIMIT, SHINGLES = 4096, 1 << 21
#: Shingles hashed, and fingerprints compared, at a time.
STRIP, TILE = 1 << 12, 512
#: Classes that may be broadcast: 8 bytes each.
BROADCAST = 1 << 20

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """A-Z is lower-cased; words are runs of bytes other than space and 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; fewer words give
    one shingle, none give none."""
    width = min(width, len(words))
    if not width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(width)))), np.uint64, n)


def class_of(words: list[bytes]) -> int:
    """Equal for texts of the same words, as a signed 64-bit integer."""
    h = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return h - (1 << 64) if h >> 63 else h


def folded(hashes: np.ndarray) -> int:
    """The SimHash of shingles as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STRIP):
        ones += np.unpackbits(hashes[at : at + STRIP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """One key for each band, from the minima of ``BANDS * ROWS`` hash functions."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), STRIP):
        np.minimum(least, (_FACTORS[:, None] * distinct[None, at : at + STRIP]).min(axis=1), out=least)
    least ^= least >> np.uint64(29)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def with_keys(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, fp, sim, n, keys): ``fp`` is the class of the words, ``sim`` the
    SimHash of the distinct shingles, ``n`` the number of distinct shingles; no keys without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for batch in batches:
            fps, sims, ns, keys = [], [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                hashes = shingle_hashes(words, width)
                distinct = np.unique(hashes)
                fps.append(class_of(words))
                sims.append(folded(distinct) if len(distinct) else 0)
                ns.append(len(distinct))
                keys.append(band_keys(distinct) if len(distinct) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sims, pa.int64()), pa.array(ns, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "sim", "n", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long, sim long, n int, keys array<long>")


def met_before(keys: np.ndarray | None, band: np.ndarray | int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs share a cell of an earlier band, where they are candidates
    already: a pair counts in the first cell that it shares only."""
    if keys is None or not len(a):
        return np.zeros(len(a), bool)
    earlier = np.arange(keys.shape[1])[None, :] < np.broadcast_to(band, len(keys))[a][:, None]
    return ((keys[a] == keys[b]) & earlier).any(axis=1)


def nearest(fp: np.ndarray, sim: np.ndarray, n: np.ndarray, root: np.ndarray, most: int, least: float = LEAST, radius: int = RADIUS, tile: int = TILE, keys: np.ndarray | None = None, band: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, bool, int, int]:
    """Candidates of one cell: (positions a, positions b, all, compared, skipped).

    Each class brings its ``most`` nearest of another component, by bits and
    then by class; ``all`` says that none was left out. Tiles are ordered by
    population count; pairs of tiles whose counts differ beyond the radius are
    skipped.
    """
    bits = sim.view(np.uint64)
    counts = np.bitwise_count(bits).astype(np.int64)
    order = np.lexsort((fp, counts))
    tiles = [order[at : at + tile] for at in range(0, len(order), tile)]
    out_a, out_b, whole, compared, skipped = [], [], True, 0, 0
    for left in tiles:
        found = []
        for right in tiles:
            if counts[right[0]] - counts[left[-1]] > radius or counts[left[0]] - counts[right[-1]] > radius:
                skipped += 1
                continue
            compared += 1
            apart = np.bitwise_count(bits[left][:, None] ^ bits[right][None, :])
            sizes = np.minimum(n[left][:, None], n[right][None, :]) >= least * np.maximum(n[left][:, None], n[right][None, :])
            a, b = np.nonzero((apart <= radius) & sizes & (root[left][:, None] != root[right][None, :]))
            new = ~met_before(keys, band, left[a], right[b])
            a, b = a[new], b[new]
            found.append((a, right[b], apart[a, b]))
        if found:
            a, b, d = (np.concatenate([x[k] for x in found]) for k in range(3))
            order_ab = np.lexsort((fp[b], d, a))
            a, b = a[order_ab], b[order_ab]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < most
            whole &= bool(keep.all())
            out_a.append(left[a[keep]])
            out_b.append(b[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none]), whole, compared, skipped


def _small(cell: np.ndarray, fp, sim, n, root, most: int, least: float, radius: int, keys: np.ndarray | None = None, band: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """:func:`nearest` for many small cells at once; ``cell`` is ascending."""
    bits, pos_a, pos_b = sim.view(np.uint64), [], []
    ends = np.searchsorted(cell, cell, side="right")
    for step in range(1, int((ends - np.arange(len(cell))).max(initial=1))):
        a = np.flatnonzero(np.arange(len(cell)) + step < ends)
        b = a + step
        near = (np.bitwise_count(bits[a] ^ bits[b]) <= radius) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])) & (root[a] != root[b])
        a, b = a[near], b[near]
        new = ~met_before(keys, band, a, b)
        pos_a.append(a[new])
        pos_b.append(b[new])
    a, b = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (pos_a, pos_b))
    a, b = np.append(a, b), np.append(b, a)
    order = np.lexsort((fp[b], np.bitwise_count(bits[a] ^ bits[b]), a))
    a, b = a[order], b[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < most
    return a[keep], b[keep], bool(keep.all())


#: Where rows meet, and what a row brings there.
PLACE = ["cell", "part", "tile"]
BROUGHT = ["side", "fp", "sim", "n", "root", "band"]
KIND = "cell long, part int, tile int, side int, fp long, sim long, n int, root long, band int, keys array<int>"


def _earlier(keys: pa.ListArray, band: np.ndarray) -> np.ndarray:
    """Keys of the bands before each row's own as a matrix."""
    out = np.zeros((len(band), BANDS), np.int32)
    out[np.arange(BANDS)[None, :] < band[:, None]] = keys.flatten().to_numpy()
    return out


def parted(size: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(size / LIMIT), F.ceil(shingles / SHINGLES)).cast("int")


def shared_cells(classes: DataFrame) -> DataFrame:
    """(fp, sim, n, cell, band, parts, hub, keys): classes (fp, sim, n, keys) in
    each cell that they share with others. ``keys`` are halves of the keys of
    earlier bands, ``hub`` is the cell's smallest class."""
    known = classes.filter("keys IS NOT NULL")
    every = known.select("fp", "n", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("cell"), "fp", "n", "band")
    here = Window.partitionBy("cell")
    sized = every.select("cell", "fp", "band", F.count("*").over(here).alias("size"), F.sum("n").over(here).alias("shingles"), F.min("fp").over(here).alias("hub"))
    met = sized.filter("size > 1").select("cell", "fp", "band", "hub", parted(F.col("size"), F.col("shingles")).alias("parts"))
    # half of each key says whether a pair shares that band's cell
    halves = F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("keys")
    return met.join(known.select("fp", "sim", "n", halves), "fp").withColumn("keys", F.slice("keys", 1, F.col("band")))


def first_turn(members: DataFrame) -> DataFrame:
    """Each class at its own part of each cell; the hub at every part."""
    home = F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("fp") == F.col("hub"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(home)).alias("part")
    return members.select("cell", part, F.lit(0).alias("tile"), F.lit(0).alias("side"), "fp", "sim", "n", F.col("fp").alias("root"), "band", "keys")


def second_turn(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """For cells of several parts: classes outside the commonest component, dealt
    into tiles, at every part (side 0), and each part at every tile (side 1)."""
    labelled = members.filter("parts > 1").join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = labelled.groupBy("cell", "root").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    most = by_root.groupBy("cell").agg(F.max_by(F.struct("root", "c", "m"), F.struct("c", "root")).alias("major"), F.sum("c").alias("c"), F.sum("m").alias("m"))
    cells = most.select("cell", F.col("major.root").alias("major"), parted(F.col("c") - F.col("major.c"), F.col("m") - F.col("major.m")).alias("tiles")).filter("tiles > 0")
    dealt = labelled.join(cells, "cell")
    brought = ["fp", "sim", "n", "root", "band", "keys"]
    own = lambda n, salt: F.pmod(F.xxhash64("fp", *salt), F.col(n)).cast("int")
    outside = dealt.filter("root <> major").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), own("tiles", [F.lit(1)]).alias("tile"), F.lit(0).alias("side"), *brought)
    return outside.unionByName(dealt.select("cell", own("parts", []).alias("part"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(1).alias("side"), *brought))


def with_candidates(dealt: DataFrame, least: float, radius: int) -> DataFrame:
    """The rows that have a candidate of another component at their place."""

    def asked(rows: dict) -> np.ndarray:
        # a number for each place, ascending as the rows are sorted
        place = np.concatenate([[0], np.cumsum(np.any([np.diff(rows[c]) != 0 for c in PLACE], axis=0))])
        size = np.bincount(place)[place]
        few = np.flatnonzero(size <= 64)
        own = [rows[k][few] for k in ("fp", "sim", "n", "root")]
        found = [few[_small(place[few], *own, 1, least, radius, rows["keys"][few], rows["band"][few])[0]]]
        for big in np.unique(place[size > 64]):
            at = np.flatnonzero(place == big)
            a = nearest(*(rows[k][at] for k in ("fp", "sim", "n", "root")), 1, least, radius, keys=rows["keys"][at], band=rows["band"][at])[0]
            found.append(at[a])
        return np.unique(np.concatenate(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        held: list[pa.RecordBatch] = []

        def done(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = {c: batch.column(c).to_numpy() for c in PLACE + BROUGHT}
            rows["keys"] = _earlier(batch.column("keys"), rows["band"])
            return batch.take(pa.array(asked(rows)))

        for batch in batches:
            if not batch.num_rows:
                continue
            # the last place of a batch may go on in the next
            same = np.all([(x := batch.column(c).to_numpy()) == x[-1] for c in PLACE], axis=0)
            cut = batch.num_rows - int(same.sum())
            if cut or held and any(held[-1].column(c)[0] != batch.column(c)[0] for c in PLACE):
                yield done(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield done(pa.concat_batches(held))

    return dealt.repartition(*PLACE).sortWithinPartitions(*PLACE).select(*PLACE, *BROUGHT, "keys").mapInArrow(run, KIND)


def place_links(rows: dict[str, np.ndarray], sets: list[np.ndarray], least: float = LEAST, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what the candidate pairs of one place that reach
    ``least`` connect, one for each merge.

    With two sides, those of side 0 meet those of side 1; else all meet all. A
    row's overlaps with all its candidates are counted at once. Pairs of one
    component are not checked.
    """
    fp, bits, n, side, keys, band = rows["fp"], rows["sim"].view(np.uint64), rows["n"], rows["side"], rows["keys"], rows["band"]
    root = np.unique(rows["root"], return_inverse=True)[1]
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes.astype(np.int32), np.cumsum(lengths)[:-1])
    present, out = np.zeros(len(values), bool), []
    across = np.flatnonzero(side == 1) if side.any() else None
    for i in range(len(fp)) if across is None else np.flatnonzero(side == 0):
        j = np.arange(i + 1, len(fp)) if across is None else across
        j = j[root[j] != root[i]]
        j = j[(np.bitwise_count(bits[j] ^ bits[i]) <= radius) & (np.minimum(n[j], n[i]) >= least * np.maximum(n[j], n[i]))]
        j = j[~met_before(keys, band, np.full(len(j), i), j)]
        if not len(j):
            continue
        present[codes[i]] = True
        starts = np.cumsum(lengths[j]) - lengths[j]
        both = np.add.reduceat(present[np.concatenate([codes[k] for k in j])], starts, dtype=np.int64)
        present[codes[i]] = False
        near = j[both / (lengths[i] + lengths[j] - both) >= least]
        if len(near):
            merged, first = np.unique(root[near], return_index=True)
            out += [(int(fp[i]), int(fp[k])) for k in near[first]]
            root[np.isin(root, merged)] = root[i]
    return out


def shingle_sets(docs: DataFrame, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """(fp, shingles) of the classes in ``wanted`` (fp), one row for each: sorted
    32-bit hashes of the distinct shingles, as bytes."""

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    n = wanted.count()
    # up to BROADCAST classes: eight bytes each
    few = docs.sparkSession.sparkContext.broadcast(np.sort(wanted.toArrow().column("fp").to_numpy())) if n <= BROADCAST else None

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for batch in batches:
            fps, sets = [], []
            for text in batch.column(0):  # one text's words at a time
                words = words_of(text.as_py())
                fp = class_of(words)
                if few is None:
                    fps.append(fp)
                elif (at := int(np.searchsorted(few.value, fp))) < len(few.value) and few.value[at] == fp:
                    fps.append(fp)
                    sets.append(packed(words))
            if few is None:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), batch.column(0)], names=["fp", "text"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(sets, pa.binary())], names=["fp", "shingles"])

    def packed(words: list[bytes]) -> bytes:
        return np.unique(shingle_hashes(words, width).astype(np.uint32)).tobytes()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packed(words_of(t.as_py())) for t in batch.column(1)], pa.binary())], names=["fp", "shingles"])

    if few is not None:
        sets = texts.mapInArrow(named, "fp long, shingles binary")
    else:
        sets = texts.mapInArrow(named, "fp long, text string").join(wanted, "fp", "left_semi").mapInArrow(hashed, "fp long, shingles binary")
    return sets.groupBy("fp").agg(F.min("shingles").alias("shingles"))


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sets as :func:`shingle_sets` gives them."""
    return _jaccard(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32))


def checked(asked: DataFrame, sets: DataFrame, least: float, radius: int) -> DataFrame:
    """(a, b): :func:`place_links` of every place. Shingles come once to each
    place where their class has a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def done() -> list[tuple[int, int]]:
            batch = pa.concat_batches([b for b in held])
            rows = {c: batch.column(c).to_numpy() for c in BROUGHT}
            rows["keys"] = _earlier(batch.column("keys"), rows["band"])
            return place_links(rows, [np.frombuffer(x, np.uint32) for x in batch.column("shingles").to_pylist()], least, radius)

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array([batch.column(c).to_numpy() for c in PLACE])
            starts = np.concatenate([[0], np.flatnonzero((np.diff(at, axis=1) != 0).any(axis=0)) + 1, [batch.num_rows]])
            out = []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if (here := tuple(at[:, low].tolist())) != place:
                    out += done() if held else []
                    place, held = here, []
                held.append(batch.slice(low, high - low))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
        if held and (out := done()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    rows = asked.join(sets, "fp").repartition(*PLACE).sortWithinPartitions(*PLACE)
    return rows.select(*PLACE, *BROUGHT, "keys", "shingles").mapInArrow(run, "a long, b long")


def similar_links(docs: DataFrame, classes: DataFrame, text_col: str, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect what pairs of classes (fp, sim, n, keys) of
    similarity ``least`` connect, written to the shared folder."""
    members = written(shared_cells(classes), "cells")

    def links(dealt: DataFrame) -> DataFrame:
        asked = written(with_candidates(dealt, least, radius), "asked")
        wanted = written(asked.select("fp").distinct(), "wanted")
        found = written(checked(asked, shingle_sets(docs, text_col, wanted, width), least, radius), "similar")
        discard(asked)
        discard(wanted)
        return found

    out = links(first_turn(members))
    if members.filter("parts > 1").limit(1).count():
        more = links(second_turn(members, components(out).withColumnRenamed("node", "fp")))
        both = written(out.unionByName(more), "similar")
        discard(out)
        discard(more)
        out = both
    discard(members)
    return out
