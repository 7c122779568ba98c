"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most ``radius`` bits are linked; a component of
links is one group of near-duplicates.

How the comparison scales. With ``radius + 1`` disjoint groups of bits, two
fingerprints within the radius agree on at least one whole group, hence on any
prefix of it. The distinct fingerprints are therefore dealt into cells (one per
group and prefix) of about ``cell_size`` fingerprints each: the prefix grows
with the logarithm of the corpus, so the work stays in proportion to the
corpus, and no pair within the radius is lost. In a cell, fingerprints are
ordered by population count and cut into tiles; each pair of tiles whose counts
can meet within the radius is compared whole with exclusive-or and bit counts,
the other pairs are skipped. A cell above ``cell_limit`` is itself cut into
tiles of one population count, and each admissible pair of tiles becomes a
group of its own, so that no task gets an unbounded group. A group returns one
link for each fingerprint at most (to its local root), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import resemblance
from lexforge.llm.caches import enter
from lexforge.llm.components import components
from lexforge.llm.shared import OWN, discard, written

SEED = 42
#: Shingles whose bits are counted at a time.
STRIP = 1 << 15
#: Fingerprints of a tile: few enough that the population counts of a cell, which spread over some sixteen values, tell its tiles apart.
TILE = 128


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text as an unsigned integer.

    A-Z is lower-cased, words are runs of bytes other than space and 9 to 13,
    shingles are ``width`` words joined by a space, repeats included. Fewer
    words give one shingle, the whole sequence; none give zero. A bit is set if
    it is set in over half of the shingles' XXH64 (seed 42).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    total = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, STRIP):
        strip = hashes[at : at + STRIP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(strip, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): ``fp`` is the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("simhash")
        for batch in batches:
            fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _roots(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.int64)


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the components of the pairs (a, b); roots are the smallest members."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def link_tiles(fps: np.ndarray, side: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, int, int]:
    """Local roots of the fingerprints of one group.

    ``side`` None compares all with all; else only side 0 with side 1. Returns
    the root fingerprint of each, and how many tile pairs were compared and how
    many were skipped by their population counts.
    """
    bits = fps.view(np.uint64)
    counts = np.bitwise_count(bits).astype(np.int16)
    order = np.lexsort((bits, counts))
    root = _roots(len(fps))
    groups = [order] if side is None else [order[side[order] == 0], order[side[order] == 1]]
    cuts = [[g[at : at + tile] for at in range(0, len(g), tile)] for g in groups]
    compared = skipped = 0
    for i, left in enumerate(cuts[0]):
        rights = cuts[0][i:] if side is None else cuts[1]
        for right in rights:
            low = counts[right[0]] - counts[left[-1]]
            high = counts[left[0]] - counts[right[-1]]
            if low > radius or high > radius:
                skipped += 1
                continue
            compared += 1
            near = np.bitwise_count(bits[left][:, None] ^ bits[right][None, :]) <= radius
            a, b = np.nonzero(near)
            if len(a):
                root = _join(root, left[a], right[b])
    # the smallest fingerprint of each local component stands for it
    smallest = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(smallest, root, fps)
    return smallest[root], compared, skipped


def near_links(classes: DataFrame, radius: int = 2, cell_size: int = 2048, cell_limit: int = 16384, tile: int = TILE) -> DataFrame:
    """Links (a, b), a > b, that connect the distinct ``fp`` within the radius.

    Each link joins two fingerprints of one component; all links together
    connect exactly what the pairs within the radius connect.
    """
    count = classes.count()
    width = 64 // (radius + 1)
    bits = min(width, max(0, int(np.ceil(np.log2(max(1, count) / cell_size)))))
    mask = (1 << bits) - 1
    cell = [F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit(mask).cast("long")).alias("cell")) for k in range(radius + 1)]
    members = classes.select("fp", F.bit_count("fp").cast("int").alias("pc"), F.explode(F.array(*cell)).alias("at")).select("fp", "pc", "at.band", "at.cell")
    sizes = members.groupBy("band", "cell", "pc").agg(F.count("*").alias("n"))
    large = (
        sizes.groupBy("band", "cell")
        .agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("pc", F.ceil(F.col("n") / cell_limit).cast("int")))).alias("tiles"))
        .filter(F.col("n") > cell_limit)
        .select("band", "cell", "tiles")
    )
    own = F.pmod(F.xxhash64("fp"), F.element_at("tiles", F.col("pc"))).cast("int")

    def pair(step):
        def with_tile(other):
            here = F.struct(F.col("pc").alias("pc"), own.alias("s"))
            there = F.struct((F.col("pc") + step).cast("int").alias("pc"), other.cast("int").alias("s"))
            return F.struct(F.least(here, there).alias("lo"), F.greatest(here, there).alias("hi"), (here > there).cast("int").alias("side"))

        return F.transform(F.sequence(F.lit(0), F.coalesce(F.element_at("tiles", (F.col("pc") + step).cast("int")), F.lit(1)) - 1), with_tile)

    steps = [F.when(F.map_contains_key("tiles", (F.col("pc") + d).cast("int")), pair(d)) for d in range(-radius, radius + 1)]
    nowhere = F.struct(F.lit(-1).alias("pc"), F.lit(-1).alias("s"))
    whole = F.array(F.struct(nowhere.alias("lo"), nowhere.alias("hi"), F.lit(0).alias("side")))
    pairs = F.flatten(F.filter(F.array(*steps), lambda x: x.isNotNull()))
    dealt = members.join(large, ["band", "cell"], "left").select("fp", "band", "cell", F.explode(F.when(F.col("tiles").isNull(), whole).otherwise(pairs)).alias("p")).select("fp", "band", "cell", "p.lo", "p.hi", "p.side")

    def link(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy(np.int64)
        crossed = key[2] != key[3]
        root, _, _ = link_tiles(fps, group["side"].to_numpy() if crossed else None, radius, tile)
        moved = root != fps
        return pd.DataFrame({"a": fps[moved], "b": root[moved]})

    key = [F.col("band"), F.col("cell"), F.concat_ws(",", "lo.pc", "lo.s").alias("l"), F.concat_ws(",", "hi.pc", "hi.s").alias("h")]
    return dealt.groupBy(*key).applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, cell_size: int = 2048, cell_limit: int = 16384) -> DataFrame:
    """One row for each row of ``docs``: (id_col, fingerprint, component_id).

    ``component_id`` is the smallest id reachable over links of ``radius`` bits
    or fewer, the row's own id included; rows of equal fingerprint are linked.

    Defined results: a null or empty text has fingerprint zero, linked like any
    other; a null id takes part, and its component has the smallest non-null id
    of its members, or null; repeated rows each stay; an empty table gives an
    empty result; other columns are ignored whatever their names.
    """
    fps = written(with_fingerprints(docs, id_col, text_col, width), "fps")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "classes")
    return grouped(fps, classes, near_links(classes, radius, cell_size, cell_limit), id_col)


def grouped(fps: DataFrame, classes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Rows (id, fp) with the component of their class: classes are (fp, first,
    copies), links (a, b) join two of them."""
    labels = components(links)  # (node, root) of linked fingerprints
    rooted = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = rooted.filter((F.col("copies") > 1) | F.col("root").isNotNull())
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component"), F.sum("copies").alias("size")).filter(F.col("size") > 1)
    mapped = rooted.join(smallest, "root").select("fp", "component")
    out = fps.join(mapped, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component", "id").alias("component_id"),
    )


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = resemblance.WIDTH, least: float = resemblance.LEAST) -> DataFrame:
    """(id_col, fingerprint, component_id) by the Jaccard similarity of word
    shingles: links join texts that reach ``least``, found by SimHash in
    :mod:`resemblance`. ``fingerprint`` is the hash of a text's words.

    Null and repeated ids, repeated rows and empty tables are as in
    :func:`near_duplicates`; texts without words form one group.
    """
    keyed = written(resemblance.with_keys(docs, id_col, text_col, width), "keys")
    same = keyed.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("sim").alias("sim"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = written(same, "classes")
    fps = written(keyed.select("id", "fp"), "fps")
    discard(keyed)
    return grouped(fps, classes.select("fp", "first", "copies"), resemblance.similar_links(docs, classes, text_col, width, least), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of :func:`similar`: that with the
    smallest id.

    All columns stay. Rows that repeat an id are copies of one document, of
    which the row with the smallest text stays. Rows with a null id cannot be
    told apart and all stay, but a document with an id is never dropped for one
    without. An empty table gives an empty result.
    """
    return first_of_each(docs, similar(docs, id_col, text_col, **options), id_col, text_col)


def first_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows whose id is that of their component. Rows without an id are passed
    by, so they meet in no task; texts are shuffled only where more than
    ``resemblance.BROADCAST`` ids are dropped, and reduced before that where ids
    repeat."""
    dropped = written(groups.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "dropped")
    few = F.broadcast(dropped) if dropped.count() <= resemblance.BROADCAST else dropped
    kept = docs.filter(F.col(id_col).isNotNull()).join(few, id_col, "left_anti").select(docs.columns)
    repeated = written(kept.groupBy(id_col).agg(F.count("*").alias(f"{OWN}n")).filter(F.col(f"{OWN}n") > 1).select(id_col), "repeated")
    n = repeated.count()
    if n:
        few = F.broadcast(repeated) if n <= resemblance.BROADCAST else repeated
        whole = F.struct(*[F.col(c) for c in docs.columns])
        first = kept.join(few, id_col, "left_semi").groupBy(id_col).agg(F.min_by(whole, F.struct(F.col(text_col).isNotNull(), F.col(text_col))).alias(f"{OWN}row")).select(f"{OWN}row.*")
        kept = kept.join(few, id_col, "left_anti").select(docs.columns).unionByName(first.select(docs.columns))
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
