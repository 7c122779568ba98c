"""Two states of a corpus compared by digests of hash ranges.

Documents fall into ranges by the hash of their path. Ranges of a level are
digested, and only those that differ are looked at on the next, finer level;
rows are compared in the ranges of the last level that still differ. Digests are
sums over documents, so they are combined before they are shuffled and do not
depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the hash that tell the ranges of each level apart.
LEVELS = (4, 8, 12)


def bucket(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("path"), 64 - bits)


def digests(files: DataFrame, bits: int) -> DataFrame:
    """(range, n, a, b): how many files (path, hash) a range has, and two sums."""
    part = lambda seed: F.xxhash64(F.lit(seed), "path", "hash").cast("decimal(38,0)")
    return files.groupBy(bucket(bits).alias("range")).agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(2)).alias("b"))


def differing(old: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """(range): ranges whose digests are not the same on both sides."""
    left, right = digests(old, bits), digests(new, bits)
    both = left.withColumnRenamed("n", "n1").withColumnRenamed("a", "a1").withColumnRenamed("b", "b1").join(right, "range", "full")
    same = F.col("n1").eqNullSafe(F.col("n")) & F.col("a1").eqNullSafe(F.col("a")) & F.col("b1").eqNullSafe(F.col("b"))
    return both.filter(~same).select("range")


def narrowed(old: DataFrame, new: DataFrame, levels=LEVELS) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Both sides cut to the ranges that differ at the finest level, and what
    each level read and left: (level, ranges, differing)."""
    if any(bits > 16 for bits in levels):  # so that at most 65,536 numbers are collected and broadcast
        raise ValueError("a level has at most 16 bits")
    seen = []
    for bits in levels:
        ranges = [r[0] for r in differing(old, new, bits).collect()]
        seen.append({"bits": bits, "ranges": 1 << bits, "differing": len(ranges)})
        keep = old.sparkSession.createDataFrame([(r,) for r in ranges], "range long")
        cut = lambda side, bits=bits, keep=keep: side.withColumn("_r", bucket(bits)).join(F.broadcast(keep), F.col("_r") == F.col("range"), "left_semi").drop("_r")
        old, new = cut(old), cut(new)
    return old, new, seen


def compared(old: DataFrame, new: DataFrame, levels=LEVELS) -> DataFrame:
    """(path, change): added, removed and changed files (path, hash) between two
    snapshots; paths are unique in each. Equal files are not listed."""
    left, right, _ = narrowed(old, new, levels)
    both = left.select("path", F.col("hash").alias("_was")).join(right.select("path", F.col("hash").alias("_is")), "path", "full")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed").otherwise("changed")
    return both.filter(~F.col("_was").eqNullSafe(F.col("_is"))).select("path", change.alias("change"))


def stale(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason): artifacts (path, hash, version) that no longer go with
    their file (path, hash, version): it is gone, or its content or the version
    of its parser is another."""
    now = files.select("path", F.col("hash").alias("_h"), F.col("version").alias("_v"), F.lit(True).alias("_there"))
    both = artifacts.join(now, "path", "left")
    reason = F.when(F.col("_there").isNull(), "missing_source").when(~F.col("hash").eqNullSafe(F.col("_h")), "content_changed").when(~F.col("version").eqNullSafe(F.col("_v")), "parser_changed")
    return both.withColumn("reason", reason).filter("reason IS NOT NULL").select("path", "reason")


def read_share(old: DataFrame, new: DataFrame, levels=LEVELS) -> DataFrame:
    """(bits, ranges, differing): what each level had to look at."""
    _, _, seen = narrowed(old, new, levels)
    return old.sparkSession.createDataFrame([(s["bits"], s["ranges"], s["differing"]) for s in seen], "bits int, ranges long, differing long")
