"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target share over its actual share.
Each document's count is the inverse of the Poisson distribution with that
mean at a uniform number hashed from a seed and the document's identifier, so
counts do not depend on partitioning or on a run. Large means are cut into
parts of at most ``PART``, each inverted with a hash of its own: the sum of
independent Poisson counts is Poisson, and no term underflows.

All is built of DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.shared import OWN, parts_for

#: Largest mean that is inverted at once, and the terms of its distribution that are summed (the rest is below 2^-60).
PART, TERMS = 16, 96
#: Sources up to which the table of rates is broadcast: a few hundred bytes each.
BROADCAST_SOURCES = 10_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of its parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """Cumulative probabilities of a Poisson distribution with a mean up to PART."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc, k):
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: k.cast("double")), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, n, rate): rows and mean repetition rate of each source.

    Targets are ``weights`` (sources not named get weight zero) or, without
    them, each source's share to the power ``temperature``, both normalised
    over the sources there are. A null source is a source of its own. Weights
    that name no source at hand give the rate zero to all.
    """
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    weighed = counted.withColumn("weight", weight)
    rows, total = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = F.col("weight") / F.lit(total) if total > 0 else F.lit(0.0)
    return weighed.select("source", "n", (share * F.lit(rows) / F.col("n")).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str | None = "copy_no", key_col: str | None = "shuffle_key") -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in shuffled order.

    All columns stay; ``copy_col`` numbers the copies from 1 and ``key_col``
    holds the hash that rows are shuffled by: rows are dealt to partitions by
    it and sorted by it within each, so their order is random over the whole
    output and the same on every run with as many partitions. Pass None to
    leave either out.

    Defined results: null sources form one source, null ids hash as one id,
    repeated rows are repeated alike, an empty table gives an empty result. A
    column of the input named like a new one (in any case, as Spark compares
    names) makes way for it; to keep it, choose another name.
    """
    new = {c.lower() for c in (copy_col, key_col) if c}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in new])
    table = rates(docs, source_col, weights, temperature)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    table = table.withColumn(f"{OWN}parts", parts).withColumn(f"{OWN}steps", poisson_steps(F.col("rate") / F.col(f"{OWN}parts"))).select(F.col("source").alias(f"{OWN}source"), f"{OWN}parts", f"{OWN}steps")
    if table.select(f"{OWN}source").count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = docs.join(table, docs[source_col].eqNullSafe(F.col(f"{OWN}source")), "inner")
    draws = F.transform(F.sequence(F.lit(1), F.col(f"{OWN}parts")), lambda part: uniform(seed, F.col(id_col), part))
    count = F.aggregate(draws, F.lit(0), lambda total, u: total + F.size(F.filter(f"{OWN}steps", lambda c: c <= u)))
    counted = joined.withColumn(f"{OWN}count", count).filter(F.col(f"{OWN}count") > 0)
    copies = counted.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), F.col(f"{OWN}count"))))
    keyed = copies.withColumn(f"{OWN}key", F.md5(F.concat_ws("|", F.lit(f"{seed}:shuffle"), F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.col(f"{OWN}copy"))))
    n = parts_for(docs, text_col)
    dealt = keyed.repartition(n, f"{OWN}key").sortWithinPartitions(f"{OWN}key")
    extra = ([F.col(f"{OWN}copy").alias(copy_col)] if copy_col else []) + ([F.col(f"{OWN}key").alias(key_col)] if key_col else [])
    return dealt.select(*docs.columns, *extra)


def oracle(table: str = "documents", temperature: float = 0.5, seed: int = 7) -> str:
    """DuckDB SQL for ``mixed`` with temperature weights, without the order."""
    u = "(('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id AS VARCHAR), '~') || '|' || {part}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
    return f"""
WITH RECURSIVE counted AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {temperature}) AS weight FROM {table} GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM counted),
parted AS (SELECT source, greatest(1, ceil(rate / {PART}))::INT AS parts, rate / greatest(1, ceil(rate / {PART}))::INT AS mean FROM rates),
steps(source, parts, mean, k, p, c) AS (
  SELECT source, parts, mean, 0, exp(-mean), exp(-mean) FROM parted
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM steps WHERE k < {TERMS}),
lists AS (SELECT source, parts, list(c ORDER BY k) AS cs FROM steps GROUP BY source, parts),
counts AS (
  SELECT d.*, list_sum(list_transform(range(1, l.parts + 1), lambda part: len(list_filter(l.cs, lambda c: c <= {u.format(seed=seed, part="part")}))))::BIGINT AS copies
  FROM {table} d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source)
SELECT doc_id, text, lang, source, n_chars, copy_no::INT AS copy_no, md5('{seed}:shuffle|' || coalesce(cast(doc_id AS VARCHAR), '~') || '|' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy_no FROM counts WHERE copies > 0)"""
