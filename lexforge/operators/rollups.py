"""Totals at several levels from one scan: grouping sets over mergeable states.

Rows bring counts, scores and warnings; every level is summed up from the same
partial states (counts, sums and maxima), so adding a level adds rows to the
shuffle, never a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.lexical import ranked

#: Counts of an answer plan's buckets.
BUCKETS = ["strong", "qualified", "related", "conflicting", "insufficient", "unchecked"]


def levels(rows: DataFrame, keys: list[str], *aggregates) -> DataFrame:
    """``aggregates`` for all rows, for each value of the first key, of the first
    two, and so on: the keys, ``level`` (how many of them are set) and the
    aggregates. Keys that a level leaves out are null, so are null keys: the
    level tells them apart."""
    out = rows.rollup(*keys).agg(*aggregates, F.grouping_id().alias("_g"))
    unset = F.bit_count("_g").cast("int")
    return out.withColumn("level", F.lit(len(keys)) - unset).drop("_g")


def answer_plans(plans: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up of answer plans (keys, answerability, warnings, and counts named
    as ``BUCKETS``): plans, sums of the buckets, and how many plans are of each
    answerability, as ``name:count`` in the order of names."""
    filled = plans.withColumn("answerability", F.coalesce(F.nullif(F.col("answerability"), F.lit("")), F.lit("insufficient_evidence")))
    kinds = ["answerable", "conflicting", "insufficient_evidence", "partially_answerable"]
    sums = [F.sum(F.coalesce(b, F.lit(0))).cast("long").alias(b) for b in BUCKETS]
    made = levels(filled, keys, F.count("*").alias("plans"), *sums, *[F.count_if(F.col("answerability") == k).alias(f"_{k}") for k in kinds])
    text = F.concat_ws(",", *[F.when(F.col(f"_{k}") > 0, F.concat(F.lit(f"{k}:"), F.col(f"_{k}").cast("string"))) for k in kinds])
    return made.withColumn("answerability_counts", text).drop(*[f"_{k}" for k in kinds])


def warnings(plans: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """(keys, level, rank, warning, n): the ``k`` most frequent warnings at each
    level; a warning counts by what stands before its colon. ``plans`` has a list
    ``warnings``."""
    each = plans.select(*keys, F.explode("warnings").alias("w")).select(*keys, F.substring_index("w", ":", 1).alias("warning")).filter("warning <> ''")
    counted = each.groupBy(*keys, "warning").agg(F.count("*").alias("n"))
    # the warning is a key at every level
    sets = levels(counted.withColumnRenamed("warning", "_w"), ["_w", *keys], F.sum("n").alias("n")).filter("level > 0").withColumn("level", F.col("level") - 1)
    group = F.to_json(F.struct("level", *keys), {"ignoreNullFields": "false"})
    return ranked(sets.withColumn("_at", group), k, F.col("n").desc(), F.col("_w"), partition="_at").select(*keys, "level", "rank", F.col("_w").alias("warning"), "n")


def alignments(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up of alignment groups (keys, claims, documents, conflicting, score):
    groups, claims, conflicting groups, groups of one document (gaps), and the
    mean and the largest score."""
    return levels(
        groups, keys, F.count("*").alias("groups"), F.sum("claims").alias("claims"), F.count_if("conflicting").alias("conflicting_groups"), F.count_if(F.col("documents") == 1).alias("gaps"),
        F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.max("score"), 6).alias("max_score"),
    )
