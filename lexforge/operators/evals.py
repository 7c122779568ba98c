"""Retrieval metrics, rankings of search modes, and why queries fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.lexical import ranked


def metrics(results: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, recall, precision, mrr, n_results) of each query.

    ``results`` (query_id, rank, item), ``expected`` (query_id, item). A query
    that expects nothing has 1 for all; one without results has precision 0.
    """
    want = expected.select("query_id", "item").distinct()
    got = results.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    both = got.withColumn("_g", F.lit(1)).join(want.withColumn("_w", F.lit(1)), ["query_id", "item"], "full")
    met = F.col("_g").isNotNull() & F.col("_w").isNotNull()
    per = both.groupBy("query_id").agg(F.count("_w").alias("n_expected"), F.count("_g").alias("n_results"), F.count_if(met).alias("hits"), F.min(F.when(met, F.col("rank"))).alias("first"))
    all_ = queries.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n_expected", "n_results", "hits"])
    nothing = F.col("n_expected") == 0
    return all_.select(
        "query_id",
        F.when(nothing, 1.0).otherwise(F.col("hits") / F.col("n_expected")).alias("recall"),
        F.when(nothing, 1.0).when(F.col("n_results") == 0, 0.0).otherwise(F.col("hits") / F.col("n_results")).alias("precision"),
        F.when(nothing, 1.0).when(F.col("first").isNull(), 0.0).otherwise(1.0 / F.col("first")).alias("mrr"),
        "n_results", "n_expected",
    )


def mode_score(doc_recall, node_recall, precision, mrr, keyword=1.0, fallback=0.0, weak=0.0) -> Column:
    return 0.3 * doc_recall + 0.35 * node_recall + 0.15 * precision + 0.15 * mrr + 0.05 * keyword - 0.05 * fallback - 0.03 * weak


def benchmark_score(doc_recall, node_recall, precision, mrr, table=1.0, trace=1.0, fallback=0.0, weak=0.0) -> Column:
    return 0.25 * doc_recall + 0.35 * node_recall + 0.15 * precision + 0.1 * mrr + 0.1 * table + 0.05 * trace - 0.05 * fallback - 0.03 * weak


def mode_rankings(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Modes by score. ``per_query`` has mode, recall, precision, mrr and
    fallback (boolean) for each query; ``by`` adds keys such as the intent."""
    keys = by or []
    agg = per_query.groupBy(*keys, "mode").agg(F.count("*").alias("query_count"), *[F.avg(c).alias(c) for c in ("recall", "precision", "mrr")], F.avg(F.col("fallback").cast("double")).alias("fallback_rate"))
    scored = agg.withColumn("score", F.round(mode_score(F.col("recall"), F.col("recall"), F.col("precision"), F.col("mrr"), fallback=F.col("fallback_rate")), 6))
    place = scored.withColumn("_k", F.concat_ws("|", F.lit("all"), *keys))
    return ranked(place, 1 << 30, F.col("score").desc(), F.col("mode"), partition="_k").drop("_k")


def failure_reasons(items: DataFrame) -> DataFrame:
    """(query_id, reason): why a query's results fall short. ``items`` has
    recall, n_expected, n_results, fallback, weak_docs, mode, trace."""
    c = F.col
    reasons = F.array_compact(F.array(
        F.when((c("n_expected") > 0) & (c("recall") < 1), "doc_routing_miss"),
        F.when(c("n_results") == 0, "evidence_coverage_insufficient"),
        F.when(c("fallback"), "search_fallback"),
        F.when(c("weak_docs") > 0, "weak_parse_quality"),
        F.when((c("mode") == "tree") & (c("trace") < 0.75), "tree_trace_incomplete"),
        F.when(c("n_expected") == 0, "low_signal_eval_case"),
    ))
    return items.select("query_id", F.explode(reasons).alias("reason"))


#: What to do about a reason, in the words of a report.
ACTIONS = {
    "doc_routing_miss": "add abstract or keywords, or rebuild embeddings",
    "evidence_coverage_insufficient": "check the query's intent, the mode and the parsing",
    "search_fallback": "rebuild embeddings, or compare the modes",
    "weak_parse_quality": "parse the weak documents again",
    "tree_trace_incomplete": "check node summaries and weights",
    "low_signal_eval_case": "add expected documents or keywords",
}


def next_actions(reasons: DataFrame) -> DataFrame:
    counts = reasons.groupBy("reason").agg(F.count("*").alias("n"))
    action = F.lit(None).cast("string")
    for k, v in ACTIONS.items():
        action = F.when(F.col("reason") == k, v).otherwise(action)
    return counts.select("reason", "n", action.alias("action"))


def eval_suite(*sources: DataFrame, limit: int = 500) -> DataFrame:
    """Queries of several sources (query, intent, priority, position): of equal
    queries the first source's stays; at most ``limit`` (a report's length)."""
    rows = None
    for k, s in enumerate(sources):
        one = s.select(T.compact(T.text_of("query")).alias("query"), "intent", "position").withColumn("part", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    first = ranked(rows.filter("query <> ''").withColumn("_k", F.col("query")), 1, F.col("part"), F.col("position"), partition="_k")
    return first.orderBy("part", "position", "query").limit(limit).select("query", "intent", "part")
