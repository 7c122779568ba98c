"""Query logs, feedback, memory, versions: records in tables of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import frame_terms as C
from lexforge.functions import text as T
from lexforge.operators.lexical import ranked


def since(rows: DataFrame, days: float, now: Column, column: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` before ``now``."""
    return rows.filter(F.col(column) >= now - F.make_interval(secs=F.lit(days * 86400)))


def query_stats(logs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of logs (status, latency_ms, warnings, evidence_count)."""
    fallback = F.exists("warnings", lambda w: F.contains(w, F.lit("fallback")))
    nothing = (F.col("evidence_count") == 0) | F.array_contains("warnings", "no_tree_evidence") | F.array_contains("warnings", "no_search_results")
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    return logs.groupBy(*(by or [])).agg(
        F.count("*").alias("query_count"),
        F.round(F.avg("latency_ms"), 3).alias("avg_latency_ms"),
        rate(F.col("status") == "failed").alias("failure_rate"),
        rate(F.coalesce(fallback, F.lit(False))).alias("fallback_rate"),
        rate(F.coalesce(nothing, F.lit(False))).alias("no_evidence_rate"),
    )


def top_counts(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values of an array column (ties by value)."""
    counts = rows.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), "value").limit(n)


def feedback_summary(feedback: DataFrame, by: list[str]) -> DataFrame:
    """Number, average and low ratings of feedback (rating 1 to 5)."""
    rated = F.when(F.col("rating") > 0, F.col("rating"))
    return feedback.groupBy(*by).agg(F.count("*").alias("feedback_count"), F.round(F.avg(rated), 3).alias("avg_rating"), F.count_if(rated <= 2).alias("low_rating_count"))


def valid_feedback(rating: Column, comment: Column, limit: int = 600) -> Column:
    """struct(accepted, comment): ratings from 1 to 5; comments with a path, a
    link or a long hex string are refused, long ones cut."""
    text = T.compact(T.text_of(comment))
    private = F.regexp_like(text, F.lit(r"(?i)(https?://|[a-z]:\\|/home/|/users/|api[_-]?key|password|secret|token=|[0-9a-f]{32,})"))
    return F.struct((rating.between(1, 5) & ~private).alias("accepted"), F.when(private, "").otherwise(T.excerpt(text, limit)).alias("comment"))


SECRET_KEYS = ["text", "content", "prompt", "answer", "excerpt", "snippet", "body", "api_key", "authorization"]


def sanitize(metrics: Column, limit: int = 500) -> Column:
    """A flat map without private keys, values cut."""
    return F.transform_values(F.map_filter(metrics, lambda k, v: ~F.lower(k).isin(SECRET_KEYS)), lambda k, v: F.substring(v, 1, limit))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row of each key, in a total order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def alive(memories: DataFrame, now: Column) -> DataFrame:
    """Memories without an expiry, or whose expiry is to come."""
    return memories.filter(F.col("ttl").isNull() | (F.col("ttl") > now))


def gate(kind: Column, content: Column, confidence: Column, force: Column, allowed: list[str], asset_terms: list[str]) -> Column:
    """Why a memory is taken or not, in order of the rules."""
    n = F.length(content)
    return (
        F.when(force, "force")
        .when(confidence < 0.45, "low_confidence")
        .when(~kind.isin(allowed), "unsupported_memory_type")
        .when(T.count_terms(content, asset_terms) >= 2, "paper_asset_boundary")
        .when((kind == "failure") & (n > 600), "failure_memory_too_long")
        .when((n > 1200) & (kind != "project_rule"), "content_too_long")
        .otherwise("allowed_memory")
    )


def merged_content(old: Column, new: Column) -> Column:
    a, b = T.compact(T.text_of(old)), T.compact(T.text_of(new))
    return F.when(a == "", b).when((b == "") | F.contains(a, b), a).when(F.contains(b, a), b).otherwise(F.concat(a, F.lit("\n"), b))


def memory_score(found: Column, task: Column | None = None) -> Column:
    """2 importance + confidence + up to 2 for terms + 1 for the task + the kind's bonus."""
    hay = F.lower(F.concat_ws(" ", "scope", "type", "subject_key", "content"))
    hits = F.size(F.filter(found, lambda t: F.contains(hay, F.lower(t))))
    bonus = reduce(lambda rest, k: F.when(F.col("type") == k, C.MEMORY_BONUS[k]).otherwise(rest), C.MEMORY_BONUS, F.lit(0.0))
    mine = F.when(F.contains(F.concat_ws(" ", "refs", "content", "subject_key"), task), 1.0).otherwise(0.0) if task is not None else F.lit(0.0)
    return 2.0 * F.coalesce("importance", F.lit(0.5)) + F.coalesce("confidence", F.lit(1.0)) + F.least(F.lit(2.0), 0.35 * hits) + bonus + mine


def select_memories(memories: DataFrame, query: str, k: int = 8, by: str = "scope") -> DataFrame:
    """The ``k`` best memories of each ``by`` for a query, with their group."""
    found = T.terms(F.lit(query), cjk_min=4, limit=16)
    scored = memories.withColumn("score", F.round(memory_score(found), 6))
    best = ranked(scored, k, F.col("score").desc(), F.col("memory_id"), partition=by)
    group = F.when(F.col("type") == "failure", "negative_memories").when(F.col("type") == "project_rule", "project_rules").when(F.col("type").isin("task_progress", "next_action"), "task_progress").when(F.col("type").isin("preference", "setting", "default"), "preferences")
    return best.withColumn("group", group)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with rows of ``incoming`` in place of those of equal key."""
    return existing.join(incoming.select(*keys), keys, "left_anti").select(existing.columns).unionByName(incoming.select(existing.columns))


def sync_plan(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do about each file (path, hash, parser): indexed, skipped or gone."""
    now = incoming.select("path", F.col("hash").alias("new_hash"), F.col("parser").alias("new_parser"))
    was = existing.select("path", F.col("hash").alias("old_hash"), F.col("parser").alias("old_parser"))
    same = (F.col("new_hash") == F.col("old_hash")) & (F.col("new_parser") == F.col("old_parser"))
    action = F.when(F.col("new_hash").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "skipped").otherwise("indexed")
    return now.join(was, "path", "full_outer").select("path", action.alias("action"))


def round_robin(evidence: DataFrame, n: int = 8, keys: list[str] | None = None) -> DataFrame:
    """Up to ``n`` rows of each section, one document after the other: every
    document's best first, then every second best, documents in order.

    ``evidence`` has section, doc_id, priority, item. Repeated items of a
    document count once, with the highest priority."""
    once = evidence.groupBy("section", "doc_id", *(keys or ["item"])).agg(F.max("priority").alias("priority"))
    place = once.withColumn("turn", F.row_number().over(Window.partitionBy("section", "doc_id").orderBy(F.col("priority").desc(), *(keys or ["item"]))))
    # no document can give more than n rows, so only those go to the section
    return ranked(place.filter(F.col("turn") <= n), n, F.col("turn"), F.col("doc_id"), partition="section")


def paragraph_support(drafts: DataFrame) -> DataFrame:
    """Coverage of each section of a draft (section, body, refs): paragraphs
    that need a reference have one or not; references that are missing cost
    0.1 each, up to 0.5."""
    body = T.text_of("body")
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n+"), T.compact), lambda p: (F.length(p) >= 25) & ~p.startswith("#"))
    named = F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[(E\d+)\]"), F.lit(1)))
    rows = drafts.select("section", parts.alias("p"), named.alias("named"), "refs")
    bare = F.size(F.filter("p", lambda x: ~F.regexp_like(x, F.lit(r"\[E\d+\]"))))
    missing = F.size(F.array_except("named", "refs"))
    base = F.when(F.size("p") == 0, 1.0).otherwise((F.size("p") - bare) / F.size("p"))
    out = rows.select("section", F.size("p").alias("paragraphs"), bare.alias("unsupported"), missing.alias("missing_refs"), F.size(F.array_except("refs", "named")).alias("unused_refs"), F.greatest(F.lit(0.0), base - F.least(F.lit(0.5), 0.1 * missing)).alias("coverage"))
    level = F.when((F.col("missing_refs") > 0) | (F.col("unsupported") > 0) | (F.col("coverage") < 0.5), "weak").when((F.col("unused_refs") > 0) | (F.col("coverage") < 0.9), "usable").otherwise("good")
    return out.withColumn("level", level)


def dimension_grid(dimensions: DataFrame, docs: DataFrame, evidence: DataFrame, cap: int = 4) -> DataFrame:
    """A cell for each dimension and document: how much evidence it has (at most
    ``cap`` counts) and how sure it is. Dimensions are a stated list (at most
    100), so a document takes one row for each."""
    names = [r[0] for r in dimensions.select("dimension").distinct().orderBy("dimension").limit(101).collect()]
    if len(names) > 100:
        raise ValueError("at most 100 dimensions")
    cells = docs.select("doc_id", F.explode(T.lit_array(names)).alias("dimension"))
    n = evidence.groupBy("doc_id", "dimension").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    out = cells.join(n, ["doc_id", "dimension"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("confidence", F.when(F.col("n") >= 3, 0.75).when(F.col("n") >= 1, 0.6).otherwise(0.25))
