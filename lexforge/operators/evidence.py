"""What is derived from nodes: layout, document cards, insights, evidence units
and frames, comparison matrices, review sections, compiled context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import evals, frames
from lexforge.operators.lexical import ranked

# Words that a section or an insight is told by.
CARD_TERMS = {
    "method_summary": ["method", "approach", "方法", "方法设计", "框架", "模型", "算法", "系统设计"],
    "innovation_summary": ["contribution", "innovation", "novel", "贡献", "创新", "提出", "研究内容"],
    "limitation_summary": ["limitation", "future", "局限", "不足", "未来", "结论"],
}
INSIGHT_VERBS = ["提出", "设计", "构建"]


def layout(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, position, kind, level, heading, text) with the headings
    they stand under: (doc_id, position, block_id, kind, text, section_path).

    A heading of level n ends all open ones of level n or more."""
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    level = F.greatest(F.lit(1), F.coalesce("level", F.lit(1)))
    head = F.col("kind") == "heading"
    last = {n: F.last(F.when(head & (level == n), F.struct("position", T.compact(T.text_of("heading")).alias("t"))), ignorenulls=True).over(w) for n in range(1, 7)}
    rows = blocks.withColumns({f"_h{n}": c for n, c in last.items()})
    open_ = [F.when(reduce(lambda a, m: a & (F.coalesce(F.col(f"_h{m}.position"), F.lit(-1)) < F.col(f"_h{n}.position")), range(1, n), F.lit(True)), F.col(f"_h{n}.t")) for n in range(1, 7)]
    text = T.compact(F.when(head, T.text_of("heading")).otherwise(T.text_of("text")))
    return rows.select("doc_id", "position", T.stable_id("block", F.col("doc_id"), F.col("position")).alias("block_id"), "kind", text.alias("text"), F.array_compact(F.array(*open_)).alias("section_path")).filter("text <> ''")


def contextual_kind(blocks: DataFrame) -> DataFrame:
    """Paragraphs below an abstract, keywords or references heading take its
    kind, until the next heading: the state is carried along by a window."""
    from lexforge.operators.tree import heading_kind

    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    under = F.last(F.when(F.col("kind") == "heading", heading_kind(T.text_of("heading"))), ignorenulls=True).over(w)
    kind = F.when((F.col("kind") == "paragraph") & under.isin("abstract", "keywords", "reference"), under).otherwise(F.col("kind"))
    return blocks.withColumn("kind", kind)


def references(blocks: DataFrame, most: int = 300) -> DataFrame:
    """(doc_id, ref_id, raw): lines of reference blocks, an entry starting at
    [n] or n., with the lines that go on with it; at most ``most`` a document."""
    lines = contextual_kind(blocks).filter("kind = 'reference'").select("doc_id", "position", F.posexplode(F.split(T.text_of("text"), "\n")).alias("line_no", "line")).withColumn("line", T.compact(F.col("line"))).filter("line <> ''")
    number = F.regexp_extract("line", r"^(?:\[(\d+)\]|(\d+)[.、)])", 0)
    w = Window.partitionBy("doc_id").orderBy("position", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    island = lines.withColumn("entry", F.sum((number != "").cast("int")).over(w)).filter("entry > 0 AND entry <= " + str(most))
    joined = island.groupBy("doc_id", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line_no", "line"))), lambda x: x["line"]), " ").alias("raw"))
    return joined.select("doc_id", F.concat(F.lit("ref_"), F.regexp_extract("raw", r"(\d+)", 1)).alias("ref_id"), "raw")


def doc_cards(nodes: DataFrame, limit: int = 220) -> DataFrame:
    """One row a document: description and, for each kind of section, the first
    text whose heading or self has one of its words."""
    rows = nodes.filter(T.text_of("text") != "").select("doc_id", "order_index", T.excerpt(F.col("text"), limit).alias("t"), F.lower(F.concat_ws(" ", "heading", "node_path", "text")).alias("hay"))
    first = lambda c: F.min(F.when(c, F.struct("order_index", "t")))["t"]
    quiet = F.size(T.noise_reasons(F.col("t"))) == 0
    return rows.groupBy("doc_id").agg(first(quiet).alias("description"), *[first(quiet & T.any_term(F.col("hay"), [t.lower() for t in terms])).alias(name) for name, terms in CARD_TERMS.items()]).fillna("")


def insight_nodes(nodes: DataFrame, tokens: list[str], n: int = 18) -> DataFrame:
    """The ``n`` best nodes of each document for insights: (doc_id, rank, node_id, score)."""
    t = T.text_of("text")
    score = F.when(F.col("type") == "abstract", 5).otherwise(0) + 3 * T.count_terms(t, tokens) + F.when(T.any_term(t, INSIGHT_VERBS), 2).otherwise(0) - F.when(F.length(t) < 40, 2).otherwise(0) - F.when(F.regexp_like(t, F.lit(r"(\.{4,}|…{2,})")), 5).otherwise(0)
    return ranked(nodes.select("doc_id", "node_id", "order_index", score.alias("score")), n, F.col("score").desc(), F.col("order_index"), F.col("node_id"), partition="doc_id").select("doc_id", "rank", "node_id", "score")


def evidence_units(nodes: DataFrame, limit: int = 360) -> DataFrame:
    """Units of evidence of nodes: (unit_id, doc_id, node_id, unit_type,
    source_kind, text_excerpt, keywords, confidence, warnings)."""
    kind = F.col("type")
    where = F.lower(F.concat_ws(" ", kind, "node_path", "heading"))
    has = lambda *words: T.any_term(where, list(words))
    known = kind.isin("abstract", "keywords", "reference", "figure", "table", "paragraph", "section", "subsection")
    unit = F.when(known, kind).when(has("reference", "参考文献", "引用"), "reference").when(has("figure", "fig.", "图 "), "figure").when(has("table", "表 "), "table").otherwise("paragraph")
    source = F.when(unit.isin("table", "figure", "reference"), unit).when(has("table", "表 "), "table").when(has("figure", "fig.", "图 "), "figure").when(has("reference", "参考文献", "引用"), "reference").otherwise("node")
    own = T.text_of("text")
    text = T.compact(F.when(own != "", own).otherwise(T.text_of("heading")))
    base = F.when(own != "", 0.78).otherwise(0.68)
    confidence = F.when(source.isin("table", "figure", "reference"), F.greatest(F.lit(0.62), base - 0.05)).otherwise(base)
    return nodes.filter(kind != "document").withColumn("_t", text).filter("_t <> ''").select(
        T.stable_id("eu", F.col("doc_id"), F.col("node_id"), unit, length=14).alias("unit_id"), "doc_id", "node_id", unit.alias("unit_type"), source.alias("source_kind"),
        T.excerpt(F.col("_t"), limit).alias("text_excerpt"), T.terms(F.col("_t"), cjk_min=None, limit=12).alias("keywords"), F.round(confidence, 3).alias("confidence"), F.when(own == "", "summary_only_unit").otherwise("").alias("warnings"),
    )


def claim_frames(claims: DataFrame, units: DataFrame) -> DataFrame:
    """Frames of claims, tied to the units of their node: fields are slotted by
    the claim's type; equal claims of a document give one frame, the first."""
    of = units.groupBy("node_id").agg(F.array_sort(F.collect_set("unit_id")).alias("units"))
    text = T.excerpt(F.col("text"), 240)
    slot = lambda *types: F.when(F.col("type").isin(*types), text).otherwise("")
    rows = claims.join(of, "node_id", "left").withColumn("units", F.slice(F.coalesce("units", F.array().cast("array<string>")), 1, 8))
    made = rows.select("doc_id", "node_id", "position", F.col("type").alias("claim_type"), text.alias("short_claim"), slot("problem", "limitation").alias("problem"), slot("method", "contribution").alias("method"), F.lit("").alias("dataset_or_setting"), F.lit("").alias("metric_or_signal"), slot("result").alias("result_or_gain"), slot("limitation", "future_work").alias("limitation"), F.col("units").alias("evidence_unit_ids"), "confidence")
    once = ranked(made.withColumn("_k", F.concat_ws("|", F.col("doc_id").cast("string"), "claim_type", T.normalize_key(F.col("short_claim")))), 1, F.col("position"), F.col("node_id"), partition="_k", name="_r").drop("_k", "_r")
    score = frames.quality_score(F.col("short_claim"), F.size("evidence_unit_ids"), F.lit("claim"), F.col("claim_type"), F.col("confidence"))
    scored = once.withColumn("frame_id", T.stable_id("cf", F.col("doc_id"), F.col("claim_type"), F.col("short_claim"))).withColumn("_score", score)  # a column, so that it is found once
    return scored.withColumn("quality_score", F.round("_score", 3)).withColumn("frame_quality", frames.quality_level(F.col("_score"))).drop("_score")


def trace_status(frames_: DataFrame, units: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(frame_id, trace_status, missing): whether the units that a frame names
    exist. Columns to ``keep`` come along, so that frames need not be joined again."""
    named = frames_.select("frame_id", *keep, F.explode_outer("evidence_unit_ids").alias("unit_id"))
    there = named.join(units.select("unit_id", F.lit(1).alias("ok")).distinct(), "unit_id", "left")
    per = there.groupBy("frame_id", *keep).agg(F.count("unit_id").alias("named"), F.count("ok").alias("found"))
    status = F.when(F.col("named") == 0, "unsupported").when(F.col("found") == F.col("named"), "structurally_supported").when(F.col("found") > 0, "unchecked").otherwise("unsupported")
    return per.select("frame_id", *keep, status.alias("trace_status"), (F.col("named") - F.col("found")).alias("missing"))


def comparison(grid: DataFrame) -> DataFrame:
    """What the documents of a dimension share: (dimension, documents,
    with_evidence, mean_confidence, synthesis) of a grid of cells."""
    some = F.count_if(F.col("n") > 0)
    return grid.groupBy("dimension").agg(F.count("*").alias("documents"), some.alias("with_evidence"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.when(some == 0, "no evidence").otherwise(F.concat(some.cast("string"), F.lit(" documents have evidence"))).alias("synthesis"))


def section_drafts(evidence: DataFrame, n: int = 8) -> DataFrame:
    """Drafts of review sections: evidence (section, doc_id, priority, item) is
    taken in turn from the documents, numbered [E1], [E2]... and set one
    paragraph each: (section, body, refs)."""
    from lexforge.operators.records import round_robin

    chosen = round_robin(evidence, n)
    line = F.struct("rank", F.concat(F.col("item").cast("string"), F.lit(" [E"), F.col("rank"), F.lit("]")).alias("t"), F.concat(F.lit("E"), F.col("rank")).alias("r"))
    per = chosen.groupBy("section").agg(F.array_sort(F.collect_list(line)).alias("l"))  # at most n of a section
    return per.select("section", F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("body"), F.transform("l", lambda x: x["r"]).alias("refs"))


def compiled_context(memories: DataFrame, most: int = 4000) -> DataFrame:
    """Chosen memories (scope, group, rank, content) as one text for each scope,
    cut to ``most`` characters."""
    per = memories.groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("group", "rank", T.excerpt(F.col("content"), 360).alias("t")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), F.coalesce(x["group"], F.lit("other")), F.lit("] "), x["t"])), "\n")
    return per.select("scope", F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text).alias("context"))


def tuned_profile(per_query: DataFrame) -> DataFrame:
    """(intent, mode): the best search mode of each intent, ties by name."""
    return evals.mode_rankings(per_query, ["intent"]).filter("rank = 1").select("intent", "mode", "score")


def case_nodes(results: DataFrame) -> DataFrame:
    """(node_id, modes): which modes found a node. ``results`` has mode, node_id."""
    return results.groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a hash of a corpus (path, hash) that does not depend on order.

    Sums of each file's hash stand for the sorted list, so that no task gets
    all paths."""
    part = lambda at: F.conv(F.substring(F.sha2(F.concat_ws("|", "path", "hash"), 256), at, 15), 16, 10).cast("decimal(38,0)")
    sums = files.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(1 + 15 * k)), F.lit(0)).alias(f"s{k}") for k in range(4)])
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "s0", "s1", "s2", "s3"), 256).alias("fingerprint"))


def eval_set_from_feedback(feedback: DataFrame, logs: DataFrame) -> DataFrame:
    """Queries of feedback that names what was expected, with the intent of the
    log it is about: (query, intent, expected_doc_ids)."""
    rows = feedback.filter(F.size("expected_doc_ids") > 0).join(logs.select("query_id", "intent", F.col("query").alias("logged")), "query_id", "left")
    asked = F.when(T.text_of("query") != "", T.text_of("query")).otherwise(T.text_of("logged"))
    return rows.select(asked.alias("query"), F.coalesce("intent", F.lit("")).alias("intent"), "expected_doc_ids").filter("query <> ''")


def quality_baseline(docs: DataFrame, facts: DataFrame, quality: DataFrame, by: Column | None = None) -> DataFrame:
    """A report by source: documents, weak ones, facts a document, and what to do."""
    n = facts.groupBy("doc_id").agg(F.count("*").alias("n_facts"))
    rows = docs.join(n, "doc_id", "left").join(quality.select("doc_id", "quality_level"), "doc_id", "left").fillna(0, ["n_facts"])
    weak = F.count_if(F.col("quality_level") == "weak")
    out = rows.groupBy((by if by is not None else F.col("source")).alias("source")).agg(F.count("*").alias("documents"), weak.alias("weak_documents"), F.sum("n_facts").alias("facts"), F.count_if(F.col("n_facts") == 0).alias("without_facts"))
    advice = F.array_join(F.array_compact(F.array(F.when(F.col("weak_documents") * 2 > F.col("documents"), "parse again"), F.when(F.col("without_facts") > 0, "extract facts"))), ",")
    return out.withColumn("advice", advice)
