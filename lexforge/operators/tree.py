"""Heading trees: blocks become nodes with parents, paths and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T

LEVELS = 6


def heading_kind(heading: Column) -> Column:
    flat = F.lower(F.regexp_replace(heading, r"(?U)\s+", ""))
    return F.when(flat.isin("摘要", "abstract"), "abstract").when(flat.isin("关键词", "关键字", "keywords", "keyword"), "keywords").when(flat.isin("参考文献", "references", "bibliography"), "reference").otherwise("section")


def line_kind(line: Column) -> Column:
    """heading, figure, table, reference or paragraph, by what a line looks like."""
    flat = T.compact(line)
    numbered = F.regexp_like(flat, F.lit(r"^(第[一二三四五六七八九十\d]+章|\d+(\.\d+){0,3}[ 　.、]\S|[一二三四五六七八九十]+、)")) & (F.length(flat) <= 96)
    return (
        F.when(F.regexp_like(flat, F.lit(r"^(?i)(图\s*\d+|fig(ure)?\.?\s*\d+)")), "figure")
        .when(F.regexp_like(flat, F.lit(r"^(?i)(表\s*\d+|table\s*\d+)")), "table")
        .when(F.regexp_like(flat, F.lit(r"^\[\d+\]")), "reference")
        .when(numbered | (F.lower(flat).isin("结论", "conclusion", "abstract", "摘要", "references", "参考文献")), "heading")
        .otherwise("paragraph")
    )


def heading_level(line: Column) -> Column:
    number = F.regexp_extract(T.compact(line), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(4))).otherwise(1)


def build_tree(blocks: DataFrame, size: int = 1800) -> DataFrame:
    """Nodes of blocks (doc_id, position, kind, level, heading, text[, title]).

    A heading's parent is the nearest heading before it of a lower level, found
    with one window for each level; a block's parent is the last heading. Text
    is cut into chunks. Returns (doc_id, order_index, node_id, parent_id, type,
    level, heading, text, path): ``path`` lists the ids from the root down.
    """
    rows = blocks.select("doc_id", "position", "kind", F.least(F.greatest("level", F.lit(1)), F.lit(LEVELS)).alias("level"), T.text_of("heading").alias("heading"), T.text_of("text").alias("text"))
    w = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    is_heading = F.col("kind") == "heading"
    last = {n: F.last(F.when(is_heading & (F.col("level") == n), F.col("position")), ignorenulls=True).over(w) for n in range(1, LEVELS + 1)}
    marked = rows.withColumns({f"_l{n}": c for n, c in last.items()})
    # a level's last heading is open unless a shallower heading came after it
    open_ = {n: F.when(reduce(lambda a, m: a & (F.coalesce(F.col(f"_l{m}"), F.lit(-1)) < F.col(f"_l{n}")), range(1, n), F.lit(True)), F.col(f"_l{n}")) for n in range(1, LEVELS + 1)}
    marked = marked.withColumns({f"_o{n}": c for n, c in open_.items()})
    limit = F.when(is_heading, F.col("level")).otherwise(LEVELS + 1)
    chain = F.array_compact(F.array(*[F.when(F.lit(n) < limit, F.col(f"_o{n}")) for n in range(1, LEVELS + 1)]))
    name = lambda p: F.concat_ws(":", F.col("doc_id").cast("string"), p.cast("string"))
    root = F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("root"))
    above = F.concat(F.array(root), F.transform(chain, name))
    made = marked.withColumn("_above", above)
    heads = made.filter(is_heading).select("doc_id", (F.col("position") * 10_000).alias("order_index"), name(F.col("position")).alias("node_id"), F.element_at("_above", -1).alias("parent_id"), heading_kind(F.col("heading")).alias("type"), F.size("_above").alias("level"), "heading", F.lit("").alias("text"), "_above")
    leaves = made.filter(~is_heading).select("doc_id", "position", "kind", "_above", F.posexplode(T.chunks(F.col("text"), size)).alias("part", "chunk"))
    leaves = leaves.select("doc_id", (F.col("position") * 10_000 + F.col("part") + 1).alias("order_index"), F.concat_ws(":", name(F.col("position")), F.col("part").cast("string")).alias("node_id"), F.element_at("_above", -1).alias("parent_id"), F.col("kind").alias("type"), F.size("_above").alias("level"), F.lit("").alias("heading"), F.col("chunk").alias("text"), "_above")
    roots = rows.select("doc_id").distinct().select("doc_id", F.lit(-1).alias("order_index"), root.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("type"), F.lit(0).alias("level"), F.lit("").alias("heading"), F.lit("").alias("text"), F.array().cast("array<string>").alias("_above"))
    both = roots.unionByName(heads).unionByName(leaves)
    return both.withColumn("path", F.concat("_above", F.array("node_id"))).drop("_above")


def summaries(nodes: DataFrame, words: int = 50) -> DataFrame:
    """(node_id, summary): a node without text is summed up by the first words
    of its children (their text, or heading) in order."""
    child = nodes.select(F.col("parent_id").alias("node_id"), "order_index", T.first_words(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("heading")), words).alias("t")).filter("node_id IS NOT NULL")
    # no child adds anything after `words` non-empty ones
    few = child.filter("t <> ''").withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("order_index"))).filter(F.col("r") <= words)
    joined = few.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "t"))), lambda x: x["t"]), " ").alias("t"))
    return nodes.select("node_id", "heading", "text").join(joined, "node_id", "left").select("node_id", F.when(F.col("text") != "", T.first_words(F.col("text"), words)).otherwise(F.coalesce(T.first_words(F.col("t"), words), F.col("heading"))).alias("summary"))


def subtree_max(nodes: DataFrame, value: str) -> DataFrame:
    """(node_id, best): the largest ``value`` of a node and all below it."""
    return nodes.select(F.explode("path").alias("node_id"), value).groupBy("node_id").agg(F.max(value).alias("best"))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, node_id) for every node below another."""
    return nodes.select(F.explode(F.slice("path", 1, F.greatest(F.lit(0), F.size("path") - 1))).alias("ancestor"), "node_id")


def node_scores(nodes: DataFrame, signals: DataFrame, profiles: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Ten components and their sum for each query's nodes.

    ``signals`` (query_id, node_id, rank, vector_score) names the candidates;
    ``profiles`` (query_id, intent, focus_terms, preferred_node_types,
    target_sections) are those of the queries; ``quality`` (doc_id,
    quality_level, page_only_tree, missing_abstract).
    """
    rows = signals.join(nodes, "node_id").join(profiles, "query_id")
    if quality is not None:
        rows = rows.join(quality, "doc_id", "left")
    heading = F.concat_ws(" ", "heading", F.coalesce(F.col("node_path") if "node_path" in nodes.columns else F.lit(""), F.lit("")))
    text = F.concat_ws(" ", heading, "text")
    hits, heads, sections = T.term_hits(F.col("focus_terms"), text), T.term_hits(F.col("focus_terms"), heading), T.term_hits(F.col("target_sections"), heading)
    q = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    parts = {
        "search_signal": F.coalesce(0.25 / F.sqrt("rank"), F.lit(0.0)),
        "vector_signal": F.least(F.lit(0.12), F.greatest(F.lit(0.0), F.coalesce("vector_score", F.lit(0.0))) * 0.12),
        "term_match": F.least(F.lit(0.34), hits * 0.04 + heads * 0.04),
        "intent_type": F.when(F.array_contains("preferred_node_types", F.col("type")), 0.14).otherwise(0.0),
        "section_match": F.least(F.lit(0.18), sections * 0.055),
        "heading_path_match": F.least(F.lit(0.12), heads * 0.035 + sections * 0.02),
        "leaf_bonus": F.when((F.col("text") != "") & ~F.col("type").isin("document", "page"), 0.06).otherwise(0.0),
        "memory_preference": F.coalesce(F.col("memory_boost"), F.lit(0.0)) if "memory_boost" in rows.columns else F.lit(0.0),
        "quality_penalty": (q(F.col("quality_level") == "weak", -0.05) + q(F.col("page_only_tree"), -0.04) + q(F.col("missing_abstract"), -0.015)) if quality is not None else F.lit(0.0),
        "noise_penalty": noise_penalty(F.col("type"), text, F.col("text"), F.col("intent")),
    }
    made = rows.withColumns(parts)
    return made.withColumn("score", reduce(lambda a, c: a + F.col(c), parts, F.lit(0.0))).select("query_id", "doc_id", "node_id", "parent_id", "order_index", "type", "text", *parts, "score")


def noise_penalty(type_: Column, whole: Column, text: Column, intent: Column) -> Column:
    flat = F.regexp_replace(whole, " ", "")
    short = (F.length(T.compact(text)).between(1, 6)) & ~type_.isin("keywords", "table", "figure")
    page = F.regexp_like(flat, F.lit(r"^\d+$")) | F.lower(flat).isin("no", "no.", "ra", "rb", "rc") | F.contains(F.lower(flat), F.lit("doi:")) | F.contains(flat, F.lit("版权所有"))
    return (
        F.when(type_ == "document", -0.2).when(type_ == "page", -0.08).otherwise(0.0)
        + F.when((type_ == "reference") & (intent != "citation"), -0.08).otherwise(0.0)
        + F.when(T.any_term(flat, ["目录", "学号", "指导教师", "分类号", "密级", "网络首发", "引用格式"]), -0.08).otherwise(0.0)
        + F.when(short, -0.05).otherwise(0.0)
        + F.when(page, -0.06).otherwise(0.0)
    )


def select_nodes(scored: DataFrame, budget: int | str = 8) -> DataFrame:
    """A diverse choice of up to ``budget`` nodes (a number, or a column that has
    it) for each query and document.

    In the order of their scores, the first half of the choice takes one node of
    each parent (nodes without a parent are never in each other's way), and the
    second half the best nodes with text that come after those. A group is the
    nodes of one document for one query.
    """
    import pandas as pd

    rows = scored.filter("type <> 'document'").select("query_id", "doc_id", "node_id", "parent_id", "order_index", "score", (F.col("text") == "").alias("bare"), (F.col(budget).cast("int") if isinstance(budget, str) else F.lit(budget)).alias("budget"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        budget = int(frame["budget"].iloc[0])
        half = max(2, budget // 2)
        frame = frame.assign(s=frame["score"].round(9)).sort_values(["s", "bare", "order_index", "node_id"], ascending=[False, True, True, True], ignore_index=True)
        if budget < 4:  # half of so small a budget is one node without text
            frame = frame[(frame.index == 0) | ~frame["bare"]]
        spread = frame[frame["parent_id"].isna() | ~frame["parent_id"].duplicated()].head(min(half, budget))
        later = frame[(frame.index > spread.index[-1]) & ~frame["bare"]].head(budget - half if len(spread) == half < budget else 0)
        out = pd.concat([spread, later])[["query_id", "doc_id", "node_id", "score"]]
        return out.assign(place=range(1, len(out) + 1))

    return rows.groupBy("query_id", "doc_id").applyInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, node_id {kinds['node_id']}, score double, place int")


def parse_quality(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Scores and level of each document: ``nodes`` (doc_id, type), ``metadata``
    (doc_id, title, authors, year, doi, abstract)."""
    kind = lambda k: F.count_if(F.col("type") == k)
    n = nodes.groupBy("doc_id").agg(kind("section").alias("sections"), kind("paragraph").alias("paragraphs"), kind("reference").alias("references"), kind("page").alias("pages"))
    both = n.join(metadata, "doc_id", "left")
    page_only = (F.col("sections") == 0) & (F.col("pages") > 0)
    have = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in ("title", "authors", "year", "doi", "abstract")]
    meta = reduce(lambda a, c: a + c.cast("int"), have, F.lit(0)) / 5.0
    structure = F.when(page_only, F.when(F.col("paragraphs") > 0, 0.25).otherwise(0.0)).when(F.col("sections") >= 4, 1.0).when(F.col("sections") >= 2, 0.75).when(F.col("paragraphs") > 0, 0.45).otherwise(0.0)
    refs = F.when(F.col("references") >= 10, 1.0).when(F.col("references") >= 3, 0.75).when(F.col("references") >= 1, 0.5).otherwise(0.0)
    total = 0.35 * meta + 0.45 * structure + 0.20 * refs
    level = F.when((total >= 0.78) & ~page_only & have[4], "good").when(total >= 0.45, "usable").otherwise("weak")
    warnings = F.array_compact(F.array(F.when(~have[4], "missing_abstract"), F.when(page_only, "page_only_tree"), F.when(F.col("references") == 0, "missing_references")))
    return both.select("doc_id", "sections", "paragraphs", "references", F.round(meta, 2).alias("metadata_score"), structure.alias("structure_score"), refs.alias("reference_score"), level.alias("quality_level"), page_only.alias("page_only_tree"), (~have[4]).alias("missing_abstract"), F.array_join(warnings, ",").alias("warnings"))


__all__ = ["build_tree", "descendants", "heading_kind", "heading_level", "line_kind", "node_scores", "noise_penalty", "parse_quality", "select_nodes", "subtree_max", "summaries"]
