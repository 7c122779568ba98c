"""Facts: claims, entities and relations in one shape; extraction, merging,
search, coverage and audit.

A fact row is (fact_id, fact_type, doc_id, node_id, type, text, subject_name,
object_name, normalized_key, confidence, source, position). ``position`` gives
the order in which facts came, which first-wins rules go by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.containment import contained
from lexforge.operators.lexical import ranked

COLUMNS = ["fact_id", "fact_type", "doc_id", "node_id", "type", "text", "subject_name", "object_name", "normalized_key", "confidence", "source", "position"]


def first_match(c: Column, kinds: dict[str, list[str]], otherwise: str) -> Column:
    """The first kind, in order, of which a term occurs."""
    return reduce(lambda rest, k: F.when(T.any_term(c, kinds[k]), k).otherwise(rest), reversed(list(kinds)), F.lit(otherwise))


def claims(sentences: DataFrame, kinds: dict[str, list[str]], confidence: Column, source: Column, more: tuple[str, ...] = ()) -> DataFrame:
    """Claims of sentences (doc_id, node_id, position, sentence); columns ``more``
    go along."""
    text = T.excerpt(F.col("sentence"), 420, " ...")
    kind = first_match(F.col("sentence"), kinds, "claim")
    rows = sentences.select("doc_id", "node_id", "position", text.alias("text"), kind.alias("type"), confidence.alias("confidence"), source.alias("source"), *more)
    key = F.substring(T.normalize_key(F.col("text")), 1, 120)
    return _shaped(rows.withColumn("normalized_key", key), "claim", more)


def entities(nodes: DataFrame, known: dict[str, list[str]], patterns: dict[str, str], source: Column, known_confidence: float = 0.62, pattern_confidence: float = 0.56) -> DataFrame:
    """Entities of nodes (doc_id, node_id, order_index, text): dictionary terms
    that occur, and matches of patterns."""
    return listed_entities(nodes, entity_list(F.col("text"), known, patterns, known_confidence, pattern_confidence), source)


def entity_list(text: Column, known: dict[str, list[str]], patterns: dict[str, str], known_confidence: float = 0.62, pattern_confidence: float = 0.56) -> Column:
    """The entities of a text, as an array of (type, name, confidence, at)."""
    found = []
    for n, (kind, terms) in enumerate(known.items()):
        some = F.filter(T.lit_array(terms), lambda t: F.contains(text, t))
        found.append(_numbered(some, kind, known_confidence, 1000 * (n + 1)))
    for n, (kind, pattern) in enumerate(patterns.items()):
        some = T.matches(text, pattern)
        found.append(_numbered(some, kind, pattern_confidence, 100_000 * (n + 1)))
    return F.concat(*found)


def listed_entities(nodes: DataFrame, found: Column, source: Column) -> DataFrame:
    """Entities of nodes (doc_id, node_id, order_index) that lie in an array."""
    rows = nodes.select("doc_id", "node_id", source.alias("source"), "order_index", F.explode(found).alias("e"))
    rows = rows.select("doc_id", "node_id", (F.col("order_index").cast("long") * 10_000_000 + F.col("e.at")).alias("position"), F.col("e.name").alias("text"), "e.type", "e.confidence", "source")
    return _shaped(rows.withColumn("normalized_key", T.normalize_key(F.col("text"))), "entity")


def _numbered(names: Column, kind: str, confidence: float, start: int) -> Column:
    return F.transform(names, lambda t, i: F.struct(F.lit(kind).alias("type"), t.alias("name"), F.lit(confidence).alias("confidence"), (F.lit(start) + i).alias("at")))


def _shaped(rows: DataFrame, fact_type: str, more: tuple[str, ...] = ()) -> DataFrame:
    made = rows.withColumn("fact_type", F.lit(fact_type)).withColumn("fact_id", T.stable_id(fact_type, F.col("doc_id"), F.col("node_id"), F.col("type"), F.col("text"), F.col("position")))
    for c in ("subject_name", "object_name"):
        if c not in rows.columns:
            made = made.withColumn(c, F.lit(""))
    return made.select(*COLUMNS, *more)


def mentions(claim_rows: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """Relations uses / limits: claims and the entities of the same node whose
    name they contain."""
    left = claim_rows.select("doc_id", "node_id", F.col("fact_id").alias("subject_name"), F.col("text").alias("claim"), F.col("type").alias("kind"), "source", "position")
    right = entity_rows.select("node_id", F.col("text").alias("object_name")).distinct()
    return _mentions(left.join(right, "node_id").filter(F.contains("claim", F.col("object_name"))))


def mentions_within(claim_rows: DataFrame) -> DataFrame:
    """The same of claims that bring along the different names of their node's
    entities (``names``): no join."""
    named = F.filter("names", lambda n: F.contains(F.col("text"), n))
    return _mentions(claim_rows.filter(F.size("names") > 0).select("doc_id", "node_id", F.col("fact_id").alias("subject_name"), F.col("type").alias("kind"), "source", "position", F.explode(named).alias("object_name")))


def _mentions(both: DataFrame) -> DataFrame:
    rows = both.select("doc_id", "node_id", "position", F.concat_ws(" ", "subject_name", "object_name").alias("text"), F.when(F.col("kind") == "limitation", "limits").otherwise("uses").alias("type"), F.lit(0.56).alias("confidence"), "source", "subject_name", "object_name")
    return _shaped(rows.withColumn("normalized_key", F.concat_ws("->", T.normalize_key(F.col("subject_name")), T.normalize_key(F.col("object_name")))), "relation")


def noisy_entity(name: Column, kind: Column) -> Column:
    """Whether a name is too short, too long or sentence-like for an entity."""
    bare = F.regexp_replace(T.compact(name), r"^[ ,，.。;；:：()（）\[\]【】]+|[ ,，.。;；:：()（）\[\]【】]+$", "")
    return T.let(bare, lambda text: _noisy(text, kind))


def _noisy(text: Column, kind: Column) -> Column:
    ideographs = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    named = F.regexp_like(text, F.lit("(方法|算法|模型|框架|系统|平台|数据集|指标|任务|场景|机制|模块)$"))
    always = (text == "") | F.lower(text).isin("no", "no.", "ra", "rb", "rc", "rd") | F.regexp_like(text, F.lit(r"^(?:[A-Za-z]{1,2}\.?|\d+)$"))
    wordy = T.any_term(text, ["则", "并", "以及", "进行", "涵盖", "包括", "通过", "用于"])
    others = (F.length(text) < 2) | F.regexp_like(text, F.lit(r"[。！？!?；;\n]")) | (F.contains(text, F.lit("、")) & (F.length(text) > 12)) | ((ideographs > 24) & ~named) | ((F.length(text) > 18) & wordy & ~named)
    return always | (~kind.isin("metric", "result", "dataset", "citation") & others)


def deduped(facts: DataFrame) -> DataFrame:
    """One fact for each (doc_id, fact_type, type, key): the first one's id, the
    payload of the most confident (ties to the earlier), all sources and how
    many were merged. Facts without a key go. Citations also keep their node."""
    node = F.when(F.col("type").isin("cites", "citation"), F.col("node_id")).otherwise("")
    keyed = facts.filter(F.col("normalized_key") != "").withColumn("_node", node)
    best = F.struct(F.col("confidence"), (-F.col("position")).alias("p"), F.col("fact_id").alias("i"))
    return keyed.groupBy("doc_id", "fact_type", "type", "normalized_key", "_node").agg(
        F.min(F.struct("position", "fact_id"))["fact_id"].alias("fact_id"),
        F.max_by("text", best).alias("text"),
        F.max_by("node_id", best).alias("node_id"),
        F.max("confidence").alias("confidence"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count("*").alias("merged"),
    ).drop("_node")


def search(queries: DataFrame, facts: DataFrame, k: int = 20, *, fact_type: str | None = None, source: str = "all", min_confidence: float = 0.0) -> DataFrame:
    """Facts that contain a query's terms: (query_id, rank, fact_id, score).

    A fact is a hit if a term occurs without regard to case; its score counts
    the terms that occur as they are spelled, so it may be 0.
    """
    rows = facts.filter(F.col("fact_type") == fact_type) if fact_type else facts
    table = F.contains(F.lower("source"), F.lit("table"))
    rows = rows.filter(table) if source == "table" else rows.filter(~table) if source == "text" else rows
    rows = rows.filter(F.col("confidence") >= min_confidence) if min_confidence > 0 else rows
    hay = F.concat_ws(" ", "text", "subject_name", "object_name")
    wanted = queries.select("query_id", F.explode(T.fact_terms(T.text_of("query"))).alias("as_is")).withColumn("term", F.lower("as_is"))
    hits = contained(rows.select("fact_id", hay.alias("own"), F.lower(hay).alias("hay")), wanted)
    scored = wanted.join(hits, "term").groupBy("query_id", "fact_id").agg(F.sum(F.contains("own", F.col("as_is")).cast("int")).alias("score"))
    return ranked(scored, k, F.col("score").desc(), F.col("fact_id")).select("query_id", "rank", "fact_id", "score")


def coverage(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of facts by kind, confidence, evidence and source."""
    table = F.contains(F.lower("source"), F.lit("table"))
    total = F.count("*")
    return facts.groupBy(*(by or [])).agg(
        *[F.count_if(F.col("fact_type") == kind).alias(f"{kind}_count") for kind in ("claim", "entity", "relation")],
        F.count_if(F.col("confidence") < 0.5).alias("low_confidence_count"),
        F.count_if(T.text_of("node_id") == "").alias("no_evidence_count"),
        F.count_if(table).alias("table_backed_fact_count"),
        F.count_if(~table).alias("text_backed_fact_count"),
        total.alias("total_fact_count"),
        F.round(F.count_if(table) / F.greatest(total, F.lit(1)), 4).alias("table_backed_fact_rate"),
    )


def duplicate_groups(facts: DataFrame, sample: int = 8, empty_keys: bool = False) -> DataFrame:
    """Facts of one document, kind, type and key that occur more than once: the
    key, how often, and the first ``sample`` ids in order."""
    node = F.when(F.col("type").isin("cites", "citation"), F.col("node_id")).otherwise("")
    rows = facts if empty_keys else facts.filter(F.col("normalized_key") != "")
    keyed = rows.withColumn("_node", node)
    # one window gives both the place of an id and the size of its group; only ids that can be among the first are gathered
    keys = ["doc_id", "fact_type", "type", "normalized_key", "_node"]
    group = Window.partitionBy(*keys).orderBy("fact_id")
    placed = keyed.select(*keys, "fact_id", F.row_number().over(group).alias("r"), F.lead("fact_id").over(group).isNotNull().alias("more"))
    # a group's last place is its size
    firsts = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= sample, F.col("fact_id")))), ",")
    return placed.filter("r > 1 OR more").groupBy(*keys).agg(F.max("r").cast("long").alias("count"), firsts.alias("fact_ids")).drop("_node")


def polarity(c: Column, positive: list[str], negative: list[str]) -> Column:
    """Which kind of term comes first; neutral if there is neither."""

    def first(terms):
        at = F.filter(F.transform(T.lit_array(terms), lambda t: F.instr(c, t)), lambda p: p > 0)
        return F.array_min(at)

    p, n = first(positive), first(negative)
    return F.when(p.isNull() & n.isNull(), "neutral").when(n.isNull() | (p < n), "positive").otherwise("negative")


def conflicts(facts: DataFrame) -> DataFrame:
    """Pairs of facts of opposite polarity on one anchor.

    ``facts`` has fact_id, doc_id, source, confidence, polarity and anchors.
    Pairs of one document count only between a table and a text source. The
    join is on the anchor and pairs positive with negative facts, never equal
    ones; :func:`conflict_counts` counts them without making them.
    """
    rows = facts.filter("polarity <> 'neutral'").select("fact_id", "doc_id", "confidence", "polarity", F.contains(F.lower("source"), F.lit("table")).alias("table"), F.explode(F.array_distinct("anchors")).alias("anchor"))
    side = lambda s, p: rows.filter(F.col("polarity") == p).select("anchor", *[F.col(c).alias(f"{s}_{c}") for c in ("fact_id", "doc_id", "confidence", "table")])
    both = side("positive", "positive").join(side("negative", "negative"), "anchor").filter("positive_fact_id <> negative_fact_id")
    same = F.col("positive_doc_id") == F.col("negative_doc_id")
    kind = F.when(same, "table_text_mismatch").otherwise("cross_doc_conflict")
    weakest, table = F.least("positive_confidence", "negative_confidence"), F.col("positive_table") | F.col("negative_table")
    severity = F.when((weakest >= 0.75) & (same | table), "high").when((weakest >= 0.65) | table, "medium").otherwise("low")
    kept = both.filter(~same | (F.col("positive_table") != F.col("negative_table")))
    return kept.select(kind.alias("kind"), "anchor", severity.alias("severity"), "positive_fact_id", "negative_fact_id", "positive_doc_id", "negative_doc_id")


def conflict_counts(facts: DataFrame) -> DataFrame:
    """(anchor, cross_doc, mismatches): how many conflicts an anchor has, from
    counts by document and source kind alone."""
    rows = facts.filter("polarity <> 'neutral'").select("doc_id", "polarity", F.contains(F.lower("source"), F.lit("table")).alias("table"), F.explode(F.array_distinct("anchors")).alias("anchor"))
    n = lambda p, t=None: F.count_if((F.col("polarity") == p) & (F.lit(True) if t is None else F.col("table") == t))
    per = rows.groupBy("anchor", "doc_id").agg(n("positive").alias("p"), n("negative").alias("n"), n("positive", True).alias("pt"), n("positive", False).alias("px"), n("negative", True).alias("nt"), n("negative", False).alias("nx"))
    return per.groupBy("anchor").agg((F.sum("p") * F.sum("n") - F.sum(F.col("p") * F.col("n"))).alias("cross_doc"), F.sum(F.col("pt") * F.col("nx") + F.col("px") * F.col("nt")).alias("mismatches")).filter("cross_doc + mismatches > 0")


def citation_gaps(references: DataFrame, marks: DataFrame, facts: DataFrame) -> DataFrame:
    """Documents whose references have no citation facts, or fewer than marks.

    ``references`` (doc_id, ref_id), ``marks`` (doc_id, node_id, ref_id)."""
    r = references.groupBy("doc_id").agg(F.count("*").alias("reference_count"))
    m = marks.select("doc_id", "ref_id", "node_id").distinct().groupBy("doc_id").agg(F.count("*").alias("mark_count"))
    c = facts.filter("fact_type = 'relation' AND type = 'cites'").groupBy("doc_id").agg(F.count("*").alias("fact_count"))
    all_ = r.join(m, "doc_id", "full_outer").join(c, "doc_id", "left").fillna(0)
    reason = F.when((F.col("reference_count") > 0) & (F.col("fact_count") == 0), "missing_citation_fact_relations").when(F.col("mark_count") > F.col("fact_count"), "partial_citation_fact_relations")
    return all_.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def audit(facts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """One row of counts, with the warnings they give."""
    dup = duplicate_groups(facts).agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_facts"))
    base = facts.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") < min_confidence).alias("low_confidence"), F.count_if(T.text_of("node_id") == "").alias("no_evidence"))
    both = base.join(F.broadcast(dup))  # one row each
    warnings = F.array_join(F.array_compact(F.array(F.when(F.col("total") == 0, "no_facts_to_audit"), F.when(F.col("duplicate_groups") > 0, "duplicate_facts"), F.when(F.col("low_confidence") > 0, "low_confidence_facts"), F.when(F.col("no_evidence") > 0, "facts_without_evidence"))), ",")
    return both.withColumn("warnings", warnings)
