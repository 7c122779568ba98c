"""Queries: layout, cards, evidence units, frames from claims, reviews and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import evidence as V
from lexforge.operators import lexical, records
from lexforge.plans import inputs as I
from lexforge.plans.q_evals import EVENTS, _events, _memories
from lexforge.plans.q_facts import CLAIMS, _claims
from lexforge.plans.q_tree import HEADS, _line_blocks
from lexforge.plans.registry import query


@query("layout_sections", HEADS + " SELECT doc_id, p::INT AS position, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, (parent IS NOT NULL OR head)::INT AS under FROM parents")
def layout_sections(spark, sf_dir):
    return V.layout(_line_blocks(spark, sf_dir)).select("doc_id", "position", "kind", (F.size("section_path") > 0).cast("int").alias("under"))


#: Common words of the texts stand for words that sections are told by.
CARD_WORDS = {"and": "novel", "der": "contribution", "que": "approach", "de": "framework", "is": "limitation", "und": "future", "la": "method"}


def _carded_sql() -> str:
    out = "text"
    for word, term in CARD_WORDS.items():
        out = f"replace({out}, ' {word} ', ' {term} ')"
    return out


def _card_sql(name: str) -> str:
    said = " OR ".join(f"contains(l, '{t.lower()}')" for t in V.CARD_TERMS[name])
    return f"coalesce(arg_min(t, order_index) FILTER (WHERE quiet AND ({said})), '') AS {name}"


@query("doc_cards", "WITH " + I.SQL_LINES + rf""",
worded AS (SELECT doc_id, order_index, {_carded_sql()} AS text FROM nodes),
n AS (SELECT doc_id, order_index, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x, lower(text) AS l FROM worded),
t AS (SELECT *, CASE WHEN length(x) <= 220 THEN x ELSE rtrim(substr(x, 1, 220)) || '...' END AS t FROM n),
s AS (SELECT *, regexp_matches(lower(t), '(dataset|method|model|framework|experiment|result|limitation)') AS signal FROM t),
q AS (SELECT *, (signal OR length(t) - length(regexp_replace(t, '[>/]', '', 'g')) < 2) AND (signal OR NOT regexp_matches(lower(t), '\b(doi|vol\.|no\.|pp\.|journal|proceedings)\b')) AND NOT regexp_matches(lower(t), '(issn|cn |journal of|copyright|http://|https://|www\.|doi|page\s+\d+)') AND NOT regexp_matches(t, '^\[\d+\]') AS quiet FROM s)
SELECT doc_id, coalesce(arg_min(t, order_index) FILTER (WHERE quiet), '') AS description, {", ".join(_card_sql(c) for c in V.CARD_TERMS)} FROM q GROUP BY doc_id""")
def doc_cards(spark, sf_dir):
    text = F.col("text")
    for word, term in CARD_WORDS.items():
        text = F.regexp_replace(text, rf" {word} ", f" {term} ")
    return V.doc_cards(I.lines(spark, sf_dir).withColumn("text", text)).select("doc_id", "description", *V.CARD_TERMS)


@query("insight_nodes", "WITH " + I.SQL_LINES + r""",
s AS (SELECT doc_id, node_id, order_index, 3 * (contains(text, 'tion')::INT + contains(text, 'aux')::INT) - CASE WHEN length(text) < 40 THEN 2 ELSE 0 END - CASE WHEN regexp_matches(text, '(\.{4,}|…{2,})') THEN 5 ELSE 0 END AS score FROM nodes),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, order_index, node_id) AS rank FROM s)
SELECT doc_id, rank::INT AS rank, node_id, score::INT AS score FROM r WHERE rank <= 18""")
def insight_nodes(spark, sf_dir):
    return V.insight_nodes(I.lines(spark, sf_dir), ["tion", "aux"])


@query("evidence_units", "WITH " + I.SQL_LINES + """
SELECT 'eu_' || substr(sha256(concat_ws(chr(31), doc_id, node_id, 'paragraph')), 1, 14) AS unit_id, doc_id, node_id, 'paragraph' AS unit_type, 'node' AS source_kind, 0.78::DOUBLE AS confidence FROM nodes WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""".replace("\\\\", "\\"))
def evidence_units(spark, sf_dir):
    return V.evidence_units(I.lines(spark, sf_dir)).select("unit_id", "doc_id", "node_id", "unit_type", "source_kind", "confidence")


@query("claim_frames")
def claim_frames(spark, sf_dir):
    units = V.evidence_units(I.lines(spark, sf_dir))
    made = V.claim_frames(_claims(spark, sf_dir), units)
    return V.trace_status(made, units, ("doc_id", "claim_type", "frame_quality"))


@query("section_drafts", """
WITH e AS (SELECT source AS section, doc_id, 'point ' || i AS item, ((i * 7 + doc_id) % 13) / 13.0::DOUBLE AS priority FROM documents, range(0, 3) t(i)),
p AS (SELECT *, row_number() OVER (PARTITION BY section, doc_id ORDER BY priority DESC, item) AS turn FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY turn, doc_id) AS rank FROM p)
SELECT section, string_agg(item || ' [E' || rank || ']', chr(10) || chr(10) ORDER BY rank) AS body FROM r WHERE rank <= 8 GROUP BY section""")
def section_drafts(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("section"), "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return V.section_drafts(rows.select("section", "doc_id", F.concat(F.lit("point "), "i").alias("item"), ((F.col("i") * 7 + F.col("doc_id")) % 13 / 13.0).alias("priority"))).select("section", "body")


@query("comparison_matrix", """
WITH d(dimension) AS (VALUES ('task'), ('method')), c AS (SELECT dimension, doc_id, CASE WHEN dimension = 'task' THEN least(doc_id % 6, 4) ELSE 0 END AS n FROM documents CROSS JOIN d)
SELECT dimension, count(*) AS documents, count(*) FILTER (WHERE n > 0) AS with_evidence, round(avg(CASE WHEN n >= 3 THEN 0.75 WHEN n >= 1 THEN 0.6 ELSE 0.25 END), 4)::DOUBLE AS mean_confidence FROM c GROUP BY dimension""")
def comparison_matrix(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    e = d.select("doc_id", F.explode(F.array_repeat(F.lit("task"), (F.col("doc_id") % 6).cast("int"))).alias("dimension"))
    grid = records.dimension_grid(spark.createDataFrame([("task",), ("method",)], "dimension string"), d, e)
    return V.comparison(grid).select("dimension", "documents", "with_evidence", "mean_confidence")


@query("compiled_context")
def compiled_context(spark, sf_dir):
    return V.compiled_context(records.select_memories(_memories(spark, sf_dir), "the tion ing"))


@query("tuned_profile", "WITH " + EVENTS.format(keys="intent,") + ", r AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY score DESC, mode) AS k FROM scored) SELECT intent, mode, round(score, 4) AS score FROM r WHERE k = 1")
def tuned_profile(spark, sf_dir):
    return V.tuned_profile(_events(spark, sf_dir)).select("intent", "mode", F.round("score", 4).alias("score"))


@query("case_nodes", "SELECT 'n' || (event_id % 97) AS node_id, string_agg(DISTINCT (['fts','hybrid','tree'])[user_id % 3 + 1], ',' ORDER BY (['fts','hybrid','tree'])[user_id % 3 + 1]) AS modes FROM events GROUP BY 1")
def case_nodes(spark, sf_dir):
    modes = F.array(*[F.lit(x) for x in ("fts", "hybrid", "tree")])
    return V.case_nodes(I.table(spark, sf_dir, "events").select(F.concat(F.lit("n"), F.col("event_id") % 97).alias("node_id"), F.element_at(modes, (F.col("user_id") % 3 + 1).cast("int")).alias("mode")))


@query("corpus_fingerprint")
def corpus_fingerprint(spark, sf_dir):
    return V.fingerprint(I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash")))


@query("eval_set_from_feedback", "SELECT 'q ' || conv_id AS query, CASE WHEN conv_id % 2 = 0 THEN 'qa' ELSE '' END AS intent FROM conversations WHERE turn % 2 = 0")
def eval_set_from_feedback(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    feedback = c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.concat(F.lit("q "), "conv_id")).alias("query"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>")).alias("expected_doc_ids"))
    logs = c.filter("conv_id % 2 = 0").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.lit("qa").alias("intent"), F.concat(F.lit("q "), "conv_id").alias("query"))
    return V.eval_set_from_feedback(feedback, logs).select("query", "intent")


@query("quality_baseline", CLAIMS + """,
f AS (SELECT doc_id, count(*) AS n FROM keyed GROUP BY doc_id)
SELECT source, count(*) AS documents, count(*) FILTER (WHERE doc_id % 3 = 0) AS weak_documents, coalesce(sum(n), 0)::BIGINT AS facts, count(*) FILTER (WHERE n IS NULL) AS without_facts FROM documents LEFT JOIN f USING (doc_id) GROUP BY source""")
def quality_baseline(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "source")
    quality = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "weak").otherwise("usable").alias("quality_level"))
    return V.quality_baseline(d, _claims(spark, sf_dir), quality).select("source", "documents", "weak_documents", "facts", "without_facts")


@query("snippets", None)
def snippets(spark, sf_dir):
    """Best chunks of each passage with the words around its first term."""
    asked = I.passages(spark, sf_dir)
    nodes = I.chunks(spark, sf_dir)
    best = nodes.select("node_id", "text").join(F.broadcast(lexical.fts_nodes(asked, nodes, 3)), "node_id").join(asked, "query_id")
    first = F.get(T.fts_tokens(F.col("query")), F.lit(0))
    return best.select("query_id", "rank", "node_id", lexical.snippet(F.col("text"), first).alias("snippet"))
