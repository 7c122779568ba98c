"""Queries: retrieval metrics, logs, memory, evidence and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import evals as E
from lexforge.operators import lexical
from lexforge.operators import nodes as N
from lexforge.operators import records as R
from lexforge.operators.containment import contained
from lexforge.plans import inputs as I
from lexforge.plans.q_search import WITH
from lexforge.plans.registry import query


def _expected(spark, sf_dir):
    """Documents that hold an item's text."""
    items = I.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))
    docs = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("hay"))
    return contained(docs, items).join(items, "term").select("query_id", "item")


RESULTS = WITH + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), node_id) AS r FROM bm25) WHERE r <= 200),
docs AS (SELECT query_id, doc_id, count(*) AS m, round(min(score), 9) AS best FROM top GROUP BY query_id, doc_id),
results AS (SELECT * FROM (SELECT query_id, doc_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY best, m DESC, doc_id) AS rank FROM docs) WHERE rank <= 5),
expected AS (SELECT DISTINCT item_id AS query_id, d.doc_id AS item FROM benchmark JOIN documents d ON contains(d.text, benchmark.text)),
hits AS (SELECT r.query_id, count(*) AS h, min(rank) AS f FROM results r JOIN expected e ON r.query_id = e.query_id AND r.item = e.item GROUP BY 1),
per AS (SELECT q.query_id, coalesce(e.n, 0) AS n_expected, coalesce(g.n, 0) AS n_results, coalesce(h, 0) AS h, f FROM queries q LEFT JOIN (SELECT query_id, count(*) AS n FROM expected GROUP BY 1) e USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS n FROM results GROUP BY 1) g USING (query_id) LEFT JOIN hits USING (query_id)),
metrics AS (SELECT query_id, CASE WHEN n_expected = 0 THEN 1.0::DOUBLE ELSE h / n_expected END AS recall, CASE WHEN n_expected = 0 THEN 1.0::DOUBLE WHEN n_results = 0 THEN 0.0::DOUBLE ELSE h / n_results END AS precision, CASE WHEN n_expected = 0 THEN 1.0::DOUBLE WHEN f IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / f END AS mrr, n_results, n_expected FROM per)"""


def _metrics(spark, sf_dir):
    asked = I.passages(spark, sf_dir)
    found = lexical.fts_documents(asked, I.chunks(spark, sf_dir), 5).select("query_id", "rank", F.col("doc_id").alias("item"))
    return E.metrics(found, _expected(spark, sf_dir), asked)


@query("ir_metrics", RESULTS + " SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, n_results, n_expected FROM metrics")
def ir_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")], "n_results", "n_expected")


#: Results of three modes, made up from the events: one row for each query.
EVENTS = """per AS (SELECT event_id, (['fts','hybrid','tree'])[event_id % 3 + 1] AS mode, (['method','qa'])[user_id % 2 + 1] AS intent, (event_id % 5) / 4.0::DOUBLE AS recall, (event_id % 3) / 2.0::DOUBLE AS precision, (event_id % 2)::DOUBLE AS mrr, event_type = 'error' AS fallback FROM events),
agg AS (SELECT {keys} mode, count(*) AS query_count, avg(recall) AS recall, avg(precision) AS precision, avg(mrr) AS mrr, avg(fallback::INT) AS fb FROM per GROUP BY {keys} mode),
scored AS (SELECT *, round(0.3 * recall + 0.35 * recall + 0.15 * precision + 0.15 * mrr + 0.05 - 0.05 * fb, 6) AS score FROM agg)"""


def _events(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c % len(xs) + 1).cast("int"))
    return e.select("event_id", pick(["fts", "hybrid", "tree"], F.col("event_id")).alias("mode"), pick(["method", "qa"], F.col("user_id")).alias("intent"), ((F.col("event_id") % 5) / 4.0).alias("recall"), ((F.col("event_id") % 3) / 2.0).alias("precision"), (F.col("event_id") % 2).cast("double").alias("mrr"), (F.col("event_type") == "error").alias("fallback"))


@query("mode_ranking", "WITH " + EVENTS.format(keys="") + " SELECT mode, query_count, round(score, 4) AS score, (row_number() OVER (ORDER BY score DESC, mode))::INT AS rank FROM scored")
def mode_ranking(spark, sf_dir):
    return E.mode_rankings(_events(spark, sf_dir)).select("mode", "query_count", F.round("score", 4).alias("score"), "rank")


@query("per_intent_metrics", "WITH " + EVENTS.format(keys="intent,") + " SELECT intent, mode, query_count, round(score, 4) AS score, (row_number() OVER (PARTITION BY intent ORDER BY score DESC, mode))::INT AS rank FROM scored")
def per_intent_metrics(spark, sf_dir):
    return E.mode_rankings(_events(spark, sf_dir), ["intent"]).select("intent", "mode", "query_count", F.round("score", 4).alias("score"), "rank")


FAILURES = RESULTS + """,
items AS (SELECT *, query_id % 5 = 0 AS fallback, query_id % 7 AS weak_docs, query_id % 2 = 0 AS tree, (query_id % 4) / 4.0 AS trace FROM metrics),
reasons AS (SELECT query_id, 'doc_routing_miss' AS reason FROM items WHERE n_expected > 0 AND recall < 1 UNION ALL SELECT query_id, 'evidence_coverage_insufficient' FROM items WHERE n_results = 0 UNION ALL SELECT query_id, 'search_fallback' FROM items WHERE fallback
  UNION ALL SELECT query_id, 'weak_parse_quality' FROM items WHERE weak_docs > 0 UNION ALL SELECT query_id, 'tree_trace_incomplete' FROM items WHERE tree AND trace < 0.75 UNION ALL SELECT query_id, 'low_signal_eval_case' FROM items WHERE n_expected = 0)"""


@query("failure_reasons", FAILURES + " SELECT query_id, reason FROM reasons")
def failure_reasons(spark, sf_dir):
    return _failures(spark, sf_dir)


def _failures(spark, sf_dir):
    q = F.col("query_id")
    return E.failure_reasons(_metrics(spark, sf_dir).withColumns({"fallback": q % 5 == 0, "weak_docs": q % 7, "mode": F.when(q % 2 == 0, "tree").otherwise("fts"), "trace": (q % 4) / 4.0}))


@query("next_actions", FAILURES + " SELECT reason, count(*) AS n FROM reasons GROUP BY reason")
def next_actions(spark, sf_dir):
    return E.next_actions(_failures(spark, sf_dir)).select("reason", "n")


@query("eval_suite_dedupe", r"""
WITH a AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS query, 'x' AS intent, item_id AS position, 0 AS part FROM benchmark), b AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS query, role AS intent, conv_id * 1000 + turn AS position, 1 AS part FROM conversations),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY part, position) AS r FROM u WHERE query <> '')
SELECT query, part::INT AS part FROM f WHERE r = 1 ORDER BY part, position, query LIMIT 500""")
def eval_suite_dedupe(spark, sf_dir):
    first = I.table(spark, sf_dir, "benchmark").select(F.col("text").alias("query"), F.lit("x").alias("intent"), F.col("item_id").alias("position"))
    second = I.table(spark, sf_dir, "conversations").select(F.col("text").alias("query"), F.col("role").alias("intent"), (F.col("conv_id") * 1000 + F.col("turn")).alias("position"))
    return E.eval_suite(first, second).select("query", "part")


def _logs(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    k = F.coalesce(F.regexp_extract("props", r'"k":\s*(-?\d+)', 1).cast("int"), F.lit(0))
    warnings = F.array_compact(F.array(F.when(F.col("event_type") == "error", "search_fallback"), F.when(k % 7 == 0, "no_search_results"), F.when(k % 3 == 0, F.concat(F.lit("w"), k % 10))))
    return e.select("event_id", F.col("event_type").alias("operation"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("latency_ms"), warnings.alias("warnings"), (k % 11).alias("evidence_count"), F.col("ts").alias("created_at"), "user_id")


LOGS = r"""logs AS (SELECT event_id, event_type AS operation, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS latency_ms, k % 11 AS evidence_count, k, ts, user_id FROM (SELECT *, coalesce(try_cast(nullif(regexp_extract(props, '"k":\s*(-?\d+)', 1), '') AS INT), 0) AS k FROM events))"""


@query("query_stats", "WITH " + LOGS + """
SELECT operation, count(*) AS query_count, round(avg(latency_ms), 2) AS avg_latency_ms, round(count(*) FILTER (WHERE status = 'failed') / count(*), 4) AS failure_rate, round(count(*) FILTER (WHERE operation = 'error') / count(*), 4) AS fallback_rate, round(count(*) FILTER (WHERE evidence_count = 0 OR k % 7 = 0) / count(*), 4) AS no_evidence_rate FROM logs GROUP BY operation""")
def query_stats(spark, sf_dir):
    return R.query_stats(_logs(spark, sf_dir), ["operation"]).withColumn("avg_latency_ms", F.round("avg_latency_ms", 2))


@query("top_warnings", "WITH " + LOGS + """,
w AS (SELECT 'search_fallback' AS value FROM logs WHERE operation = 'error' UNION ALL SELECT 'no_search_results' FROM logs WHERE k % 7 = 0 UNION ALL SELECT 'w' || (k % 10) FROM logs WHERE k % 3 = 0)
SELECT value, count(*) AS count FROM w GROUP BY value ORDER BY count DESC, value LIMIT 10""")
def top_warnings(spark, sf_dir):
    return R.top_counts(_logs(spark, sf_dir), "warnings")


@query("since_days", "WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) AS n FROM events, m WHERE ts >= now - INTERVAL 3 DAY GROUP BY event_type")
def since_days(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return R.since(e, 3, F.lit(now).cast(e.schema["ts"].dataType), "ts").groupBy("event_type").agg(F.count("*").alias("n"))


@query("feedback_summary", "SELECT event_type, count(*) AS feedback_count, round(avg(CASE WHEN user_id % 6 > 0 THEN user_id % 6 END), 3) AS avg_rating, count(*) FILTER (WHERE user_id % 6 BETWEEN 1 AND 2) AS low_rating_count FROM events GROUP BY event_type")
def feedback_summary(spark, sf_dir):
    return R.feedback_summary(I.table(spark, sf_dir, "events").withColumn("rating", F.col("user_id") % 6), ["event_type"])


@query("latest_version", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS r FROM conversations) WHERE r = 1")
def latest_version(spark, sf_dir):
    return R.latest(I.table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn").desc(), F.col("text")).select("conv_id", "turn", "role")


@query("incremental_skip", "SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 10 = 9 THEN 'gone' WHEN doc_id % 4 = 0 OR doc_id % 10 = 8 THEN 'indexed' ELSE 'skipped' END AS action FROM documents")
def incremental_skip(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    path, h = F.concat(F.lit("d"), F.col("doc_id")), F.sha2("text", 256)
    incoming = d.filter("doc_id % 10 <> 9").select(path.alias("path"), h.alias("hash"), F.lit("text/1").alias("parser"))
    existing = d.filter("doc_id % 10 <> 8").select(path.alias("path"), F.when(F.col("doc_id") % 4 == 0, "old").otherwise(h).alias("hash"), F.lit("text/1").alias("parser"))
    return R.sync_plan(incoming, existing)


def _memories(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    kinds = F.array(*[F.lit(x) for x in ("preference", "project_rule", "task_progress", "failure", "setting")])
    return c.select(F.concat_ws("-", F.col("conv_id"), F.col("turn")).alias("memory_id"), F.col("role").alias("scope"), F.element_at(kinds, (F.col("conv_id") % 5 + 1).cast("int")).alias("type"), F.lit("k").alias("subject_key"), F.col("text").alias("content"), F.lit("").alias("refs"), ((F.col("turn") % 10) / 10.0).alias("importance"), ((F.col("conv_id") % 10) / 10.0).alias("confidence"), F.when(F.col("conv_id") % 3 == 0, F.col("turn") * 100.0).alias("ttl"))


@query("memory_rank", """
WITH m AS (SELECT conv_id || '-' || turn AS memory_id, role AS scope, (['preference','project_rule','task_progress','failure','setting'])[conv_id % 5 + 1] AS type, text, (turn % 10) / 10.0::DOUBLE AS importance, (conv_id % 10) / 10.0::DOUBLE AS confidence FROM conversations),
h AS (SELECT *, lower(scope || ' ' || type || ' k ' || text) AS hay FROM m),
s AS (SELECT memory_id, scope, round(2.0 * importance + confidence + least(2.0, 0.35 * (contains(hay, 'the')::INT + contains(hay, 'tion')::INT + contains(hay, 'ing')::INT)) + CASE type WHEN 'preference' THEN 0.35 WHEN 'project_rule' THEN 0.35 WHEN 'task_progress' THEN 0.25 WHEN 'failure' THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, memory_id) AS rank FROM s)
SELECT memory_id, scope, score, rank::INT AS rank FROM r WHERE rank <= 8""")
def memory_rank(spark, sf_dir):
    return R.select_memories(_memories(spark, sf_dir), "the tion ing").select("memory_id", "scope", "score", "rank")


@query("memory_ttl", "SELECT conv_id || '-' || turn AS memory_id FROM conversations WHERE conv_id % 3 <> 0 OR turn * 100.0 > 150")
def memory_ttl(spark, sf_dir):
    return R.alive(_memories(spark, sf_dir), F.lit(150.0)).select("memory_id")


@query("memory_gate", """
SELECT conv_id || '-' || turn AS memory_id, CASE WHEN conv_id % 17 = 0 THEN 'force' WHEN (conv_id % 10) / 10.0 < 0.45 THEN 'low_confidence' WHEN conv_id % 5 = 4 THEN 'unsupported_memory_type' WHEN contains(text, 'the')::INT + contains(text, 'ation')::INT >= 2 THEN 'paper_asset_boundary' WHEN conv_id % 5 = 3 AND length(text) > 600 THEN 'failure_memory_too_long' WHEN length(text) > 1200 AND conv_id % 5 <> 1 THEN 'content_too_long' ELSE 'allowed_memory' END AS reason FROM conversations""")
def memory_gate(spark, sf_dir):
    m = _memories(spark, sf_dir)
    forced = F.split("memory_id", "-")[0].cast("long") % 17 == 0
    return m.select("memory_id", R.gate(F.col("type"), F.col("content"), F.col("confidence"), forced, ["preference", "project_rule", "task_progress", "failure"], ["the", "ation"]).alias("reason"))


@query("evidence_round_robin", """
WITH e AS (SELECT source AS section, doc_id, i AS item, ((i * 7 + doc_id) % 13) / 13.0::DOUBLE AS priority FROM documents, range(0, 3) t(i)),
p AS (SELECT *, row_number() OVER (PARTITION BY section, doc_id ORDER BY priority DESC, item) AS turn FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY turn, doc_id) AS rank FROM p)
SELECT section, doc_id, item, rank::INT AS rank FROM r WHERE rank <= 8""")
def evidence_round_robin(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("section"), "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: i.cast("long"))).alias("item")).withColumn("priority", ((F.col("item") * 7 + F.col("doc_id")) % 13) / 13.0)
    return R.round_robin(rows, 8).select("section", "doc_id", "item", "rank")


@query("dimension_grid", """
WITH d(dimension) AS (VALUES ('task'), ('method'), ('result')), e AS (SELECT doc_id, (['task','method'])[i % 2 + 1] AS dimension FROM documents, range(0, 9) t(i) WHERE i < doc_id % 10),
n AS (SELECT doc_id, dimension, least(count(*), 4) AS n FROM e GROUP BY 1, 2)
SELECT doc_id, dimension, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 3 THEN 0.75 WHEN coalesce(n, 0) >= 1 THEN 0.6 ELSE 0.25 END::DOUBLE AS confidence FROM documents CROSS JOIN d LEFT JOIN n USING (doc_id, dimension)""")
def dimension_grid(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    dims = spark.createDataFrame([("task",), ("method",), ("result",)], "dimension string")
    e = d.select("doc_id", F.explode(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: i < F.col("doc_id") % 10)).alias("i")).select("doc_id", F.when(F.col("i") % 2 == 0, "task").otherwise("method").alias("dimension"))
    return R.dimension_grid(dims, d, e)


@query("paragraph_coverage", r"""
WITH b AS (SELECT doc_id AS section, string_split(text, chr(10)) AS l FROM documents),
p AS (SELECT section, list_filter(list_transform(l, lambda x, i: trim(regexp_replace(x || CASE WHEN (section + i - 1) % 3 = 0 THEN ' [E' || ((i - 1) % 4 + 1) || ']' ELSE '' END, '\s+', ' ', 'g'))), lambda x: length(x) >= 25 AND NOT starts_with(x, '#')) AS p, list_distinct(list_filter(list_transform(l, lambda x, i: CASE WHEN (section + i - 1) % 3 = 0 THEN 'E' || ((i - 1) % 4 + 1) END), lambda x: x IS NOT NULL)) AS named FROM b),
c AS (SELECT section, len(p) AS n, len(list_filter(p, lambda x: NOT regexp_matches(x, '\[E\d+\]'))) AS u, len(list_filter(named, lambda x: x NOT IN ('E1', 'E2', 'E9'))) AS m FROM p)
SELECT section, n::INT AS paragraphs, u::INT AS unsupported, m::INT AS missing_refs, round(greatest(0.0, CASE WHEN n = 0 THEN 1.0 ELSE (n - u) / n END - least(0.5, 0.1 * m))::DOUBLE, 4) AS coverage FROM c""")
def paragraph_coverage(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.concat(x, F.when((F.col("doc_id") + i) % 3 == 0, F.concat(F.lit(" [E"), i % 4 + 1, F.lit("]"))).otherwise("")))
    drafts = d.select(F.col("doc_id").alias("section"), F.array_join(marked, "\n\n").alias("body"), T.lit_array(["E1", "E2", "E9"]).alias("refs"))
    return R.paragraph_support(drafts).select("section", "paragraphs", "unsupported", "missing_refs", F.round("coverage", 4).alias("coverage"))


@query("repeated_lines", r"""
WITH l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents)
SELECT doc_id, regexp_replace(lower(line), '[0-9]+', '#', 'g') AS noise_key, count(*) AS n_lines FROM l WHERE line <> '' AND length(line) <= 120 GROUP BY 1, 2 HAVING count(*) >= 2""")
def repeated_lines(spark, sf_dir):
    return N.repeated_lines(I.table(spark, sf_dir, "documents"))


@query("dup_content_groups", r"""
SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_content_groups(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    return d.groupBy(T.content_hash(T.text_of("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("chunk_paragraphs", "WITH " + I.SQL_CHUNKS + " SELECT node_id, doc_id, order_index::INT AS order_index, length(text)::INT AS n, md5(text) AS h FROM nodes")
def chunk_paragraphs(spark, sf_dir):
    return I.chunks(spark, sf_dir).select("node_id", "doc_id", "order_index", F.length("text").alias("n"), F.md5("text").alias("h"))


@query("metadata_extract", r"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'In ' || (1950 + doc_id % 90) || ' doi 10.1234/ab.' || doc_id || ' ' ELSE '' END || text AS x FROM documents)
SELECT doc_id, try_cast(nullif(regexp_extract(x, '\b(19\d{2}|20\d{2})\b', 1), '') AS INT) AS year, nullif(regexp_extract(x, '(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)', 1), '') AS doi FROM t""")
def metadata_extract(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("In "), F.lit(1950) + F.col("doc_id") % 90, F.lit(" doi 10.1234/ab."), F.col("doc_id"), F.lit(" "))).otherwise("")
    x = F.concat(head, F.col("text"))
    return d.select("doc_id", T.year(x).alias("year"), T.doi(x).alias("doi"))


@query("noise_reasons", r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
f AS (SELECT doc_id, x, lower(x) AS l, len(list_filter(['issn','cn ','journal of','copyright','http://','https://','www.','doi'], lambda m: contains(lower(x), m))) AS marks, len(list_filter(['dataset','method','model','framework','experiment','result','limitation'], lambda m: contains(lower(x), m))) > 0 AS signal FROM t)
SELECT doc_id, concat_ws(',', CASE WHEN marks >= 1 THEN 'front_matter' END, CASE WHEN regexp_matches(l, 'page\s+\d+') THEN 'page_marker' END, CASE WHEN length(x) - length(regexp_replace(x, '[>/]', '', 'g')) >= 2 AND NOT signal THEN 'path_fragment' END,
  CASE WHEN regexp_matches(x, '^\[\d+\]') OR (regexp_matches(l, '\b(doi|vol\.|no\.|pp\.|journal|proceedings)\b') AND NOT signal) THEN 'reference_entry' END) AS reasons FROM f""")
def noise_reasons(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.noise_reasons(F.col("text")), ",").alias("reasons"))


@query("text_functions", r"""
SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')[1:10], ' ') || CASE WHEN len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) > 10 THEN ' ...' ELSE '' END AS first_words, 'doc_' || substr(sha256(doc_id || chr(31) || source), 1, 16) AS stable_id, substr(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g'), 1, 40) AS fact_key
FROM documents""")
def text_functions(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.first_words(F.col("text"), 10).alias("first_words"), T.stable_id("doc", F.col("doc_id"), F.col("source")).alias("stable_id"), T.fact_key(F.col("text"), 40).alias("fact_key"))
