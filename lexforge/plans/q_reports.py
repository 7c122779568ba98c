"""Queries: evidence packets, search reports, roll-ups and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import lexical, packets, rollups, snapshots
from lexforge.plans import inputs as I
from lexforge.plans.q_frames import BUCKETS, _buckets
from lexforge.plans.q_search import FALLBACK, WITH
from lexforge.plans.registry import query
from lexforge.sources.workspace import new_folder
from lexforge.streaming import index, memory

HITS = WITH + ",\n" + FALLBACK + r""",
best AS (SELECT * FROM (SELECT query_id, node_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), node_id) AS rank FROM bm25) WHERE rank <= 24),
like_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY order_index, node_id) AS rank FROM (SELECT DISTINCT query_id, node_id, doc_id, order_index FROM terms JOIN nodes ON contains(lower(nodes.text), terms.term))) WHERE rank <= 24),
every AS (SELECT query_id, node_id, rank, score, 'fts' AS mode FROM best UNION ALL SELECT query_id, node_id, rank, 0.0, 'like' FROM like_),
hits AS (SELECT query_id, node_id, list_sort(list(mode)) AS modes, min(rank) AS best FROM every GROUP BY query_id, node_id)"""


def _modes(spark, sf_dir):
    asked, nodes = I.passages(spark, sf_dir), I.chunks(spark, sf_dir)
    return asked, nodes, {"fts": lexical.fts_nodes(asked, nodes, 24), "like": lexical.contains_nodes(asked, nodes, 24)}


@query("evidence_packets", HITS + r""",
spans AS (SELECT h.query_id, n.doc_id, h.best, h.modes, n.order_index - 1 AS low, n.order_index + 1 AS high FROM hits h JOIN nodes n USING (node_id)),
marked AS (SELECT *, coalesce((low > max(high) OVER (PARTITION BY query_id, doc_id ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS fresh FROM spans),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id, doc_id ORDER BY low ROWS UNBOUNDED PRECEDING) AS packet FROM marked),
packed AS (SELECT query_id, doc_id, packet, min(low) AS a, max(high) AS b, count(*) AS hits, min(best) AS best, list_sort(list_distinct(flatten(list(modes)))) AS modes FROM islands GROUP BY query_id, doc_id, packet),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id, a) AS rank FROM packed QUALIFY rank <= 8)
SELECT c.query_id, c.rank::INT AS rank, c.doc_id, min(n.order_index)::BIGINT AS first, max(n.order_index)::BIGINT AS last, any_value(c.hits) AS hits, array_to_string(any_value(c.modes), ',') AS modes, 'paragraph' AS evidence_type, 0.75::DOUBLE AS confidence, sha256(string_agg(n.text, chr(10) || chr(10) ORDER BY n.order_index)) AS excerpt_sha
FROM chosen c JOIN nodes n ON n.doc_id = c.doc_id AND n.order_index BETWEEN c.a AND c.b GROUP BY c.query_id, c.rank, c.doc_id""")
def evidence_packets(spark, sf_dir):
    _, nodes, modes = _modes(spark, sf_dir)
    out = packets.packets(packets.merged_hits(modes), nodes)
    return out.withColumns({"modes": F.array_join("modes", ","), "excerpt_sha": F.sha2("excerpt", 256)}).drop("excerpt")


@query("search_report", HITS + r""",
placed AS (SELECT h.*, n.doc_id FROM hits h JOIN nodes n USING (node_id)),
per AS (SELECT query_id, count(*) AS nodes, count(DISTINCT doc_id) AS documents, arg_min(doc_id, {'b': best, 'd': doc_id}) AS top_doc, count(*) FILTER (WHERE len(modes) > 1) AS agreed, count(*) FILTER (WHERE list_contains(modes, 'fts')) AS f, count(*) FILTER (WHERE list_contains(modes, 'like')) AS l FROM placed GROUP BY query_id)
SELECT q.query_id, coalesce(nodes, 0) AS nodes, coalesce(documents, 0) AS documents, 'fts:' || coalesce(f, 0) || ',like:' || coalesce(l, 0) AS counts, top_doc, coalesce(agreed, 0) AS agreed,
  concat_ws(',', CASE WHEN coalesce(f, 0) = 0 THEN 'no_fts_results' END, CASE WHEN coalesce(l, 0) = 0 THEN 'no_like_results' END, CASE WHEN nodes IS NULL THEN 'no_search_results' END) AS warnings FROM queries q LEFT JOIN per USING (query_id)""")
def search_report(spark, sf_dir):
    asked, nodes, modes = _modes(spark, sf_dir)
    return packets.report(asked, modes, nodes)


PLANS = BUCKETS + r""",
counted AS (SELECT query_id, query_id % 5 AS topic, query_id % 2 AS side, count(*) FILTER (WHERE bucket = 'strong_claims') AS strong, count(*) FILTER (WHERE bucket = 'qualified_claims') AS qualified, count(*) FILTER (WHERE bucket = 'related_claims') AS related, count(*) FILTER (WHERE bucket = 'conflicting_claims') AS conflicting, count(*) FILTER (WHERE bucket = 'insufficient_claims') AS insufficient, count(*) FILTER (WHERE bucket = 'unchecked_claims') AS unchecked FROM kept GROUP BY query_id),
plans AS (SELECT *, CASE WHEN conflicting > 0 THEN 'conflicting' WHEN strong > 0 THEN 'answerable' WHEN qualified > 0 THEN 'partially_answerable' ELSE 'insufficient_evidence' END AS answerability,
  list_filter([CASE WHEN conflicting > 0 THEN 'conflicts:' || conflicting END, CASE WHEN insufficient > 0 AND strong = 0 THEN 'insufficient:' || insufficient END, CASE WHEN unchecked > 2 THEN 'unchecked' END], lambda w: w IS NOT NULL) AS warnings FROM counted)"""


def _plans(spark, sf_dir):
    """Each query's answer plan: its buckets, what they amount to, and warnings."""
    n = lambda b: F.count_if(F.col("bucket") == f"{b}_claims").alias(b)
    per = _buckets(spark, sf_dir).groupBy("query_id").agg(*[n(b) for b in rollups.BUCKETS])
    what = F.when(F.col("conflicting") > 0, "conflicting").when(F.col("strong") > 0, "answerable").when(F.col("qualified") > 0, "partially_answerable").otherwise("insufficient_evidence")
    warned = F.array_compact(F.array(F.when(F.col("conflicting") > 0, F.concat(F.lit("conflicts:"), F.col("conflicting").cast("string"))), F.when((F.col("insufficient") > 0) & (F.col("strong") == 0), F.concat(F.lit("insufficient:"), F.col("insufficient").cast("string"))), F.when(F.col("unchecked") > 2, "unchecked")))
    return per.withColumns({"topic": F.col("query_id") % 5, "side": F.col("query_id") % 2, "answerability": what, "warnings": warned})


@query("answer_plan_rollup", PLANS + r"""
SELECT side, topic, (2 - (grouping(side) + grouping(topic)))::INT AS level, count(*) AS plans, sum(strong)::BIGINT AS strong, sum(qualified)::BIGINT AS qualified, sum(related)::BIGINT AS related, sum(conflicting)::BIGINT AS conflicting, sum(insufficient)::BIGINT AS insufficient, sum(unchecked)::BIGINT AS unchecked,
  concat_ws(',', CASE WHEN count(*) FILTER (WHERE answerability = 'answerable') > 0 THEN 'answerable:' || count(*) FILTER (WHERE answerability = 'answerable') END, CASE WHEN count(*) FILTER (WHERE answerability = 'conflicting') > 0 THEN 'conflicting:' || count(*) FILTER (WHERE answerability = 'conflicting') END, CASE WHEN count(*) FILTER (WHERE answerability = 'insufficient_evidence') > 0 THEN 'insufficient_evidence:' || count(*) FILTER (WHERE answerability = 'insufficient_evidence') END, CASE WHEN count(*) FILTER (WHERE answerability = 'partially_answerable') > 0 THEN 'partially_answerable:' || count(*) FILTER (WHERE answerability = 'partially_answerable') END) AS answerability_counts
FROM plans GROUP BY GROUPING SETS ((), (side), (side, topic))""")
def answer_plan_rollup(spark, sf_dir):
    return rollups.answer_plans(_plans(spark, sf_dir), ["side", "topic"])


@query("answer_plan_warnings", PLANS + r""",
warned AS (SELECT side, topic, split_part(unnest(warnings), ':', 1) AS warning FROM plans),
sets AS (SELECT side, topic, warning, (2 - (grouping(side) + grouping(topic)))::INT AS level, count(*) AS n FROM warned GROUP BY GROUPING SETS ((warning), (warning, side), (warning, side, topic))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY level, side, topic ORDER BY n DESC, warning) AS rank FROM sets)
SELECT side, topic, level, rank::INT AS rank, warning, n::BIGINT AS n FROM ordered WHERE rank <= 5""")
def answer_plan_warnings(spark, sf_dir):
    return rollups.warnings(_plans(spark, sf_dir), ["side", "topic"])


FILES = r"""old_ AS (SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 97 <> 5),
new_ AS (SELECT 'doc/' || doc_id AS path, sha256(coalesce(text, '') || CASE WHEN doc_id % 61 = 3 THEN '.' ELSE '' END) AS hash FROM documents WHERE doc_id % 89 <> 7)"""


def _snapshots(spark, sf_dir):
    """Two states of the documents: some came, some went, some were changed."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    changed = F.when(F.col("doc_id") % 61 == 3, ".").otherwise("")
    old = docs.filter("doc_id % 97 <> 5").select("path", F.sha2("text", 256).alias("hash"))
    return old, docs.filter("doc_id % 89 <> 7").select("path", F.sha2(F.concat("text", changed), 256).alias("hash"))


@query("snapshot_changes", f"""WITH {FILES}
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old_ o FULL JOIN new_ n ON o.path = n.path WHERE o.hash IS DISTINCT FROM n.hash""")
def snapshot_changes(spark, sf_dir):
    return snapshots.compared(*_snapshots(spark, sf_dir))


@query("stale_artifacts", f"""WITH {FILES}
SELECT o.path, CASE WHEN n.path IS NULL THEN 'missing_source' WHEN o.hash <> n.hash THEN 'content_changed' ELSE 'parser_changed' END AS reason FROM old_ o LEFT JOIN new_ n ON o.path = n.path
WHERE n.path IS NULL OR o.hash <> n.hash OR length(o.path) % 3 = 1""")
def stale_artifacts(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return snapshots.stale(old.withColumn("version", F.when(F.length("path") % 3 == 1, "v1").otherwise("v2")), new.withColumn("version", F.lit("v2")))


CHANGED = "documents AS (SELECT CASE WHEN doc_id % 11 = 4 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 2 THEN 'new words here ' || coalesce(text, '') ELSE text END AS text FROM documents_ WHERE doc_id % 13 <> 6)"


@query("incremental_bm25", "WITH documents_ AS (SELECT * FROM documents), " + CHANGED + ", " + WITH[5:] + """,
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), node_id) AS rank FROM bm25)
SELECT query_id, rank::INT AS rank, node_id, doc_id::VARCHAR AS doc_id, round(score, 6) AS score FROM best WHERE rank <= 8""")
def incremental_bm25(spark, sf_dir):
    """All documents, then a batch that changes some, deletes some and moves some
    to other names; searched without a rebuild."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = new_folder(spark, "lexical-index")
    put = lambda df: df.select("doc_id", F.lit("upsert").alias("op"), "text")
    index.apply_batch(spark, folder, 0, put(docs))
    left = docs.filter("doc_id % 13 <> 6").withColumn("text", F.when(F.col("doc_id") % 7 == 2, F.concat(F.lit("new words here "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    moved = left.filter("doc_id % 11 = 4")
    gone = docs.filter("doc_id % 13 = 6 OR doc_id % 11 = 4").select("doc_id", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"))
    index.apply_batch(spark, folder, 1, put(left.filter("doc_id % 7 = 2 AND doc_id % 11 <> 4")).unionByName(put(moved.withColumn("doc_id", F.col("doc_id") + 1_000_000_000))).unionByName(gone))
    return index.bm25(I.passages(spark, sf_dir), folder, 8)


WRITES = r"""
writes AS (SELECT 'conv-' || (conv_id % 3) AS scope, coalesce(role, '') AS type, 's' || (conv_id % 7) AS subject_key, conv_id * 1000 + turn AS seq, 1000000 + conv_id * 50000 + turn * 1000 - CASE WHEN turn % 5 = 4 THEN 120000 ELSE 0 END AS at_, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS content, (turn % 4) / 4.0::DOUBLE AS importance, CASE WHEN turn % 6 = 5 THEN 1000000 + conv_id * 50000 + 90000 END AS ttl, turn % 8 = 7 AS force FROM conversations)"""


def _writes(spark, sf_dir):
    """Conversation turns as memory writes: a few subjects, some late, some that
    expire, some forced."""
    at = F.lit(1_000_000) + F.col("conv_id") * 50_000 + F.col("turn") * 1000 - F.when(F.col("turn") % 5 == 4, 120_000).otherwise(0)
    return I.table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv-"), (F.col("conv_id") % 3).cast("string")).alias("scope"), F.coalesce("role", F.lit("")).alias("type"), F.concat(F.lit("s"), (F.col("conv_id") % 7).cast("string")).alias("subject_key"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), at.alias("at"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")).alias("content"),
        (F.col("turn") % 4 / 4.0).alias("importance"), F.lit(None).cast("double").alias("confidence"), F.when(F.col("turn") % 6 == 5, F.lit(1_000_000) + F.col("conv_id") * 50_000 + 90_000).alias("ttl"), F.lit("").alias("refs"), (F.col("turn") % 8 == 7).alias("force"),
    )


@query("memory_writes", "WITH RECURSIVE " + WRITES.strip() + r""",
placed AS (SELECT *, row_number() OVER (PARTITION BY scope, type, subject_key ORDER BY seq) AS n FROM writes),
fold AS (
  SELECT scope, type, subject_key, seq, n, 'accepted' AS action, at_, content, importance, ttl FROM placed WHERE n = 1
  UNION ALL
  SELECT w.scope, w.type, w.subject_key, w.seq, w.n,
    CASE WHEN w.at_ < f.at_ THEN 'late' WHEN w.force OR w.at_ >= f.ttl THEN 'accepted' ELSE 'merged' END,
    CASE WHEN w.at_ < f.at_ THEN f.at_ ELSE w.at_ END,
    CASE WHEN w.at_ < f.at_ THEN f.content WHEN w.force OR w.at_ >= f.ttl OR trim(regexp_replace(f.content, '\s+', ' ', 'g')) = '' THEN w.content WHEN w.content = '' OR contains(trim(regexp_replace(f.content, '\s+', ' ', 'g')), w.content) THEN trim(regexp_replace(f.content, '\s+', ' ', 'g')) WHEN contains(w.content, trim(regexp_replace(f.content, '\s+', ' ', 'g'))) THEN w.content ELSE trim(regexp_replace(f.content, '\s+', ' ', 'g')) || chr(10) || w.content END,
    CASE WHEN w.at_ < f.at_ THEN f.importance WHEN w.force OR w.at_ >= f.ttl THEN w.importance ELSE greatest(f.importance, w.importance) END,
    CASE WHEN w.at_ < f.at_ THEN f.ttl ELSE w.ttl END
  FROM fold f JOIN placed w ON w.scope = f.scope AND w.type = f.type AND w.subject_key = f.subject_key AND w.n = f.n + 1)
SELECT seq, scope, type, subject_key, action, sha256(content) AS sha, importance, ttl FROM fold""")
def memory_writes(spark, sf_dir):
    """What each write did, with the item after it."""
    return memory.folded(_writes(spark, sf_dir)).select("seq", "scope", "type", "subject_key", "action", F.sha2("content", 256).alias("sha"), "importance", "ttl")
