"""Queries: claim frames, alignment and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import frame_terms as C
from lexforge.functions import text as T
from lexforge.operators import frames as R
from lexforge.operators import lexical
from lexforge.plans import inputs as I
from lexforge.plans.q_facts import CLAIMS, _claims
from lexforge.plans.registry import query
from lexforge.sources.workspace import new_folder

METRICS = ["ertion", "enque", "ichver", "dela"]
FAMILIES = {"alpha": ["theand", "leque"], "beta": ["onth", "aux"], "gamma": ["chen", "ado"]}
NEGATIVE, POSITIVE = ["this", "pas", "nicht"], ["with", "avec", "mit"]


def _frames(spark, sf_dir):
    """All claims as frames."""
    rows, text = _claims(spark, sf_dir), F.col("text")
    return rows.select(
        F.col("fact_id").alias("frame_id"), "doc_id", F.col("type").alias("claim_type"), text.alias("short_claim"), "confidence", "source", "position",
        F.when(F.col("type") == "limitation", text).otherwise("").alias("problem"), F.when(F.col("type") == "method", text).otherwise("").alias("method"),
        F.lit("").alias("dataset_or_setting"), F.lit("").alias("metric_or_signal"), F.when(F.col("type") == "result", text).otherwise("").alias("result_or_gain"), F.when(F.col("type") == "limitation", text).otherwise("").alias("limitation"),
        (F.col("doc_id") % 4).cast("int").alias("n_units"), F.lit(0).alias("n_noise"), (((F.col("position") * 7 + F.col("doc_id")) % 10) / 10.0).alias("quality_score"),
        F.element_at(F.array(*[F.lit(x) for x in ("structurally_supported", "unchecked", "unsupported")]), (F.col("doc_id") % 3 + 1).cast("int")).alias("support_status"),
        F.element_at(F.array(*[F.lit(x) for x in STATUSES]), (F.col("doc_id") % 6 + 1).cast("int")).alias("semantic_support_status"),
    )


STATUSES = ["semantically_supported", "partially_supported", "related_only", "insufficient_evidence", "contradicted", "not_checked"]
FRAMES = CLAIMS + f""",
frames AS (SELECT fact_id AS frame_id, doc_id, type AS claim_type, text AS short_claim, confidence, position, type, doc_id % 4 AS n_units, ((position * 7 + doc_id) % 10) / 10.0::DOUBLE AS quality_score,
  (['structurally_supported','unchecked','unsupported'])[doc_id % 3 + 1] AS support_status, ({STATUSES})[doc_id % 6 + 1] AS semantic FROM keyed)"""


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("frame_normalize", FRAMES + f""",
hits AS (SELECT *, list_filter({_list(METRICS)}, lambda m: contains(lower(t), m)) AS h FROM (SELECT *, short_claim || CASE WHEN type = 'claim' THEN '' ELSE ' ' || short_claim END AS t FROM frames))
SELECT frame_id, CASE WHEN length(trim(regexp_replace(short_claim, '\\s+', ' ', 'g'))) <= 120 THEN trim(regexp_replace(short_claim, '\\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(short_claim, '\\s+', ' ', 'g')), 1, 120)) || '...' END AS normalized_subject,
  CASE WHEN {' OR '.join(f"contains(lower(t), '{w}')" for w in FAMILIES['alpha'])} THEN 'alpha' WHEN {' OR '.join(f"contains(lower(t), '{w}')" for w in FAMILIES['beta'])} THEN 'beta' WHEN {' OR '.join(f"contains(lower(t), '{w}')" for w in FAMILIES['gamma'])} THEN 'gamma' WHEN claim_type = 'method' THEN 'method_unspecified' ELSE '' END AS method_family,
  array_to_string(h, '、') AS metric,
  CASE WHEN claim_type = 'limitation' OR {' OR '.join(f"contains(t, '{w}')" for w in NEGATIVE)} THEN 'negative' WHEN {' OR '.join(f"contains(t, '{w}')" for w in POSITIVE)} THEN 'positive' ELSE 'neutral' END AS polarity FROM hits""")
def frame_normalize(spark, sf_dir):
    return _normal(spark, sf_dir).select("frame_id", "normalized_subject", "method_family", "metric", "polarity")


def _normal(spark, sf_dir):
    return _normalized(_frames(spark, sf_dir))


def _normalized(frames):
    return R.normalized(frames, FAMILIES, METRICS, NEGATIVE, POSITIVE)


SCORE = f"""
asked AS (SELECT item_id AS query_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{{2,}}') AS w FROM benchmark),
dedup AS (SELECT query_id, list_filter(w, lambda t, i: list_position(w, t) = i)[1:16] AS w FROM asked),
scored AS (SELECT query_id, frame_id, (2.0::DOUBLE + CASE claim_type WHEN 'method' THEN 1.5 WHEN 'result' THEN 1.3 WHEN 'limitation' THEN 2.4 ELSE 0 END) * len(list_filter(w, lambda t: contains(lower(short_claim), lower(t)))) + 0.2 * n_units + 0.3 * confidence + 0.5 * quality_score
  + CASE support_status WHEN 'structurally_supported' THEN 0.4 WHEN 'unchecked' THEN 0.15 ELSE -1.2 END + CASE semantic WHEN 'semantically_supported' THEN 0.6 WHEN 'partially_supported' THEN 0.25 WHEN 'related_only' THEN -0.5 WHEN 'insufficient_evidence' THEN -1.0 WHEN 'contradicted' THEN -2.0 ELSE 0 END AS score
  FROM dedup CROSS JOIN frames WHERE quality_score >= {C.MIN_QUALITY} AND support_status <> 'unsupported'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score::DOUBLE, 6) DESC, frame_id) AS rank FROM scored WHERE score > 0)"""


@query("frame_score", FRAMES + "," + SCORE + " SELECT query_id, rank::INT AS rank, frame_id, round(score::DOUBLE, 3) AS score FROM ranked WHERE rank <= 8")
def frame_score(spark, sf_dir):
    return R.search(I.passages(spark, sf_dir), _frames(spark, sf_dir), 8)


@query("frame_quality")
def frame_quality(spark, sf_dir):
    f = _frames(spark, sf_dir)
    score = R.quality_score(F.col("short_claim"), F.col("n_units"), F.lit("claim"), F.col("claim_type"), F.col("confidence"))
    f = f.select("frame_id", score.alias("score"))
    return f.select("frame_id", F.round("score", 3).alias("quality_score"), R.quality_level(F.col("score")).alias("frame_quality"))


TERMS3 = "list_distinct(regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9_-]{{2,}}'))"


STOP = ' AND lower(w) NOT IN (' + ", ".join(f"'{x}'" for x in C.SEMANTIC_STOP) + ')'
RISKS = " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in C.RISK.items())


@query("semantic_support", FRAMES + r""",
firsts AS (SELECT doc_id, node_id, text, order_index FROM nodes),
words(frame_id, w, p) AS (SELECT frame_id, unnest(w), unnest(range(len(w))) FROM (SELECT frame_id, regexp_extract_all(short_claim, '[A-Za-z][A-Za-z0-9_-]{2,}') AS w FROM frames)),
cterms AS (SELECT frame_id, list(w ORDER BY r) AS c FROM (SELECT frame_id, w, row_number() OVER (PARTITION BY frame_id ORDER BY min(p)) AS r FROM words GROUP BY frame_id, w) WHERE r <= 16{STOP} GROUP BY frame_id),
uwords(node_id, w, p) AS (SELECT node_id, unnest(w), unnest(range(len(w))) FROM (SELECT node_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}') AS w FROM firsts)),
uterms AS (SELECT node_id, list(w) AS u FROM (SELECT node_id, w, row_number() OVER (PARTITION BY node_id ORDER BY min(p)) AS r FROM uwords GROUP BY node_id, w) WHERE r <= 16{STOP} GROUP BY node_id),
pairs AS (SELECT f.frame_id, f.claim_type, f.short_claim AS claim, n.node_id, n.text AS unit, coalesce(c.c, []) AS c, coalesce(u.u, []) AS u FROM frames f JOIN firsts n ON f.doc_id = n.doc_id LEFT JOIN cterms c ON f.frame_id = c.frame_id LEFT JOIN uterms u ON n.node_id = u.node_id),
cored AS (SELECT *, CASE WHEN claim_type = 'claim' THEN c[1:8] ELSE c END AS k FROM pairs),
counted AS (SELECT *, len(list_intersect(c, u)) AS h, len(list_intersect(k, u)) AS s FROM cored),
scored AS (SELECT *, least(1.0, 0.55 * h / greatest(1, len(c)) + 0.35 * s / greatest(1, len(k)) + 0.06)::DOUBLE AS score, s / greatest(1, len(k)) AS cc, (h + s > 0) AND claim_type <> 'limitation' AND NOT contains(lower(claim), 'idiot') AND contains(lower(unit), 'idiot') AS x FROM counted),
per AS (SELECT frame_id, any_value(len(c)) AS n, max(score) AS best, max(score) FILTER (WHERE x) AS bc, max(cc) AS cc, max(s) AS s,
  list_sort(list(DISTINCT node_id) FILTER (WHERE score >= 0.5 AND (s > 0 OR h >= 3)))[1:8] AS prim, list_sort(list(DISTINCT node_id) FILTER (WHERE NOT (score >= 0.5 AND (s > 0 OR h >= 3)) AND (score >= 0.18 OR h > 0 OR s > 0)))[1:8] AS weak, list_sort(list(DISTINCT node_id) FILTER (WHERE x))[1:8] AS con FROM scored GROUP BY frame_id),
decided AS (SELECT *, CASE WHEN n = 0 THEN 'not_checked' WHEN len(con) > 0 THEN 'contradicted' WHEN len(prim) > 0 AND best >= 0.58 AND cc >= 0.65 AND s >= 2 THEN 'semantically_supported' WHEN len(prim) > 0 OR s > 0 THEN 'partially_supported' WHEN len(weak) > 0 THEN 'related_only' ELSE 'insufficient_evidence' END AS status FROM per)
SELECT frame_id, status, round(round(CASE status WHEN 'contradicted' THEN bc WHEN 'not_checked' THEN 0.0::DOUBLE WHEN 'insufficient_evidence' THEN 0.0::DOUBLE ELSE best END, 9), 3) AS score,
  CASE status {RISKS} ELSE 'not_checked' END AS citation_risk,
  CASE WHEN status IN ('semantically_supported', 'partially_supported') THEN coalesce(array_to_string(prim, ','), '') ELSE '' END AS "primary",
  CASE WHEN status IN ('semantically_supported', 'partially_supported', 'related_only') THEN coalesce(array_to_string(weak, ','), '') ELSE '' END AS weak,
  CASE WHEN status = 'contradicted' THEN array_to_string(con, ',') ELSE '' END AS contradictory FROM decided""".replace("{STOP}", STOP).replace("{RISKS}", RISKS))
def semantic_support(spark, sf_dir):
    return _support(_frames(spark, sf_dir), I.lines(spark, sf_dir))


def _support(frames, lines):
    units = lines.select("doc_id", F.col("node_id").alias("unit_id"), F.col("text").alias("unit"), F.lit(0.6).alias("confidence"))
    return R.semantic_support(frames, units, ["idiot"])


def _aligned(spark, sf_dir):
    """The eight frames that each benchmark item finds, in normal form."""
    found = R.search(I.passages(spark, sf_dir), _frames(spark, sf_dir), 8).select("query_id", "frame_id")
    n = _normalized(_frames(spark, sf_dir).join(F.broadcast(found), "frame_id"))  # at most eight for each item, so only those are brought to normal form
    return n.select(
        "query_id", "claim_type", "frame_id", "doc_id", (F.col("doc_id") * 10 + F.col("position")).alias("position"), "polarity",
        F.when(F.col("metric") == "", F.array().cast("array<string>")).otherwise(F.split("metric", "、")).alias("metric_terms"), T.terms(F.col("condition")).alias("setting_terms"),
        F.slice(F.filter(T.terms(F.lower("normalized_subject")), lambda t: F.length(t) >= 8), 1, 8).alias("subject_terms"), F.when(F.col("method_family") == "method_unspecified", "").otherwise(F.col("method_family")).alias("method_family"),
    )


@query("claim_alignment")
def claim_alignment(spark, sf_dir):
    return R.align(_aligned(spark, sf_dir))


@query("claim_relations")
def claim_relations(spark, sf_dir):
    folder = new_folder(spark, "aligned")
    _aligned(spark, sf_dir).write.parquet(folder)  # read by both sides of the relations and by their groups
    rows = spark.read.parquet(folder)
    return R.relations(rows, R.align(rows))


BUCKETS = FRAMES + """,
items AS (SELECT doc_id % 50 AS query_id, doc_id, frame_id, short_claim, confidence AS score, semantic AS s, CASE semantic WHEN 'semantically_supported' THEN 'safe' WHEN 'partially_supported' THEN 'needs_qualification' WHEN 'contradicted' THEN 'conflicting_evidence' WHEN 'not_checked' THEN 'not_checked' ELSE 'needs_more_evidence' END AS r FROM frames),
bucketed AS (SELECT DISTINCT query_id, doc_id, frame_id, short_claim, score, CASE WHEN s = 'semantically_supported' AND r = 'safe' THEN 'strong_claims' WHEN s = 'partially_supported' AND r = 'needs_qualification' THEN 'qualified_claims' WHEN s = 'contradicted' OR r = 'conflicting_evidence' THEN 'conflicting_claims' WHEN s = 'insufficient_evidence' THEN 'insufficient_claims' WHEN s = 'related_only' THEN 'related_claims' ELSE 'unchecked_claims' END AS bucket FROM items),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY score DESC, frame_id, short_claim) AS rank FROM bucketed),
kept AS (SELECT * FROM ranked WHERE rank <= 8)"""


def _buckets(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return R.answer_buckets(f.select((F.col("doc_id") % 50).alias("query_id"), "doc_id", "frame_id", "short_claim", F.col("confidence").alias("score"), "semantic_support_status", R.risk(F.col("semantic_support_status")).alias("citation_risk")))


@query("answer_buckets", BUCKETS + " SELECT query_id, bucket, rank::INT AS rank, frame_id, score FROM kept")
def answer_buckets(spark, sf_dir):
    return _buckets(spark, sf_dir)


@query("answerability", BUCKETS + """
SELECT query_id, CASE WHEN bool_or(bucket = 'conflicting_claims') THEN 'conflicting' WHEN bool_or(bucket = 'strong_claims') THEN 'answerable' WHEN bool_or(bucket = 'qualified_claims') THEN 'partially_answerable' ELSE 'insufficient_evidence' END AS answerability,
  concat_ws(',', CASE WHEN bool_or(bucket = 'conflicting_claims') THEN 'answer_plan_conflicting_claims' END, CASE WHEN bool_or(bucket = 'insufficient_claims') AND NOT bool_or(bucket IN ('strong_claims', 'qualified_claims')) THEN 'answer_plan_insufficient_evidence' END, CASE WHEN bool_or(bucket = 'unchecked_claims') THEN 'answer_plan_unchecked_claims' END) AS warnings FROM kept GROUP BY query_id""")
def answerability(spark, sf_dir):
    return R.answerability(_buckets(spark, sf_dir))

