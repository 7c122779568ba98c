"""Queries: terms, lexical search, vector search, fusion and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import config as C
from lexforge.functions import text as T
from lexforge.operators import hybrid, lexical, vector
from lexforge.plans import inputs as I
from lexforge.plans.registry import query

WITH = "WITH " + ",\n".join([I.SQL_CHUNKS, I.SQL_PASSAGES, I.SQL_QUERY_TERMS, I.SQL_BM25])


@query("bm25_topk", WITH + """,
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), node_id) AS rank FROM bm25)
SELECT query_id, rank::INT AS rank, node_id, doc_id, round(score, 6) AS score FROM best WHERE rank <= 8""")
def bm25_topk(spark, sf_dir):
    return lexical.fts_nodes(I.passages(spark, sf_dir), I.chunks(spark, sf_dir), 8)


@query("fts_doc_rollup", WITH + """,
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), node_id) AS r FROM bm25) WHERE r <= 200),
docs AS (SELECT query_id, doc_id, count(*) AS node_matches, round(min(score), 9) AS best FROM top GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, node_matches DESC, doc_id) AS rank FROM docs)
SELECT query_id, rank::INT AS rank, doc_id, node_matches, round(best, 6) AS score FROM ranked WHERE rank <= 8""")
def fts_doc_rollup(spark, sf_dir):
    return lexical.fts_documents(I.passages(spark, sf_dir), I.chunks(spark, sf_dir), 8)


FALLBACK = r"""found AS (SELECT query_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]{2,}') AS w FROM queries)),
terms AS (SELECT query_id, lower(term) AS term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS r FROM found GROUP BY query_id, term) WHERE r <= 10)"""


@query("like_fallback", "WITH " + ",\n".join([I.SQL_CHUNKS, I.SQL_PASSAGES, FALLBACK]) + """,
hits AS (SELECT DISTINCT query_id, node_id, doc_id, order_index FROM terms JOIN nodes ON contains(lower(nodes.text), terms.term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY order_index, node_id) AS rank FROM hits)
SELECT query_id, rank::INT AS rank, node_id, doc_id, 0.0::DOUBLE AS score FROM ranked WHERE rank <= 8""")
def like_fallback(spark, sf_dir):
    return lexical.contains_nodes(I.passages(spark, sf_dir), I.chunks(spark, sf_dir), 8)


@query("fts_with_fallback", WITH + ",\n" + FALLBACK + """,
best AS (SELECT * FROM (SELECT query_id, node_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), node_id) AS r FROM bm25) WHERE r <= 8),
hits AS (SELECT DISTINCT query_id, node_id, doc_id, order_index FROM terms JOIN nodes ON contains(lower(nodes.text), terms.term)),
rest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY order_index, node_id) AS r FROM hits) h WHERE r <= 24 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.query_id = h.query_id AND b.node_id = h.node_id)),
both_ AS (SELECT query_id, node_id, doc_id, score, 0 AS part, r FROM best UNION ALL SELECT query_id, node_id, doc_id, 0.0, 1, r FROM rest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, r, node_id) AS rank FROM both_)
SELECT query_id, rank::INT AS rank, node_id, doc_id, score::DOUBLE AS score FROM ranked WHERE rank <= 16""")
def fts_with_fallback(spark, sf_dir):
    asked, nodes = I.passages(spark, sf_dir), I.chunks(spark, sf_dir)
    return lexical.filled(lexical.fts_nodes(asked, nodes, 8), lexical.contains_nodes(asked, nodes, 24), 16)


@query("fts_query_text", "WITH " + I.SQL_PASSAGES + r""",
asked AS (SELECT query_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT query_id, regexp_extract_all(query, '[\p{L}\p{N}_]+') AS w FROM queries)),
firsts AS (SELECT query_id, token, min(pos) AS p, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS r FROM asked GROUP BY query_id, token)
SELECT query_id, string_agg(token, ' OR ' ORDER BY p) AS fts_query FROM firsts WHERE r <= 16 GROUP BY query_id""")
def fts_query_text(spark, sf_dir):
    return I.passages(spark, sf_dir).select("query_id", T.fts_query(F.col("query")).alias("fts_query"))


@query("keywords_top10", r"""
WITH found AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]{2,}') AS w FROM documents)),
firsts AS (SELECT doc_id, lower(word) AS low, arg_min(word, pos) AS word, min(pos) AS pos FROM found WHERE lower(word) NOT IN ('the','and','for','with','from','this','that','are','was','into','about') GROUP BY doc_id, lower(word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM firsts)
SELECT doc_id, string_agg(word, ' ' ORDER BY r) AS keywords FROM ranked WHERE r <= 10 GROUP BY doc_id""")
def keywords_top10(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(T.keywords(T.text_of("text")), " ").alias("keywords")).filter("keywords <> ''")


@query("focus_terms", "WITH " + I.SQL_TURNS + r""",
found AS (SELECT query_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z0-9_-]{2,}') AS w FROM queries)),
firsts AS (SELECT query_id, arg_min(word, pos) AS word, min(pos) AS pos FROM found WHERE lower(word) NOT IN ('the','does','what','which','paper','use','uses','used') GROUP BY query_id, lower(word)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM firsts)
SELECT query_id, string_agg(word, ' ' ORDER BY r) AS terms FROM ranked WHERE r <= 14 GROUP BY query_id""")
def focus_terms(spark, sf_dir):
    return I.turns(spark, sf_dir).select("query_id", F.array_join(T.focus_terms(F.col("query")), " ").alias("terms"))


def _sql_intent(column: str) -> str:
    branches = " ".join(f"WHEN {' OR '.join(f'contains({column}, {chr(39)}{t.lower()}{chr(39)})' for t in C.INTENT_TRIGGERS[name])} THEN '{name}'" for name in C.INTENT_PRIORITY)
    return f"CASE {branches} ELSE 'qa' END"


@query("intent_classify", "WITH " + I.SQL_TURNS + f"SELECT query_id, {_sql_intent('lower(query)')} AS intent FROM queries")
def intent_classify(spark, sf_dir):
    return hybrid.classify(I.turns(spark, sf_dir)).select("query_id", "intent")


@query("query_profile")
def query_profile(spark, sf_dir):
    return hybrid.classify(I.turns(spark, sf_dir))


@query("fusion_profile", "WITH " + I.SQL_TURNS + f""",
kinds AS (SELECT query_id, {_sql_intent('lower(query)')} AS intent, regexp_matches(query, '[0-9]') OR {' OR '.join(f"contains(lower(query), '{w}')" for w in C.METRIC_WORDS)} AS exact FROM queries)
SELECT query_id, intent, CASE WHEN intent = 'citation' THEN 'fts_reference_boost' WHEN exact OR intent = 'experiment' THEN 'fts_metric_boost' ELSE 'semantic_vector_boost' END AS weighting,
  CASE WHEN intent = 'citation' THEN 1.25::DOUBLE WHEN exact OR intent = 'experiment' THEN 1.15::DOUBLE ELSE 0.85::DOUBLE END AS fts_weight,
  CASE WHEN intent = 'citation' THEN 0.75::DOUBLE WHEN exact OR intent = 'experiment' THEN 0.85::DOUBLE ELSE 1.15::DOUBLE END AS vector_weight FROM kinds""")
def fusion_profile(spark, sf_dir):
    return I.turns(spark, sf_dir).select("query_id", hybrid.fusion_profile(F.col("query")).alias("p")).select("query_id", "p.*")


SQL_HASH = r"""toks AS (SELECT id, unnest(w[1:1000]) AS token FROM (SELECT id, regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{1,}') AS w FROM rows_)),
cells AS (SELECT id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 256 AS idx, sum(CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS value FROM toks GROUP BY 1, 2)"""


@query("hash_embed", "WITH rows_ AS (SELECT doc_id AS id, text FROM documents),\n" + SQL_HASH + " SELECT id AS doc_id, idx::INT AS idx, value::BIGINT AS value FROM cells WHERE value <> 0")
def hash_embed(spark, sf_dir):
    return vector.hash_features(I.table(spark, sf_dir, "documents"), "doc_id", T.text_of("text"))


@query("vector_topk", """
WITH pairs AS (SELECT q.vec_id AS query_id, n.vec_id AS node_id, list_inner_product(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM pairs WHERE score > 0)
SELECT query_id, rank::INT AS rank, node_id, round(score, 6) AS score FROM ranked WHERE rank <= 8""")
def vector_topk(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vector"))
    asked = rows.filter("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), "vector")
    found = vector.vector_top_k(asked, rows, 9).filter("query_id <> node_id")
    return lexical.ranked(found.drop("rank"), 8, F.round("score", 9).desc(), F.col("node_id")).select("query_id", "rank", "node_id", F.round("score", 6).alias("score"))


HYBRID = WITH + r""",
rows_ AS (SELECT node_id AS id, text FROM nodes UNION ALL SELECT 'q' || query_id, query FROM queries),
""" + SQL_HASH + r""",
norms AS (SELECT id, sqrt(sum(value * value)) AS norm FROM cells GROUP BY id),
units AS (SELECT id, idx, round(value / norm, 8) AS x FROM cells JOIN norms USING (id) WHERE value <> 0),
cosines AS (SELECT substr(q.id, 2)::BIGINT AS query_id, n.id AS node_id, sum(q.x * n.x) AS score FROM units q JOIN units n USING (idx) WHERE q.id LIKE 'q%' AND n.id NOT LIKE 'q%' GROUP BY 1, 2),
vec AS (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS r FROM cosines WHERE score > 0) WHERE r <= 32),
fts AS (SELECT * FROM (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), node_id) AS r FROM bm25) WHERE r <= 32),
fused AS (SELECT coalesce(f.query_id, v.query_id) AS query_id, coalesce(f.node_id, v.node_id) AS node_id, f.r AS fts_rank, v.r AS vector_rank FROM fts f FULL OUTER JOIN vec v ON f.query_id = v.query_id AND f.node_id = v.node_id),
weights AS (SELECT query_id, CASE WHEN regexp_matches(query, '[0-9]') THEN 1.15::DOUBLE ELSE 0.85::DOUBLE END AS fw, CASE WHEN regexp_matches(query, '[0-9]') THEN 0.85::DOUBLE ELSE 1.15::DOUBLE END AS vw FROM queries),
scored AS (SELECT *, coalesce(fw / (60 + fts_rank), 0) + coalesce(vw / (60 + vector_rank), 0) AS s FROM fused JOIN weights USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, node_id) AS rank FROM scored)
"""


@query("hybrid_rrf", HYBRID + """
SELECT query_id, rank::INT AS rank, node_id, fts_rank::INT AS fts_rank, vector_rank::INT AS vector_rank, round(s, 6) AS hybrid_score,
  CASE WHEN fts_rank IS NULL THEN 'vector_without_fts' WHEN vector_rank IS NULL THEN 'fts_without_vector' WHEN abs(fts_rank - vector_rank) >= 8 THEN 'rank_divergence' ELSE '' END AS hybrid_conflict
FROM ranked WHERE rank <= 8""")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).select("query_id", "rank", "node_id", "fts_rank", "vector_rank", F.round("hybrid_score", 6).alias("hybrid_score"), "hybrid_conflict")


def _hybrid(spark, sf_dir, k=8):
    asked, nodes = I.passages(spark, sf_dir), I.chunks(spark, sf_dir)
    fts = lexical.best_nodes(asked, nodes, 32)
    text = T.text_of("text")
    found = vector.vector_top_k(vector.hash_embeddings(asked.withColumnRenamed("query", "text"), "query_id", text), vector.hash_embeddings(nodes, "node_id", text), 32)
    profiles = asked.select("query_id", hybrid.fusion_profile(F.col("query")).alias("p")).select("query_id", "p.fts_weight", "p.vector_weight")
    return hybrid.fuse(fts, found, profiles, k=k)


@query("hybrid_documents", HYBRID + """,
top AS (SELECT query_id, node_id, split_part(node_id, ':', 1)::BIGINT AS doc_id, round(s, 9) AS s FROM ranked WHERE rank <= 20),
docs AS (SELECT query_id, doc_id, count(*) AS node_matches, max(s) AS score FROM top GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_matches DESC, doc_id) AS place FROM docs)
SELECT query_id, place::INT AS rank, doc_id, node_matches, round(score, 6) AS score FROM placed WHERE place <= 8""")
def hybrid_documents(spark, sf_dir):
    found = _hybrid(spark, sf_dir, 20).select("query_id", "node_id", F.split("node_id", ":")[0].cast("long").alias("doc_id"), F.round("hybrid_score", 9).alias("score"))
    return hybrid.hybrid_documents(found, 8).select("query_id", "rank", "doc_id", "node_matches", F.round("score", 6).alias("score"))


@query("rerank_penalty", "WITH " + I.SQL_CHUNKS + r""",
rows_ AS (SELECT node_id, order_index, (['section','abstract','page','document','reference','paragraph'])[order_index % 6 + 1] AS type, substr(text, 1, 500) AS ctx, text, coalesce(l.quality, 1) = 0 AS weak FROM nodes LEFT JOIN labels l USING (doc_id)),
flags AS (SELECT *, contains(replace(ctx, ' ', ''), 'doi') OR contains(replace(ctx, ' ', ''), 'issn') OR regexp_matches(ctx, '\.{4,}|…{2,}') AS front, contains(ctx, 'tion') AS exact FROM rows_)
SELECT node_id, type, round((CASE WHEN type IN ('document','page') THEN 0.004 ELSE 0 END + CASE WHEN type = 'reference' THEN 0.006 ELSE 0 END + CASE WHEN front THEN 0.006 ELSE 0 END - CASE WHEN exact THEN 0.006 ELSE 0 END - CASE WHEN type IN ('section','abstract') THEN 0.002 ELSE 0 END + CASE WHEN weak THEN 0.004 ELSE 0 END)::DOUBLE, 6) AS penalty,
  (CASE WHEN type IN ('document','page') THEN 3 ELSE 0 END + CASE WHEN type = 'reference' THEN 3 ELSE 0 END + CASE WHEN front THEN 3 ELSE 0 END - CASE WHEN exact THEN 3 ELSE 0 END - CASE WHEN type IN ('section','abstract') THEN 1 ELSE 0 END)::INT AS order_penalty
FROM flags""")
def rerank_penalty(spark, sf_dir):
    types = F.array(*[F.lit(x) for x in ("section", "abstract", "page", "document", "reference", "paragraph")])
    labels = I.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = I.chunks(spark, sf_dir).join(labels, "doc_id", "left").select("node_id", F.element_at(types, F.col("order_index") % 6 + 1).alias("type"), F.substring("text", 1, 500).alias("ctx"), (F.coalesce("quality", F.lit(1)) == 0).alias("weak"))
    asked = F.lit("tion")
    return rows.select("node_id", "type", F.round(hybrid.rerank(asked, F.col("type"), F.col("ctx"), F.col("weak"))["penalty"], 6).alias("penalty"), lexical.rank_penalty(asked, F.col("type"), F.col("ctx")).alias("order_penalty"))


@query("routing_score", "WITH " + I.SQL_PASSAGES + ",\n" + FALLBACK.replace("terms AS", "first10 AS") + r""",
wanted AS (SELECT DISTINCT query_id, lower(term) AS term FROM found),
docs AS (SELECT doc_id, lower(source) AS title, lower(text) AS abstract, lower(lang) AS keywords FROM documents),
hits AS (SELECT query_id, doc_id, contains(title, term)::INT AS a, contains(abstract, term)::INT AS b, contains(keywords, term)::INT AS c FROM wanted JOIN docs ON contains(title, term) OR contains(abstract, term) OR contains(keywords, term)),
scored AS (SELECT query_id, doc_id, round(3.0::DOUBLE * least(6, sum(a)) + 2.5::DOUBLE * least(6, sum(b)) + 2.0::DOUBLE * least(6, sum(c)), 3) AS routing_score FROM hits GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY routing_score DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, doc_id, routing_score FROM ranked WHERE rank <= 8""")
def routing_score(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), F.col("lang").alias("keywords"))
    return hybrid.route(I.passages(spark, sf_dir), docs, k=8).select("query_id", "rank", "doc_id", "routing_score")


@query("embedding_coverage", """
WITH hashed AS (SELECT doc_id AS id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents),
idx AS (SELECT id, h FROM hashed WHERE id % 3 <> 0)
SELECT count(*) AS n_rows, count(i.id) AS n_embedded, 256 AS dim, round(count(i.id) / count(*), 4) AS coverage, count(i.id) < count(*) AS needs_rebuild FROM hashed r LEFT JOIN idx i ON r.id = i.id AND r.h = i.h""".replace("\\\\", "\\"))
def embedding_coverage(spark, sf_dir):
    rows = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    two_thirds = vector.build_index(rows.filter("id % 3 <> 0"), None)  # the index as it might be, a third of the rows missing
    return vector.index_status(rows, two_thirds)


@query("embedding_incremental", """
WITH hashed AS (SELECT doc_id AS id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents)
SELECT id, h AS content_hash, 'hash' AS provider, id % 4 <> 0 AS reused FROM hashed""".replace("\\\\", "\\"))
def embedding_incremental(spark, sf_dir):
    rows = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    changed = rows.withColumn("text", F.when(F.col("id") % 4 == 0, F.concat(F.lit("old "), "text")).otherwise(F.col("text")))
    before = vector.build_index(changed, None).withColumn("model", F.lit("hash-ngram-v1"))
    after = vector.build_index(rows, before)
    same = after.join(before.select("id", "content_hash").withColumn("reused", F.lit(True)), ["id", "content_hash"], "left")
    return same.select("id", "content_hash", "provider", F.coalesce("reused", F.lit(False)).alias("reused"))
