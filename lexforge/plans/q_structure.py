"""Queries: tables recovered from captions, and citation maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.functions import fact_terms
from lexforge.operators import citations, outline, recovery, rule_facts
from lexforge.operators.tables import METRIC
from lexforge.plans import inputs as I
from lexforge.plans.registry import query
from lexforge.sources.workspace import new_folder


def _order_blocks(spark, sf_dir):
    """Orders as documents: captions, bodies of three kinds, headings, figures
    and prose, three blocks a line."""
    l = I.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")  # noqa: E741
    place = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    n, s = F.row_number().over(place), lambda c: F.col(c).cast("string")
    rows = l.select("doc_id", n.alias("n"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("p"), F.round(F.col("l_discount") * 100).cast("int").alias("d"))
    cat = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    head = F.col("l_partkey") % 4 == 0
    first = F.struct(F.when(head, "heading").otherwise("table").alias("kind"), F.when(head, cat("Part ", s("l_partkey"))).otherwise(cat("Table ", s("n"), "  flags ", F.col("l_returnflag"))).alias("text"))
    kind = F.col("l_suppkey") % 3
    second = F.struct(
        F.when(kind == 2, "table").otherwise("paragraph").alias("kind"),
        F.when(kind == 0, cat("nothing of note for ", F.col("l_returnflag")))
        .when(kind == 1, cat("flag quantity price\n", F.col("l_returnflag"), " ", s("q"), " ", s("p"), "\n", F.col("l_linestatus"), " ", s("d"), " ", s("q")))
        .otherwise(cat("| name | accuracy |\n|---|:--|\n| q | ", s("q"), " |\n| ", F.col("l_linestatus"), " |")).alias("text"),
    )
    last = F.col("n") % 3
    third = F.struct(F.when(last == 1, "figure").otherwise("paragraph").alias("kind"), F.when(last == 0, cat("ours ", s("q"), " ", s("p"), " baseline ", s("d"), " ms")).when(last == 1, F.lit("Figure 1")).otherwise(F.lit("prose goes on here")).alias("text"))
    each = rows.select("doc_id", "n", F.posexplode(F.array(first, second, third)).alias("k", "b"))
    return each.select("doc_id", (F.col("n") * 3 + F.col("k")).alias("position"), "b.kind", "b.text")


def _cells_sql(line: str) -> str:
    cells = f"list_filter(list_transform(string_split({line}, CASE WHEN contains({line}, '|') THEN '|' ELSE ' ' END), lambda c: trim(c)), lambda c: c <> '')"
    return f"list_filter([{cells}], lambda v: len(v) >= 3 OR len(v) = 2 AND len(list_filter(v, lambda c: regexp_matches(c, '\\d') OR regexp_matches(c, '{METRIC}'))) > 0)"


def _rows_sql(source: str, name: str) -> str:
    """A step that adds ``grid`` to the rows of ``source`` (with ``text``)."""
    return rf"""{name}_l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(trim(x), '^\|+|\|+$', '', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '[:：|\-\s]+')) AS ls, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM {source}),
{name}_r AS (SELECT *, flatten(list_transform(ls, lambda line: {_cells_sql('line')})) AS r, list_filter(range(len(ws)), lambda i: regexp_matches(ws[i + 1], '\d')) AS nums FROM {name}_l),
{name} AS (SELECT * EXCLUDE (ls, ws, r, nums), CASE WHEN len(r) >= 2 OR contains(text, chr(10)) THEN r WHEN len(ws) >= 6 AND len(nums) >= 2 THEN list_filter(list_transform(range(((len(ws) + greatest(2, least(6, nums[1] + 1)) - 1) // greatest(2, least(6, nums[1] + 1)))::BIGINT), lambda k: ws[(k * greatest(2, least(6, nums[1] + 1)) + 1):(k * greatest(2, least(6, nums[1] + 1)) + greatest(2, least(6, nums[1] + 1)))]), lambda x: len(x) >= 2) ELSE [] END AS grid FROM {name}_r)"""


def _found_sql(source: str, name: str) -> str:
    return _rows_sql(source, f"{name}_g") + rf""",
{name}_b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS i, kind = 'table' AND regexp_matches(text, '{recovery.CAPTION}') AS caption, kind IN ('heading', 'figure', 'reference') AS ends FROM {name}_g),
{name}_c AS (SELECT *, coalesce(kind = 'table' AND NOT caption OR kind = 'paragraph' AND len(grid) >= 2, false) AS body FROM {name}_b),
{name}_a AS (SELECT c.doc_id, c.position, b.i - c.i AS off, b.ends, b.body, b.position AS there, b.text FROM {name}_c c JOIN {name}_c b ON c.caption AND b.doc_id = c.doc_id AND b.i BETWEEN c.i + 1 AND c.i + 7),
{name}_s AS (SELECT *, min(off) FILTER (WHERE body) OVER w AS first_body, coalesce(min(off) FILTER (WHERE ends) OVER w, 8) AS stop FROM {name}_a WINDOW w AS (PARTITION BY doc_id, position)),
{name}_t AS (SELECT *, coalesce(min(off) FILTER (WHERE NOT body AND off > first_body) OVER (PARTITION BY doc_id, position), 8) AS gap FROM {name}_s),
{name}_u AS (SELECT doc_id, position, list(there ORDER BY off) AS at_blocks, string_agg(text, chr(10) ORDER BY off) AS text FROM {name}_t WHERE body AND off < stop AND off < gap GROUP BY doc_id, position),
""" + _rows_sql(f"{name}_u", name)


ORDER_BLOCKS = r"""
lined AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS n, l_partkey, l_suppkey, l_returnflag AS f, l_linestatus AS s, l_quantity::INT AS q, round(l_extendedprice * 100)::BIGINT AS p, round(l_discount * 100)::INT AS d FROM lineitem),
blocks AS (
  SELECT doc_id, n * 3 AS position, CASE WHEN l_partkey % 4 = 0 THEN 'heading' ELSE 'table' END AS kind, CASE WHEN l_partkey % 4 = 0 THEN 'Part ' || l_partkey ELSE 'Table ' || n || '  flags ' || f END AS text FROM lined
  UNION ALL SELECT doc_id, n * 3 + 1, CASE WHEN l_suppkey % 3 = 2 THEN 'table' ELSE 'paragraph' END, CASE l_suppkey % 3 WHEN 0 THEN 'nothing of note for ' || f WHEN 1 THEN 'flag quantity price' || chr(10) || f || ' ' || q || ' ' || p || chr(10) || s || ' ' || d || ' ' || q ELSE '| name | accuracy |' || chr(10) || '|---|:--|' || chr(10) || '| q | ' || q || ' |' || chr(10) || '| ' || s || ' |' END FROM lined
  UNION ALL SELECT doc_id, n * 3 + 2, CASE WHEN n % 3 = 1 THEN 'figure' ELSE 'paragraph' END, CASE n % 3 WHEN 0 THEN 'ours ' || q || ' ' || p || ' baseline ' || d || ' ms' WHEN 1 THEN 'Figure 1' ELSE 'prose goes on here' END FROM lined),
one_line AS (SELECT doc_id, position, kind, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM blocks),
ids AS (SELECT doc_id, position, 'table_' || lpad(n::VARCHAR, greatest(3, len(n::VARCHAR))::INT, '0') AS table_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM blocks WHERE kind = 'table'))"""

RECOVERED = "WITH " + ORDER_BLOCKS + ",\n" + _found_sql("blocks", "whole") + ",\n" + _found_sql("one_line", "flat") + r""",
every AS (SELECT * FROM whole WHERE len(grid) > 0 UNION ALL SELECT * FROM flat WHERE len(grid) > 0 AND (doc_id, position) NOT IN (SELECT (doc_id, position) FROM whole WHERE len(grid) > 0)),
made AS (SELECT *, len(grid) >= 2 AND len(list_filter(grid[1], lambda c: regexp_matches(c, '\d'))) = 0 AS head, list_max(list_transform(grid, lambda r: len(r))) AS wide FROM every)"""


def _recovered(spark, sf_dir):
    return recovery.recovered(_order_blocks(spark, sf_dir))


@query("recovered_tables", RECOVERED + r"""
SELECT doc_id, table_id, caption, array_to_string(at_blocks, ',') AS content, CASE WHEN head THEN array_to_string(grid[1], '|') ELSE '' END AS headers, array_to_string(list_transform(CASE WHEN head THEN grid[2:] ELSE grid END, lambda r: array_to_string(r, '|')), '/') AS cells,
  (len(grid) - head::INT)::INT AS row_count, wide::INT AS column_count, list_sum(list_transform(grid, lambda r: len(r)))::INT AS cell_count, CASE WHEN len(grid) < 2 OR wide < 2 THEN 0.58::DOUBLE ELSE 0.68::DOUBLE END AS confidence, CASE WHEN len(grid) < 2 OR wide < 2 THEN 'weak_table_structure' ELSE '' END AS warnings
FROM made JOIN ids USING (doc_id, position)""")
def recovered_tables(spark, sf_dir):
    bar = lambda c: F.array_join(c, "|")
    out = _recovered(spark, sf_dir)
    return out.select("doc_id", "table_id", "caption", F.array_join(F.col("content_positions").cast("array<string>"), ",").alias("content"), bar("headers").alias("headers"), F.array_join(F.transform("rows", bar), "/").alias("cells"), "row_count", "column_count", "cell_count", "confidence", F.array_join("warnings", ",").alias("warnings"))


@query("table_parse_scores", RECOVERED + r""",
items AS (SELECT doc_id, count(*) AS captions FROM blocks WHERE kind = 'table' AND regexp_matches(text, '^Table') GROUP BY doc_id),
good AS (SELECT doc_id, count(*) FILTER (WHERE len(grid) - head::INT > 0 AND wide > 1) AS complete FROM made GROUP BY doc_id)
SELECT doc_id, captions, coalesce(complete, 0) AS complete, round(coalesce(complete, 0) / captions, 2) AS score FROM items LEFT JOIN good USING (doc_id)""")
def table_parse_scores(spark, sf_dir):
    return recovery.block_scores(_order_blocks(spark, sf_dir))


@query("table_cells", RECOVERED + r""",
lined2 AS (SELECT doc_id, position, unnest(CASE WHEN head THEN grid[2:] ELSE grid END) AS r, unnest(range(len(grid) - head::INT)) AS row_index, CASE WHEN head THEN grid[1] ELSE [] END AS h FROM made)
SELECT doc_id, table_id, row_index::INT AS row_index, column_index::INT AS column_index, text, h[column_index + 1] AS header FROM (SELECT doc_id, position, row_index, h, unnest(r) AS text, unnest(range(len(r))) AS column_index FROM lined2) JOIN ids USING (doc_id, position)""")
def table_cells(spark, sf_dir):
    return recovery.grid_cells(_recovered(spark, sf_dir))


#: Common words of the four languages stand for marks, so every text has some.
MARKS = {"the": "[1]", "der": "[2, 4]", "que": "[1-3]", "de": "[7]", "and": "[0, 1]", "und": "[5-4]", "es": "[3-4, 12]"}
FOURTH = "order_index % 4 = 3"


def _cited_nodes(spark, sf_dir):
    """Lines of documents, with marks; every fourth is a line of a reference list,
    of which some go on and some are noise."""
    l = I.lines(spark, sf_dir)  # noqa: E741
    text = F.col("text")
    for word, mark in MARKS.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {mark} "))
    n = F.floor(F.col("order_index") / 4)
    entry = F.when(n % 5 == 4, F.concat(F.lit("....... "), F.col("text"))).when(n % 3 == 2, F.col("text")).otherwise(F.concat(F.lit("["), (n + 1).cast("string"), F.lit("] "), F.col("text"), F.lit(" 1999")))
    listed = F.col("order_index") % 4 == 3
    return l.select("doc_id", "node_id", "order_index", F.when(listed, "reference").otherwise("paragraph").alias("kind"), F.when(listed, "References").otherwise("").alias("node_path"), F.when(listed, entry).otherwise(text).alias("text"))


def _marked_sql() -> str:
    out = "text"
    for word, mark in MARKS.items():
        out = f"replace({out}, ' {word} ', ' {mark} ')"
    return out


COMPACT = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
CITED = "WITH " + I.SQL_LINES + rf""",
listed AS (SELECT doc_id, order_index, order_index // 4 AS n, {COMPACT.format(c='text')} AS t FROM nodes WHERE {FOURTH}),
entries AS (SELECT doc_id, order_index, trim(CASE WHEN n % 5 = 4 THEN '....... ' || t WHEN n % 3 = 2 THEN t ELSE '[' || (n + 1) || '] ' || t || ' 1999' END) AS line FROM listed),
cut AS (SELECT doc_id, order_index, unnest(p) AS line, unnest(range(len(p))) AS part FROM (SELECT doc_id, order_index, list_filter(string_split(regexp_replace(line, '\s+(\[\d{{1,3}}\])', chr(10) || '\1', 'g'), chr(10)), lambda x: trim(x) <> '') AS p FROM entries)),
clean AS (SELECT doc_id, order_index, part, trim(line) AS line FROM cut WHERE NOT regexp_matches(line, '\.{{4,}}|…{{2,}}')),
kinds AS (SELECT *, coalesce(TRY_CAST(regexp_extract(line, '^(?:\[(\d{{1,3}})\]|(\d{{1,3}})[.)、])\s*.+', 1) || regexp_extract(line, '^(?:\[(\d{{1,3}})\]|(\d{{1,3}})[.)、])\s*.+', 2) AS INT), 0) > 0 AS start, length(line) >= 8 AND regexp_matches(line, '(19|20)\d{{2}}') AS dated, length(line) >= 8 AS goes FROM clean),
runs AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id ORDER BY order_index, part) AS n FROM kinds),
opened AS (SELECT *, sum((dated AND n = 0)::INT) OVER (PARTITION BY doc_id ORDER BY order_index, part) AS d FROM runs),
refs AS (SELECT doc_id, n, string_agg(line, ' ' ORDER BY order_index, part) AS raw FROM opened WHERE (n > 0 OR d > 0) AND (start OR goes) GROUP BY doc_id, n),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS number, regexp_extract(raw, '^\[?(\d+)\]?[.)、]?\s*(.+)$', 1) AS digits, CASE WHEN regexp_matches(raw, '^\[?(\d+)\]?[.)、]?\s*(.+)$') THEN regexp_extract(raw, '^\[?(\d+)\]?[.)、]?\s*(.+)$', 2) ELSE raw END AS body FROM refs),
parsed AS (SELECT doc_id, number, 'ref_' || CASE WHEN digits = '' THEN number::VARCHAR ELSE (digits::HUGEINT)::VARCHAR END AS ref_id, raw, TRY_CAST(nullif(regexp_extract(body, '(19|20)\d{{2}}', 0), '') AS INT) AS year,
  list_filter([trim(regexp_extract(body, '^([^.。]*)', 1)), trim(regexp_extract(body, '^[^.。]*[.。]([^.。]*)', 1)), trim(regexp_extract(body, '^[^.。]*[.。][^.。]*[.。](.*)$', 1))], lambda x: x <> '') AS parts FROM numbered)"""


@query("reference_lists", CITED + " SELECT doc_id, number::INT AS number, ref_id, raw, coalesce(parts[1], '') AS authors, coalesce(parts[2], '') AS title, year FROM parsed")
def reference_lists(spark, sf_dir):
    return citations.entries(citations.list_lines(_cited_nodes(spark, sf_dir)))


CITATIONS = CITED + rf""",
marked AS (SELECT doc_id, node_id, {_marked_sql()} AS text FROM nodes WHERE NOT ({FOURTH})),
split AS (SELECT *, regexp_extract_all(text, '\[\d+(?:\s*[-,，、]\s*\d+)*\]') AS m, string_split_regex(text, '\[\d+(?:\s*[-,，、]\s*\d+)*\]') AS b FROM marked),
each AS (SELECT doc_id, node_id, text, m, b, unnest(range(len(m))) AS k FROM split WHERE len(m) > 0),
placed AS (SELECT *, m[k + 1] AS mark, (length(array_to_string(b[1:k + 1], '')) + length(array_to_string(m[1:k], '')))::BIGINT AS s FROM each),
numbers AS (SELECT doc_id, node_id, k + 1 AS mark_no, {COMPACT.format(c='substr(text, greatest(0, s - 80) + 1, s + length(mark) + 80 - greatest(0, s - 80))')} AS context, unnest(string_split(mark[2:-2], ',')) AS part FROM placed WHERE replace(mark[2:-2], ' ', '') NOT IN ('0,1', '0，1')),
said AS (SELECT *, unnest(CASE WHEN contains(part, '-') THEN CASE WHEN split_part(part, '-', 1)::INT BETWEEN 1 AND split_part(part, '-', 2)::INT AND split_part(part, '-', 2)::INT <= split_part(part, '-', 1)::INT + 50 THEN range(split_part(part, '-', 1)::INT, split_part(part, '-', 2)::INT + 1) ELSE [] END ELSE list_filter([trim(part)::BIGINT], lambda n: n > 0) END) AS n FROM numbers),
known AS (SELECT DISTINCT doc_id, ref_id FROM parsed),
citations AS (SELECT s.doc_id, s.node_id, mark_no, 'ref_' || n AS ref_id, context, k.ref_id IS NOT NULL AS matched_reference FROM said s LEFT JOIN known k ON k.doc_id = s.doc_id AND k.ref_id = 'ref_' || s.n)"""


@query("citation_map", CITATIONS + " SELECT doc_id, node_id, mark_no::INT AS mark_no, ref_id, context, matched_reference FROM citations")
def citation_map(spark, sf_dir):
    return citations.citation_map(_cited_nodes(spark, sf_dir))[1]


@query("citation_status", CITATIONS + """,
r AS (SELECT doc_id, count(*) AS n FROM parsed GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE matched_reference) AS m FROM citations GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n, 0) AS "references", coalesce(c.n, 0) AS citations, coalesce(m, 0) AS matched, CASE WHEN coalesce(r.n, 0) > 0 OR coalesce(c.n, 0) > 0 THEN 'extracted' ELSE 'partial' END AS status, CASE WHEN coalesce(r.n, 0) > 0 THEN '' ELSE 'missing_reference_list' END AS warnings
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)""")
def citation_status(spark, sf_dir):
    refs, said = citations.citation_map(_cited_nodes(spark, sf_dir))
    return citations.status(I.table(spark, sf_dir, "documents"), refs, said)


def _paper_blocks(spark, sf_dir):
    """Documents as one block of lines each; by their place, lines are headed,
    captioned, rows, entries or plain."""
    m = lambda i: i % 11
    said = lambda x, i: F.when(F.trim(x) == "", "").when(m(i) == 0, F.concat(F.lit("Abstract: "), x)).when((m(i) == 2) & (F.floor(i / 11) % 3 == 2), "References").when(m(i) == 3, F.concat(F.lit("Table 1 "), x)).when(m(i) == 4, F.concat(F.lit("a | b | "), x)).when(m(i) == 5, F.concat(F.lit("ours 1 "), x)).when(m(i) == 7, "2.1 Methods").when(m(i) == 8, F.concat(F.lit("Figure 2 "), x)).when(m(i) == 9, F.concat(F.lit("[3] "), x)).otherwise(F.concat(F.lit("w "), x))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), said)
    none = F.lit("")
    return I.table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("position"), F.lit("paragraph").alias("kind"), F.lit(0).alias("level"), none.alias("heading"), F.array_join(lines, "\n").alias("text"))


PAPERS = "WITH " + I.SQL_LINES + rf""",
said AS (SELECT doc_id, order_index AS i, order_index % 11 AS m, order_index % 11 = 2 AND (order_index // 11) % 3 = 2 AS opens, {COMPACT.format(c="text")} AS t FROM nodes),
lined AS (SELECT *, CASE WHEN m = 0 THEN 'Abstract: ' || t WHEN opens THEN 'References' WHEN m = 3 THEN 'Table 1 ' || t WHEN m = 4 THEN 'a | b | ' || t WHEN m = 5 THEN 'ours 1 ' || t WHEN m = 7 THEN '2.1 Methods' WHEN m = 8 THEN 'Figure 2 ' || t WHEN m = 9 THEN '[3] ' || t ELSE 'w ' || t END AS raw FROM said),
line AS (SELECT *, trim(raw) AS line, CASE WHEN m = 0 THEN '摘要' WHEN opens THEN '参考文献' WHEN m = 7 THEN '2.1 Methods' END AS title FROM lined),
sets AS (SELECT *, CASE WHEN title IS NOT NULL THEN opens END AS sets_list, CASE WHEN m = 0 THEN 'abstract' WHEN opens THEN 'reference' WHEN m = 7 THEN '' WHEN m = 3 THEN 'table' END AS sets_context FROM line),
state AS (SELECT *, coalesce(last_value(sets_list IGNORE NULLS) OVER w, false) AS listed, coalesce(last_value(sets_context IGNORE NULLS) OVER w, '') AS context FROM sets WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kinds AS (SELECT *, CASE WHEN title IS NOT NULL THEN 'heading' WHEN m = 8 THEN 'figure' WHEN m = 3 THEN 'table' WHEN listed OR m = 9 THEN 'reference' WHEN context = 'table' AND length(line) <= 180 AND len({_cells_sql('line')}) > 0 THEN 'rows' ELSE 'text' END AS what FROM state),
begun AS (SELECT *, CASE WHEN what NOT IN ('rows', 'text') OR lag(what) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM what THEN i END AS start FROM kinds),
runs AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM begun),
made AS (
  SELECT doc_id, run, 0 AS sub, CASE WHEN what = 'rows' THEN 'table' WHEN what = 'text' THEN CASE WHEN any_value(context) IN ('abstract', 'keywords') THEN any_value(context) ELSE 'paragraph' END ELSE what END AS kind, max(CASE WHEN m = 7 THEN 2 WHEN title IS NOT NULL THEN 1 ELSE 0 END) AS level, coalesce(max(title), '') AS heading, CASE WHEN what = 'heading' THEN '' WHEN what = 'rows' THEN string_agg(line, chr(10) ORDER BY i) ELSE string_agg(line, ' ' ORDER BY i) END AS text
  FROM runs GROUP BY doc_id, run, what
  UNION ALL SELECT doc_id, i, 1, 'abstract', 0, '', t FROM runs WHERE m = 0 AND t <> '')"""


@query("paper_blocks", PAPERS + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, sub)::INT AS part, kind, level::INT AS level, heading, text FROM made")
def paper_blocks(spark, sf_dir):
    return outline.normalized(_paper_blocks(spark, sf_dir)).select("doc_id", "part", "kind", "level", "heading", "text")


@query("paper_markdown", PAPERS + r"""
SELECT doc_id, sha256(string_agg(CASE WHEN kind = 'heading' THEN repeat('#', level::INT) || ' ' || heading ELSE text END, chr(10) || chr(10) ORDER BY run, sub) || chr(10)) AS sha FROM made GROUP BY doc_id""")
def paper_markdown(spark, sf_dir):
    return outline.markdown(outline.normalized(_paper_blocks(spark, sf_dir))).select("doc_id", F.sha2("markdown", 256).alias("sha"))


#: More words of the texts stand for terms of the lists.
FACT_WORDS = {"is": "提出", "to": "任务规划", "in": "实验", "die": "局限", "la": "某新算法", "le": "成功率", "est": "方法", "den": "服务机器人"}


def _fact_nodes_in(spark, sf_dir):
    nodes, text = _cited_nodes(spark, sf_dir), F.col("text")
    for word, term in FACT_WORDS.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {term} "))
    return nodes.withColumn("text", F.when(F.col("kind") == "reference", F.col("text")).otherwise(text))


def _worded_sql() -> str:
    out = _marked_sql()
    for word, term in FACT_WORDS.items():
        out = f"replace({out}, ' {word} ', ' {term} ')"
    return out


CHOSEN = CITATIONS + rf""",
worded AS (SELECT doc_id, node_id, order_index, {_worded_sql()} AS text FROM nodes WHERE NOT ({FOURTH})),
scores AS (SELECT doc_id, node_id, order_index, 2 * ({" + ".join(f"contains(text, '{w}')::INT" for g in fact_terms.CLAIM_TOKENS.values() for w in g)}) AS s FROM worded),
tiers AS (SELECT doc_id, node_id, 1 AS tier, order_index AS a, 0 AS b FROM worded WHERE (doc_id, node_id) IN (SELECT (doc_id, node_id) FROM citations) UNION ALL SELECT doc_id, node_id, 2, -s, order_index FROM scores WHERE s > 0),
firsts AS (SELECT doc_id, node_id, min({{'tier': tier, 'a': a, 'b': b}}) AS at_ FROM tiers GROUP BY doc_id, node_id),
chosen AS (SELECT doc_id, node_id, row_number() OVER (PARTITION BY doc_id ORDER BY at_, node_id) AS place, at_.tier AS tier FROM firsts QUALIFY place <= 24)"""


@query("fact_nodes", CHOSEN + " SELECT doc_id, node_id, place::INT AS place, tier::INT AS tier FROM chosen")
def fact_nodes(spark, sf_dir):
    nodes = _fact_nodes_in(spark, sf_dir)
    said = citations.marks(nodes).join(nodes.select("node_id", "order_index"), "node_id")
    return rule_facts.fact_nodes(nodes, citing=said.groupBy("doc_id", "node_id").agg(F.min("order_index").alias("at")))


def _cases(groups, column):
    return " ".join(f"WHEN {' OR '.join(f'''contains({column}, '{w}')''' for w in words)} THEN '{k}'" for k, words in groups.items())


@query("rule_facts", CHOSEN + rf""",
read AS (SELECT w.* FROM worded w JOIN chosen USING (doc_id, node_id)),
parts AS (SELECT doc_id, node_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?;；\n]+|\.\s+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) >= 12 AND regexp_matches(s, '[\p{{L}}\p{{N}}]'))[1:5] AS l FROM read),
sents AS (SELECT doc_id, node_id, unnest(l) AS s, unnest(range(len(l))) AS p FROM parts),
claims AS (SELECT doc_id, node_id, p, CASE WHEN length(s) <= 420 THEN s ELSE rtrim(substr(s, 1, 420)) || ' ...' END AS text, CASE {_cases(fact_terms.CLAIM_TOKENS, 's')} ELSE 'claim' END AS type FROM sents),
terms(term, type) AS (VALUES {", ".join(f"('{t}', '{k}')" for t, k, _ in rule_facts.dictionary())}),
ents AS (
  SELECT doc_id, node_id, term AS name, type FROM read JOIN terms ON contains(text, term)
  {"".join(f"UNION ALL SELECT doc_id, node_id, unnest(regexp_extract_all(text, '{p.replace(chr(92) + 'u4e00-' + chr(92) + 'u9fff', '一-鿿')}')), '{k}' FROM read " for k, p in fact_terms.ENTITY_PATTERNS.items())}),
named AS (SELECT DISTINCT node_id, name FROM ents),
cited AS (SELECT DISTINCT doc_id, node_id, ref_id FROM citations),
facts AS (
  SELECT doc_id, 'claim' AS fact_type, type FROM claims UNION ALL SELECT doc_id, 'entity', type FROM ents
  UNION ALL SELECT doc_id, 'entity', 'citation' FROM (SELECT DISTINCT doc_id, ref_id FROM cited)
  UNION ALL SELECT doc_id, 'relation', 'supports' FROM claims
  UNION ALL SELECT c.doc_id, 'relation', CASE WHEN c.type = 'limitation' THEN 'limits' ELSE 'uses' END FROM claims c JOIN named n ON c.node_id = n.node_id AND contains(c.text, n.name)
  UNION ALL SELECT doc_id, 'relation', 'cites' FROM cited)
SELECT doc_id, fact_type, type, count(*) AS n FROM facts GROUP BY doc_id, fact_type, type""")
def rule_facts_query(spark, sf_dir):
    folder = new_folder(spark, "rule-facts")  # texts are made, searched for marks and read once each

    def kept(name, rows):
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    nodes = kept("nodes", _fact_nodes_in(spark, sf_dir))
    refs, said = citations.citation_map(nodes)
    said = kept("marks", said.select("doc_id", "node_id", "mark_no", "ref_id"))
    docs = I.table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"))
    terms = spark.createDataFrame(rule_facts.dictionary(), "term string, type string, priority int")
    return rule_facts.extracted(docs, nodes, refs, said, terms, kept=kept).groupBy("doc_id", "fact_type", "type").agg(F.count("*").alias("n"))
