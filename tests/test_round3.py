"""Queries against their SQL on tables with odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_queries import cells

from lexforge.functions import text as T
from lexforge.operators import recovery
from lexforge.plans import registry
from lexforge.streaming import index


def same(spark, tmp_path, name, **tables):
    """Whether a query gives the rows of its SQL on ``tables`` (name -> rows, schema)."""
    db = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = registry.queries()[name](spark, str(tmp_path))
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    rows = [tuple(r[names.index(c)] for c in got.columns) for r in want.fetchall()]
    assert rows and cells(got.collect()) == cells(rows)


@pytest.mark.parametrize("name", ["conflict_counts", "conflict_pairs"])
def test_anchors_end_at_letters_with_marks(spark, tmp_path, name):
    texts = ["wir gehen mit éabcdefghijklmnop fort", "this is äabcdefghijklmnopé here", "avec abcdefghijklmnop_ encore un", "nicht abcdefghijklmnop heute"]
    rows = [(n, t, "de", "s", len(t)) for n, t in enumerate(texts)]
    same(spark, tmp_path, name, documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def test_titles_with_cut_references(spark, tmp_path):
    rows = [(1, "u", "<title>a &amp;&amp</title><p>x &lt y</p>"), (2, "u", "<title>b &lt;i&gt; &amp;lt;</title><p>y</p>"), (3, "u", "<title>R&D &#39</title><p>z</p>")]
    same(spark, tmp_path, "page_titles", pages=(rows, "page_id long, url string, html string"))


def shuffles(df):
    """How often the plan of ``df`` deals rows anew by a key."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["recovered_tables", "table_cells", "table_parse_scores"])
def test_blocks_are_dealt_once(spark, tmp_path, name):
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string, l_linestatus string"
    rows = [(k // 5, k % 5, k, k // 2, 10.5 * k, float(k % 50), 0.05, "NAR"[k % 3], "OF"[k % 2]) for k in range(60)]
    same(spark, tmp_path, name, lineitem=(rows, columns))
    assert shuffles(registry.queries()[name](spark, str(tmp_path))) == 1


def test_a_way_falls_back_by_caption(spark):
    """Bodies that only one of both ways sees, ends of lines of all kinds, and ids that come twice."""
    rows = [
        (1, 0, "table", "Table 1"), (1, 1, "paragraph", "a b\r\nc d"),  # no row of lines, and none on one line
        (1, 2, "table", "Table\n2"), (1, 3, "paragraph", "prose 1 here\ngoes on 2"),
        (1, 4, "heading", "x"), (1, 5, "table", "Table 3"), (1, 6, "paragraph", "only 1\r| ours | 2 |\r\n:--|--"),
        (2, 0, "table", "Table 1"), (2, 1, "paragraph", "a\nb\nc 1\nd\ne 2 f"), (2, 2, "figure", "Figure"),
        (3, 0, "table", "Table 1"), (3, 1, "paragraph", "one\ntwo 1\nsix 7 x\ny"),
    ]
    blocks = spark.createDataFrame(rows, "doc_id long, position long, kind string, text string")
    one, two = (recovery.from_blocks(blocks, flat).collect() for flat in (False, True))
    want = {(r["doc_id"], r["table_id"]): (r["content_positions"], r["grid"]) for r in [*two, *one]}
    got = {(r["doc_id"], r["table_id"]): (r["content_positions"], r["grid"]) for r in recovery.captioned(blocks).filter("size(grid) > 0").collect()}
    assert got == want and got[1, "table_003"] == ([6], [["only", "1"], ["ours", "2"]])
    again = blocks.withColumn("caption_id", F.lit("t"))
    assert {(r["doc_id"], r["table_id"]) for r in recovery.recovered(again).collect()} == {(d, "t") for d, _ in got}
    scores = lambda df: sorted(map(tuple, df.collect()))
    for some in (blocks, again):
        tables = recovery.recovered(some)
        assert scores(recovery.block_scores(some)) == scores(recovery.parse_score(recovery.items(some, tables), tables))


def test_batches_may_be_written_in_any_order(spark, tmp_path):
    """A batch does not look at those before it."""
    schema = "doc_id string, op string, text string"
    batches = [[("a", "upsert", "planner robot"), ("b", "upsert", "planner")], [("a", "upsert", "robot"), ("c", "upsert", "planner alpha beta")], [("b", "delete", None)]]
    asked = spark.createDataFrame([(1, "planner"), (2, "robot")], "query_id int, query string")
    folder = f"file://{tmp_path}/index"
    for n in (1, 2, 0):
        index.apply_batch(spark, folder, n, spark.createDataFrame(batches[n], schema))
    assert sorted((r["query_id"], r["doc_id"]) for r in index.bm25(asked, folder).collect()) == [(1, "c"), (2, "a")]
    assert sorted((r["doc_id"], r["term"], r["tf"], r["node_len"]) for r in index.postings(spark, folder).collect()) == [("a", "robot", 1, 1), ("c", "alpha", 1, 3), ("c", "beta", 1, 3), ("c", "planner", 1, 3)]
    assert sorted(r["doc_id"] for r in index.nodes(spark, folder, before=2).collect()) == ["a", "b", "c"]


def test_frames_are_made_once(spark, tmp_path):
    """Frames are not joined with themselves, and the white space of a claim is compacted once."""
    rows = [(n, f"this is a method of kind {n} that works. a second one is doi here.\n[{n}] a reference of 1999", "en", "s", 60) for n in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["claim_frames"](spark, str(tmp_path))
    assert got.count() == 15 and {(r["trace_status"], r["missing"]) for r in got.collect()} == {("structurally_supported", 0)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode(slice") == 1
    noise = T.noise_reasons(F.col("text"))
    plan = spark.createDataFrame([("a",)], "text string").select(noise.alias("n"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?U)") == 1


def test_relations_search_once(spark):
    """Frames are searched and brought to normal form before both sides of a relation read them."""
    plan = registry.queries()["claim_relations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "sha2" not in plan


def test_support_is_judged_where_the_document_lies(spark, tmp_path):
    """One shuffle for frames and units; documents without units, claims without terms, lines that repeat."""
    texts = [None, "", "  \n ", "?? 123456 789012 345678", "planner makes station idiot lines", "the able planner. the able planner makes stations\nthe able planner\nidiot planner able", "que limiting idiot words\nidiot que limiting", "a\n" * 30 + "notion of stations and motions here", "x y z"]
    rows = [(n, t, "de", "s", 0) for n, t in enumerate(texts * 3)]
    same(spark, tmp_path, "semantic_support", documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert shuffles(registry.queries()["semantic_support"](spark, str(tmp_path))) == 1
