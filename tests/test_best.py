"""The best of each query, kept inside tasks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.operators import facts, graph, hybrid, lexical, tables
from lexforge.operators.best import Best, rounded
from lexforge.operators.containment import best_by_terms, contained


def test_hits_do_not_copy_the_text_they_are_in(spark):
    words = [f"w{n:05d}w" for n in range(8_000)]
    text = " ".join(words) + " " * 250_000  # 8,000 copies of it would pass what a column of strings can hold
    rows = spark.createDataFrame([(1, text)], "id int, hay string")
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    assert contained(rows, terms).agg(F.count("*"), F.count_distinct("term")).first()[:] == (8_000, 8_000)


def test_best_keeps_the_first_of_a_total_order():
    rng = np.random.default_rng(5)
    ids = [f"n{n}" for n in rng.permutation(4_000)]
    keys = rng.integers(0, 5, (4_000, 3)).astype(float)  # many ties
    best = Best(3, 7, "id")
    for first in range(0, 4_000, 300):
        batch = pa.RecordBatch.from_arrays([pa.array(ids[first : first + 300])], names=["id"])
        row, query = np.divmod(np.arange(batch.num_rows * 3), 3)
        best.add(batch, row, query, keys[first : first + 300][row, query])
    got = [(r["_q"], r["_key"], r["id"]) for b in best.rows(["_q", "_key", "id"]) for r in b.to_pylist()]
    assert got == [(q, k, i) for q in range(3) for k, i in sorted(zip(keys[:, q], ids))[:7]]
    assert rounded(np.array([0.5, -0.5, 1.4]), 0).tolist() == [1.0, -1.0, 1.0]


def test_tasks_pass_on_few_rows_however_many_match(spark):
    rows = spark.range(3_000, numPartitions=3).select(F.col("id").alias("n"), F.lit("the cat").alias("hay"))
    wanted = spark.createDataFrame([("a", "the"), ("a", "cat"), ("b", "cat"), ("c", "dog"), (None, "the")], "query_id string, term string")
    got = best_by_terms(rows, wanted, lambda r, at, n: -n[:, 0].astype(float), 2, "n", "n long", hay=["hay"], keep=["n"]).collect()
    assert len(got) <= 3 * 2 * 3
    assert sorted((r["n"], r["counts"][0]) for r in got if r["query_id"] == "a")[:2] == [(0, 2), (1, 2)]
    assert {r["query_id"] for r in got} == {"a", "b", None}


def test_routing_by_fields_alone_is_as_with_signals(spark):
    docs = spark.createDataFrame([(n, f"Cat {n}", "the cat sat " * (n % 3), "en") for n in range(40)], "doc_id int, title string, abstract string, keywords string")
    asked = spark.createDataFrame([(1, "the cat sat"), (2, "en cat"), (3, "nothing")], "query_id int, query string")
    none = spark.createDataFrame([], "query_id int, doc_id int, node_matches int, hybrid_score double")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(hybrid.route(asked, docs, k=5)) == rows(hybrid.route(asked, docs, none, k=5))


def test_names_that_many_share_are_no_single_window(spark):
    given = spark.createDataFrame([(f"f{n}", "entity", n % 3, f"{n % 3}:0", "task", "cat", "", "", n) for n in range(9)] + [("r1", "relation", 7, "7:0", "uses", "x", "f1", "cat", 20), ("r2", "relation", 1, "1:0", "uses", "y", "f0", "cat", 21)], "fact_id string, fact_type string, doc_id int, node_id string, type string, text string, subject_name string, object_name string, position int")
    _, edges = graph.knowledge_graph(given, spark.createDataFrame([(0, "t")], "doc_id int, title string"))
    assert sorted((r["source"], r["target"]) for r in edges.filter("type = 'uses'").collect()) == [("fact:f0", "fact:f7"), ("fact:f1", "fact:f8")]
    assert "Window" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_best_nodes_are_those_of_all_scores(spark):
    nodes = spark.createDataFrame([(f"{n}:0", n, 0, "x", "", "", f"Über den Fluss {'cat ' * (n % 5)} dog{n % 7} the") for n in range(200)], "node_id string, doc_id int, order_index int, type string, heading string, node_path string, text string").repartition(3)
    asked = spark.createDataFrame([(1, "cat dog3"), (2, "uber"), (3, "zebra"), (4, "")], "query_id int, query string")
    want = lexical.ranked(lexical.bm25(asked, nodes), 9, F.round("score", 9), F.col("node_id"))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["node_id"], round(r["score"], 9)) for r in df.collect())
    assert rows(lexical.best_nodes(asked, nodes, 9)) == rows(want)
    assert lexical.best_nodes(asked, nodes.limit(0), 9).count() == 0
    first = lexical.contains_nodes(asked.filter("query_id = 1"), nodes, 4)
    assert [r["node_id"] for r in first.orderBy("rank").collect()] == sorted(f"{n}:0" for n in range(200) if n % 5 or n % 7 == 3)[:4]


def test_duplicate_groups_take_one_pass(spark):
    rows = spark.createDataFrame([(f"f{n:02d}", "claim", 1, "n", "method", "k") for n in range(12)] + [("g1", "claim", 2, "n", "method", "k"), ("h1", "claim", 3, "n", "cites", "k"), ("h2", "claim", 3, "m", "cites", "k"), ("i1", "claim", None, "n", "x", "k"), ("i2", "claim", None, "n", "x", "k")], "fact_id string, fact_type string, doc_id int, node_id string, type string, normalized_key string")
    made = facts.duplicate_groups(rows)
    assert sorted((str(r["doc_id"]), r["count"], r["fact_ids"]) for r in made.collect() if r["doc_id"]) == [("1", 12, ",".join(f"f{n:02d}" for n in range(8)))]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_table_is_parsed_once(spark):
    made = tables.content(spark.createDataFrame([(1, "a\tb\nx\t1\ny\t2")], "table_id int, text string"))
    assert sorted((r["row_index"], r["cells"]) for r in made.collect()) == [(0, ["x", "1"]), (1, ["y", "2"])]
    assert made._jdf.queryExecution().optimizedPlan().toString().count(r"\S {2,}\S") == 1
