"""Findings of round 4: facts by rules read a text once, the report of a graph is counted from facts."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import fact_terms
from lexforge.functions import text as T
from lexforge.operators import citations, containment, graph, rule_facts
from lexforge.operators import nodes as N
from lexforge.plans import q_facts

NODES = "doc_id long, node_id string, order_index int, kind string, node_path string, text string"


@pytest.fixture()
def nodes(spark):
    rows = [(1, "1:0", 0, "paragraph", "", "本文提出一种任务规划方法用于服务机器人。引用见[1]和[2-3]。"), (1, "1:1", 1, "paragraph", "", "该新算法的局限是任务规划在动态环境中难以扩展，需要进一步验证。"), (2, "2:0", 0, "paragraph", "", None)]
    return spark.createDataFrame(rows, NODES)


def given(spark, nodes):
    refs, said = citations.citation_map(nodes)
    return spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, title string"), nodes, refs, said, spark.createDataFrame(rule_facts.dictionary(), "term string, type string, priority int")


def test_rule_facts_search_a_text_once(spark, nodes, tmp_path):
    def kept(name, rows):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert [plan.count(p) for p in fact_terms.ENTITY_PATTERNS.values()] == [1, 1]
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    want, made = rule_facts.extracted(*given(spark, nodes)), rule_facts.extracted(*given(spark, nodes), kept=kept)
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    assert {("uses", "任务规划"), ("uses", "服务机器人")} <= {(r["type"], r["object_name"]) for r in made.collect() if r["fact_type"] == "relation"}


def test_mentions_within_nodes_are_those_of_the_join(spark, nodes):
    # a node id that comes twice: a claim of one row finds names of the other, as in the join
    twice = nodes.unionByName(spark.createDataFrame([(1, "1:0", 0, "paragraph", "", "另一段提出负载均衡与任务规划的关系。"), (1, "1:1", 1, "paragraph", "", "本段只有服务机器人和负载均衡，没有方法。")], NODES))
    facts = rule_facts.extracted(*given(spark, twice)).cache()
    joined = rule_facts.A.mentions(facts.filter("fact_type = 'claim'"), facts.filter("fact_type = 'entity' AND type <> 'citation'"))
    rows = lambda df: sorted((r["subject_name"], r["object_name"], r["type"]) for r in df.collect())
    assert rows(facts.filter("type IN ('uses', 'limits')")) == rows(joined) != []


@pytest.mark.parametrize("block", [50_000, 2])
def test_terms_of_rows_as_arrays(spark, monkeypatch, block):
    monkeypatch.setattr(containment, "BLOCK", block)
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "xyz"), (4, "bcd bc")], "id int, hay string")
    terms = spark.createDataFrame([("bc",), ("a",), ("bc",), ("",), (None,), ("d",), ("zz",)], "term string")
    assert {r["id"]: sorted(r["terms"]) for r in containment.with_terms(rows, terms).collect()} == {1: ["a", "bc"], 2: [], 3: [], 4: ["bc", "d"]}


def test_white_space_is_that_of_unicode(spark):
    texts = [f"a{chr(c)}b{chr(c)}{chr(c)} c {chr(c)}" for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000] + ["  a  b ", " ", "", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.trim(F.regexp_replace("t", r"(?U)\s+", " "))
    assert df.filter(T.compact(F.col("t")) != want).count() == 0
    # single spaces and line feeds alone are plain
    assert df.filter(T.plain(F.col("t")) & F.exists(F.split("t", "\n"), lambda x: F.trim(x) != T.compact(x))).count() == 0


def test_patterns_search_only_texts_with_their_words(spark):
    pattern = fact_terms.ENTITY_PATTERNS["method"]
    assert T.needed(pattern) == ["方法", "算法", "模型", "框架", "机制"]
    assert T.needed("x|y(?:a|b)") is T.needed("(?i)x(?:a)") is T.needed("[A-Z]tion") is T.needed("x(?:a|)") is T.needed(r"\Qx(?:a)") is None
    df = spark.createDataFrame([("某新算法 and 某某方法",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(T.matches(F.col("t"), pattern)).collect()][:2] == [["某新算法", "某某方法"], []]


def test_sentences_of_plain_texts_are_trimmed(spark):
    df = spark.createDataFrame([(" 0 1 letters one . 012 letters two 210\n short one \n3 letters  three 3",)], "text string")
    assert df.select(N.sentence_list(F.lit(" 0 1 letters one. 012 letters two 210\n short one \n3 letters three 3"))).first()[0] == ["0 1 letters one", "012 letters two 210", "3 letters three 3"]
    assert df.select(N.sentence_list(F.col("text"))).first()[0] == ["0 1 letters one", "012 letters two 210", "3 letters three 3"]


def test_a_graphs_report_is_counted_from_its_facts(spark):
    columns = "fact_id string, fact_type string, doc_id int, node_id string, type string, text string, subject_name string, object_name string, position int"
    rows = [(f"c{n}", "claim", n % 4, f"{n % 4}:{n % 3}", "method", f"a claim about cat {n}" * 9, "", "", n) for n in range(12)]
    rows += [("c0", "claim", 3, "3:9", "method", "said again", "", "", 1), ("c0", "claim", 3, "", "method", "and again", "", "", 2), ("c1", "claim", None, None, "method", "nowhere", "", "", 3)]
    rows += [(f"e{n}", "entity", n % 4, f"{n % 4}:0", "task", "cat" if n % 2 else "dog", "", "", n) for n in range(6)]
    rows += [("r0", "relation", 0, "0:0", "uses", "x", "c0", "cat", 1), ("r1", "relation", 1, "1:0", "uses", "x", "c0", "cat", 2), ("r2", "relation", 2, "", "has_fact", "x", "dog", "e1", 3), ("r3", "relation", 9, "9:0", "limits", "x", "c1", "nobody", 4), ("r4", "relation", 9, "9:0", "limits", "x", "c1", None, 5)]
    given, docs = spark.createDataFrame(rows, columns), spark.createDataFrame([(n, "t") for n in (0, 1, 2, 3, 5, 6, 6)], "doc_id int, title string")
    counts = lambda df: sorted((r["part"], r["type"], r["n"]) for r in df.collect())
    assert counts(graph.fact_report(given, docs)) == counts(graph.report(*graph.knowledge_graph(given, docs)))
    assert ("isolated", "document", 2) in counts(graph.fact_report(given, docs))
    assert counts(graph.fact_report(given.limit(0), docs)) == counts(graph.report(*graph.knowledge_graph(given.limit(0), docs)))


def test_graph_facts_of_repeated_documents(spark, tmp_path):
    text = "motion and theand relation here. another motion of theand things\nsecond line about nation and dela"
    rows = [(1, text, "a"), (2, "nothing of that kind is said here", "b")]
    reports = []
    for more in ([], [(1, "the relation of a nation in theand motion", "a")]):
        path = f"{tmp_path}/{len(more)}"
        spark.createDataFrame(rows + more, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
        facts, docs = q_facts._graph_facts(spark, path)
        joined = q_facts.A.mentions(q_facts._claims(spark, path), q_facts._entities(spark, path))
        key = lambda df: sorted((r["subject_name"], r["object_name"], r["fact_id"]) for r in df.collect())
        assert key(facts.filter("fact_type = 'relation'")) == key(joined) != []
        reports.append(q_facts.G.fact_report(facts, docs).count())
    assert min(reports) > 5
