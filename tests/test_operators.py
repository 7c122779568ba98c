import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import evals, facts, frames, graph, nodes, records, tables, tree
from lexforge.operators.containment import Finder, contained
from lexforge.sources import files
from lexforge.streaming import sync

MARKDOWN = "# Memory\n\nIntro line.\n\n## Method\n\nWe gate writes.\n\n### Detail\n\nDeep.\n\n## Evaluation\n\nIt works.\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.md").write_text(MARKDOWN)
    (tmp_path / "b.txt").write_bytes("第一段\n\n第二段".encode("gb18030"))
    (tmp_path / "c.html").write_text("<html><title>T &amp; U</title><script>var x;</script><h1>Head</h1><p>one<b>two</b></p></html>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.bin").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Title</w:t></w:p><w:p><w:t>Body</w:t></w:p></w:document>')
    (tmp_path / "g.docx").write_bytes(b"broken")
    return tmp_path


def test_files_become_blocks(spark, folder):
    found = files.discover(spark, str(folder))
    assert found.count() == 6
    blocks = files.parse(found).collect()
    by = {}
    for r in blocks:
        by.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    assert [b["kind"] for b in by["a.md"]] == ["heading", "paragraph", "heading", "paragraph", "heading", "paragraph", "heading", "paragraph"] and by["a.md"][0]["title"] == "Memory"
    assert [b["text"] for b in by["b.txt"]] == ["第一段", "第二段"] and by["b.txt"][0]["title"] == "b"
    assert [(b["kind"], b["heading"] or b["text"]) for b in by["c.html"]] == [("heading", "Head"), ("paragraph", "onetwo")] and by["c.html"][0]["title"] == "T & U"
    assert by["f.docx"][0]["title"] == "Title"
    assert all(by[n][0]["kind"] == "error" and by[n][0]["error"] for n in ("d.pdf", "g.docx"))


def test_stream_sync_reads_new_files_once(spark, folder, tmp_path_factory):
    out, mark = (str(tmp_path_factory.mktemp(n)) for n in ("out", "mark"))
    sync.sync(spark, str(folder), out, mark).awaitTermination(120)
    first = spark.read.parquet(out).count()
    (folder / "h.txt").write_text("new")
    sync.sync(spark, str(folder), out, mark).awaitTermination(120)
    assert first > 0 and spark.read.parquet(out).count() == first + 1


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query": "q", "intent": "method", "expected_doc_ids": ["1"], "expected_node_keywords": ["k"]}]))
    (tmp_path / "b.json").write_text(json.dumps({"schema": "s", "queries": [{"query": "q", "intent": "qa", "expected_doc_ids": [], "expected_keywords": ["w"]}]}))
    assert files.evaluation_set(spark, str(tmp_path / "a.json")).first()["expected_keywords"] == ["k"]
    assert files.evaluation_set(spark, str(tmp_path / "b.json")).first()["expected_keywords"] == ["w"]


def test_tree(spark, folder):
    blocks = files.parse(files.discover(spark, str(folder)).filter("path LIKE '%a.md'")).withColumn("doc_id", F.lit(1))
    n = tree.build_tree(blocks)
    parent = {r["node_id"]: r["parent_id"] for r in n.collect()}
    assert parent["1:2"] == "1:0" and parent["1:4"] == "1:2" and parent["1:6"] == "1:0" and parent["1:7:0"] == "1:6" and parent["1:root"] is None
    assert {r["ancestor"] for r in tree.descendants(n).filter("node_id = '1:5:0'").collect()} == {"1:root", "1:0", "1:2", "1:4"}
    best = {r["node_id"]: r["best"] for r in tree.subtree_max(n.withColumn("v", F.length("text")), "v").collect()}
    assert best["1:2"] == len("We gate writes.") and best["1:4"] == len("Deep.")
    said = {r["node_id"]: r["summary"] for r in tree.summaries(n).collect()}
    assert said["1:6"] == "It works." and said["1:2"].startswith("We gate writes.")


def test_selection_is_diverse(spark):
    rows = [(1, 1, f"n{k}", "p1" if k < 4 else f"p{k}", k, "paragraph", "t", 1.0 - k / 100) for k in range(8)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, node_id string, parent_id string, order_index int, type string, text string, score double")
    assert [r["node_id"] for r in tree.select_nodes(df, 4).orderBy("place").collect()] == ["n0", "n4", "n5", "n6"]


def test_line_kinds(spark):
    lines = {"图 1 结构": "figure", "Table 2 results": "table", "[3] Someone": "reference", "1.2 方法": "heading", "第一章 绪论": "heading", "plain text": "paragraph"}
    got = {r["l"]: (r["k"], r["v"]) for r in spark.createDataFrame([(k,) for k in lines], "l string").select("l", tree.line_kind(F.col("l")).alias("k"), tree.heading_level(F.col("l")).alias("v")).collect()}
    assert {k: v[0] for k, v in got.items()} == lines and got["1.2 方法"][1] == 2


def test_tables(spark):
    text = "方法\t成功率\t响应时间\n基线\t80%\t12ms\n本文方法\t92%\t9ms"
    rows = tables.content(spark.createDataFrame([(1, text), (2, "a | 1\nb | 2"), (3, None)], "table_id int, text string"))
    s = {r["table_id"]: r for r in tables.summary(rows).collect()}
    assert (s[1]["row_count"], s[1]["column_count"], s[1]["cell_count"]) == (2, 3, 6) and s[2]["row_count"] == 2
    found = tables.facts(rows.filter("table_id = 1"))
    assert {(r["method"], r["metric"], r["result"]) for r in found.collect()} >= {("基线", "成功率", "80%"), ("本文方法", "响应时间", "9ms")}
    assert {(r["metric"], r["baseline"]) for r in tables.comparisons(found).collect()} == {("成功率", "基线"), ("响应时间", "基线")}


FACT = "fact_id string, fact_type string, doc_id int, node_id string, type string, text string, subject_name string, object_name string, normalized_key string, confidence double, source string, position long"


@pytest.fixture(scope="module")
def some_facts(spark):
    rows = [
        ("c1", "claim", 1, "n1", "result", "rate rises to 12%", "", "", "rate", 0.91, "rule_table", 1),
        ("c2", "claim", 1, "n1", "result", "rate falls", "", "", "rate", 0.4, "rule_text", 2),
        ("c3", "claim", 2, "", "method", "the Planner works", "", "", "planner", 0.7, "rule_text", 3),
        ("e1", "entity", 1, "n1", "metric", "rate", "", "", "rate", 0.62, "rule_text", 4),
        ("e2", "entity", 2, "n2", "metric", "rate", "", "", "rate", 0.62, "rule_text", 5),
        ("r1", "relation", 1, "n1", "uses", "c1 rate", "c1", "rate", "c1->rate", 0.56, "rule_text", 6),
    ]
    return spark.createDataFrame(rows, FACT)


def test_fact_search_and_coverage(spark, some_facts):
    asked = spark.createDataFrame([(1, "RATE planner")], "query_id int, query string")
    got = {r["fact_id"]: r["score"] for r in facts.search(asked, some_facts).collect()}
    assert got == {"c1": 0, "c2": 0, "c3": 0, "e1": 0, "e2": 0, "r1": 0}
    assert [r["fact_id"] for r in facts.search(asked, some_facts, source="table", min_confidence=0.8).collect()] == ["c1"]
    one = facts.coverage(some_facts).first()
    assert (one["claim_count"], one["low_confidence_count"], one["no_evidence_count"], one["table_backed_fact_count"]) == (3, 1, 1, 1)


def test_dedupe_duplicates_and_audit(some_facts):
    merged = {r["fact_id"]: r for r in facts.deduped(some_facts).collect()}
    assert merged["c1"]["merged"] == 2 and merged["c1"]["confidence"] == 0.91 and merged["c1"]["text"] == "rate rises to 12%" and len(merged) == 5
    assert [(r["count"], r["fact_ids"]) for r in facts.duplicate_groups(some_facts).collect()] == [(2, "c1,c2")]
    assert facts.audit(some_facts).first()["warnings"] == "duplicate_facts,low_confidence_facts,facts_without_evidence"


def test_conflicts_and_their_counts_agree(spark, some_facts):
    rows = some_facts.filter("fact_type = 'claim'").select("fact_id", "doc_id", "confidence", "source", facts.polarity(F.col("text"), ["rises", "works"], ["falls"]).alias("polarity"), F.array(F.lit("rate")).alias("anchors"))
    got = {(r["kind"], r["positive_fact_id"], r["negative_fact_id"], r["severity"]) for r in facts.conflicts(rows).collect()}
    assert got == {("table_text_mismatch", "c1", "c2", "medium"), ("cross_doc_conflict", "c3", "c2", "low")}
    one = facts.conflict_counts(rows).first()
    assert (one["cross_doc"], one["mismatches"]) == (1, 1)


def test_noisy_entities(spark):
    names = [("No.", "task", True), ("x", "task", True), ("12", "metric", True), ("rate!", "metric", False), ("a。b", "task", True), ("Planner", "task", False), ("", "task", True)]
    df = spark.createDataFrame(names, "n string, t string, w boolean")
    assert df.filter(facts.noisy_entity(F.col("n"), F.col("t")) != F.col("w")).count() == 0


def test_graph(spark, some_facts):
    docs = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "doc_id int, title string")
    n, e = graph.knowledge_graph(some_facts, docs)
    assert e.filter("type = 'uses'").first()[1:3] == ("fact:c1", "fact:e1")
    assert [r["id"] for r in graph.isolated(n, e).collect()] == ["doc:3"]
    near = {r["id"]: r["depth"] for r in graph.neighbourhood(e, spark.createDataFrame([("node:n2",)], "id string"), 2).collect()}
    assert near == {"node:n2": 0, "fact:e2": 1, "doc:2": 2}
    assert graph.mermaid(n, e).startswith("graph LR")


CLAIM = "frame_id string, doc_id int, claim_type string, short_claim string, result_or_gain string, limitation string"
UNIT = "doc_id int, unit_id string, unit string, confidence double"


def supported(spark, claims, units):
    out = frames.semantic_support(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(units, UNIT))
    return {r["frame_id"]: (r["status"], r["citation_risk"], r["primary"], r["weak"], r["contradictory"]) for r in out.collect()}


def test_support_of_frames(spark):
    said = "planner improves accuracy latency"
    claims = [("a", 1, "result", said, said, ""), ("b", 2, "result", said, said, ""), ("c", 3, "result", said, said, ""), ("d", 4, "result", said, said, ""), ("e", 5, "result", "", "", ""), ("f", 6, "claim", said + " of many other words here today", "", ""), ("g", 2, "limitation", said, "", said), ("a", 1, "result", said, said, "")]
    units = [(1, "u1", said + " here", 0.9), (1, "u0", "nothing alike", 1.0), (2, "u2", "planner accuracy failed", 0.9), (3, "u3", "nothing alike", 0.9), (4, None, said, 0.9), (5, "u5", "x", 0.5), (6, "u6", "some other planner", None), (6, "u7", None, 0.3)]
    got = supported(spark, claims, units)
    assert got["a"] == ("semantically_supported", "safe", "u1", "", "")
    assert got["b"] == ("contradicted", "conflicting_evidence", "", "", "u2")
    assert got["c"][:2] == got["d"][:2] == ("insufficient_evidence", "needs_more_evidence") and got["e"][:2] == ("not_checked", "not_checked")
    assert got["f"] == ("partially_supported", "needs_qualification", "", "u6", "")
    assert got["g"][0] == "partially_supported"  # a limitation is not contradicted by a failure


def test_chinese_stop_words_and_generic_terms_support_nothing(spark):
    # all words of the claim but one are stop words or general
    got = supported(spark, [("z", 1, "result", "实验 结果 表明 通过 规划", "实验 结果 规划", ""), ("y", 2, "claim", "实验 结果 表明", "", ""), ("x", 3, "result", "协同调度", "协同调度", "")], [(1, "u1", "实验 结果 表明 采用 规划", 0.6), (2, "u2", "实验 结果 表明", 0.6), (3, "u3", "调度", 0.6), (3, "u4", "协同调度", 0.6)])
    assert got["z"][:3] == ("partially_supported", "needs_qualification", "u1")  # one general term is no specific hit
    assert got["y"][0] == "not_checked"  # nothing but stop words
    assert got["x"] == ("semantically_supported", "safe", "u4", "u3", "")


def test_frame_search_equals_the_plain_score(spark):
    import random

    from lexforge.functions import frame_terms as C

    rng = random.Random(5)
    words = ["planner", "accuracy", "RAG", "plan", "latency", "robot", "任务规划", "局限"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
    fields = list(C.FIELDS)
    rows = [(f"f{n:03d}", *[text() if rng.random() < 0.6 else None for _ in fields], rng.randint(0, 3), rng.choice([None, 0.5, 0.9]), rng.choice([None, 0.3, 0.7]), rng.randint(0, 2), rng.choice(["structurally_supported", "unchecked", "unsupported"]), rng.choice(["contradicted", "related_only", "other"])) for n in range(300)]
    df = spark.createDataFrame(rows, "frame_id string, " + ", ".join(f"{f} string" for f in fields) + ", n_units int, confidence double, quality_score double, n_noise int, support_status string, semantic_support_status string").repartition(3)
    asked = [(1, "planner latency"), (2, "任务规划的局限"), (3, "plan Plan RAG"), (4, ""), (5, None), (6, "zzz yyy")]

    def score(r, query, found):
        weak = any(t in " ".join((query or "").split()).lower() for t in C.WEAK_QUERY)
        q, support = 0.6 if r[10] is None else r[10], r[12]
        if not weak and (q < C.MIN_QUALITY or support == "unsupported"):
            return 0.0
        s = sum(w * sum(t.lower() in (r[1 + k] or "").lower() for t in found) for k, w in enumerate(C.FIELDS.values()))
        s += 0.2 * r[8] + 0.3 * (r[9] or 0.0) + 0.5 * q + {"structurally_supported": 0.4, "unchecked": 0.15, "unsupported": -0.3 if weak else -1.2}[support]
        return s + C.SUPPORT.get(r[13], (0, 0))[weak] - 0.3 * r[11]

    queries = spark.createDataFrame(asked, "query_id int, query string")
    terms = {r["query_id"]: r["t"] for r in queries.select("query_id", frames.T.frame_terms(frames.T.text_of("query")).alias("t")).collect()}
    want = []
    for i, query in asked:
        best = sorted(((-round(score(r, query, terms[i]), 6), r[0]) for r in rows if score(r, query, terms[i]) > 0))[:8]
        want += [(i, n + 1, f, round(-s, 3)) for n, (s, f) in enumerate(best)]
    for block in (1000, 2):
        assert sorted(tuple(r) for r in frames.search(queries, df, 8, block).collect()) == sorted(want)
    assert frames.search(queries.limit(0), df).collect() == []


def test_alignment_follows_order(spark):
    rows = [(1, "method", f"f{k}", k % 3, k, ["acc"] if k % 2 else ["lat"], [], ["planner"] if k < 3 else ["other"], "fam" if k < 3 else "", "neutral") for k in range(6)]
    df = spark.createDataFrame(rows, "query_id int, claim_type string, frame_id string, doc_id int, position int, metric_terms array<string>, setting_terms array<string>, subject_terms array<string>, method_family string, polarity string")
    grp = {r["frame_id"]: r["grp"] for r in frames.align(df).collect()}
    assert grp["f0"] == grp["f1"] == grp["f2"] and grp["f3"] == grp["f1"]
    rel = frames.relations(df, frames.align(df)).collect()
    assert rel and all(r["relation"] == "supports" and r["source_frame_id"] < r["target_frame_id"] for r in rel)


def test_metrics_of_empty_expectations(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], "query_id int, rank int, item string")
    w = spark.createDataFrame([(1, "b"), (1, "c"), (3, "z")], "query_id int, item string")
    got = {x["query_id"]: (x["recall"], x["precision"], x["mrr"]) for x in evals.metrics(r, w, q).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}


def test_records(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, records.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    fb = spark.createDataFrame([(5, "fine  work"), (9, "x"), (3, "see https://a.b")], "r int, c string").select(records.valid_feedback(F.col("r"), F.col("c")).alias("v")).collect()
    assert [(r["v"]["accepted"], r["v"]["comment"]) for r in fb] == [(True, "fine work"), (False, "x"), (False, "")]
    m = spark.range(1).select(records.sanitize(F.create_map(F.lit("text"), F.lit("x"), F.lit("n"), F.lit("1"))).alias("m"), records.merged_content(F.lit("a b"), F.lit("b")).alias("a"), records.merged_content(F.lit("a"), F.lit("c")).alias("b")).first()
    assert m["m"] == {"n": "1"} and m["a"] == "a b" and m["b"] == "a\nc"
    ev = spark.createDataFrame([("s", d, p, f"i{p}") for d in (1, 2) for p in (1, 2, 3)] + [("s", 1, 3, "i3")], "section string, doc_id int, priority int, item string")
    assert [(r["doc_id"], r["item"]) for r in records.round_robin(ev, 3).orderBy("rank").collect()] == [(1, "i3"), (2, "i3"), (1, "i2")]


def test_containment(spark):
    rows = spark.createDataFrame([(1, "a cat"), (2, None), (3, "dog")], "k int, hay string")
    terms = spark.createDataFrame([("cat",), ("a",), ("",), (None,), ("cat",)], "term string")
    assert sorted(map(tuple, contained(rows, terms).collect())) == [(1, "a"), (1, "cat")]
    f = Finder(["ab", "b"])
    plain = Finder(["ab", "b"])
    plain.machine = None
    assert f.find("xab") == plain.find("xab") == [0, 1]


def test_repeated_lines_and_sentences(spark):
    d = spark.createDataFrame([(1, "Page 1\nbody of text\nPage 2\n\n")], "doc_id int, text string")
    assert [tuple(r) for r in nodes.repeated_lines(d).collect()] == [(1, "page #", 2)]
    s = nodes.sentences(nodes.line_nodes(spark.createDataFrame([(1, "One long enough sentence. Short. 另一个足够长的句子在这里写着吗？")], "doc_id int, text string")), ["doc_id"])
    assert [r["sentence"] for r in s.collect()] == ["One long enough sentence", "另一个足够长的句子在这里写着吗"]


def test_evolution_and_windows(spark):
    df = files.with_columns(spark.createDataFrame([(1,)], "a int"), {"a": ("int", 0), "b": ("string", "x")})
    assert tuple(df.first()) == (1, "x")
    assert T.clamp01(F.lit("x"), 0.5) is not None
