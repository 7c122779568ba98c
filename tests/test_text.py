from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import hybrid, lexical, nodes, vector


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("v")).first()["v"]


def test_terms_of_both_scripts(spark):
    assert one(spark, "the memory of 任务规划系统 x2 memory", T.fallback_terms) == ["任务规划", "the", "memory", "任务规划系统", "任务", "务规", "规划", "划系", "系统"]
    assert one(spark, "!!", T.fallback_terms) == ["!!"]
    assert one(spark, "多智能体 Agent_1", T.fts_query) == "多智能体 OR 多智 OR 智能 OR 能体 OR Agent_1"
    assert one(spark, "", T.fts_query) == '""'
    assert one(spark, "The Model and the model for Planning", T.keywords) == ["Model", "Planning"]
    assert one(spark, "多智能", lambda c: T.embedding_tokens(c)) == ["多智能", "多智", "智能", "多智能"]
    assert one(spark, "what does PaperX use? paperx", T.focus_terms) == ["PaperX"]


def plain_chunks(text, size):
    import re

    parts = [p.strip() for p in re.split(r"\n\s*\n+", text.replace("\r\n", "\n").replace("\r", "\n")) if p.strip()]
    out, held = [], []
    for p in parts:
        if held and sum(map(len, held)) + len(p) > size:
            out.append("\n\n".join(held))
            held = []
        if len(p) > size:
            out += [c for at in range(0, len(p), size) if (c := p[at : at + size].strip())]
        else:
            held.append(p)
    return out + (["\n\n".join(held)] if held else [])


def test_chunks(spark):
    for text in ["", " \n ", "a", "a\n\nb\n \n\nc", "x" * 25, "ab\n\n" + "y" * 23 + "\n\ncd\n\nef", "aaaa\r\n\r\nbbbb\n\ncccc\n\ndddd", "one two\n\n" * 9]:
        assert one(spark, text, lambda c: T.chunks(c, 10)) == plain_chunks(text, 10), text


def test_citations(spark):
    assert one(spark, "see [1], [2-4] and [1, 7]; not [x]", T.citation_numbers) == [1, 2, 3, 4, 7]
    assert one(spark, "none", T.citation_numbers) == []


def test_excerpts_and_keys(spark):
    assert one(spark, "a  b\tc　d", T.compact) == "a b c d"
    assert one(spark, "one two three", lambda c: T.first_words(c, 2)) == "one two ..."
    assert one(spark, " ...Hello World. ", T.normalize_key) == "helloworld"
    assert one(spark, "Größe-12 %", T.fact_key) == "größe12"
    assert one(spark, "abcdef", lambda c: T.excerpt(c, 3, " ...")) == "abc ..."


def test_noise(spark):
    assert one(spark, "copyright x", T.noise_reasons) == ["front_matter"]
    assert one(spark, "page 3", T.noise_reasons) == ["page_marker"]
    assert one(spark, "Table 1 and Table 1 again", T.noise_reasons) == ["repeated_caption"]
    assert one(spark, "a > b > c", T.noise_reasons) == ["path_fragment"]
    assert one(spark, "[12] Someone", T.noise_reasons) == ["reference_entry"]
    assert one(spark, "a result", T.noise_reasons) == [] and one(spark, "", T.noise_reasons) == []
    assert one(spark, "图1 系统结构图 图1 系统结构图。页脚 copyright。方法有效", T.clean_research_text).count("图1") == 1


def test_intents(spark):
    want = {"compare these": "compare", "a survey": "review", "who cites it": "citation", "citation of it": "citation", "its limitation": "limitation", "which metric": "experiment", "the algorithm": "method", "有什么区别": "compare", "hello": "qa", None: "qa"}
    for text, intent in want.items():
        assert one(spark, text, hybrid.intent) == intent, text


def test_hash_embeddings_agree(spark):
    texts = ["", "agent memory agent", "多智能体 planning", None, "the café"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["vector"] for r in vector.hash_embeddings(rows, "id", T.text_of("t")).collect()}
    cells = {}
    for r in vector.hash_features(rows, "id", T.text_of("t")).collect():
        cells.setdefault(r["id"], {})[r["idx"]] = r["value"]
    for k, v in got.items():
        assert {i for i, x in enumerate(v) if x} == set(cells.get(k, {}))
        norm = sum(x * x for x in cells.get(k, {}).values()) ** 0.5
        assert all(abs(v[i] - x / norm) < 1e-7 for i, x in cells.get(k, {}).items())


def test_index_is_incremental(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c d")], "id int, text string")
    asked = []
    first = vector.build_index(rows, None)
    status = vector.index_status(rows, first).first()
    assert status["coverage"] == 1.0 and not status["needs_rebuild"]
    changed = spark.createDataFrame([(1, "a b"), (2, "new"), (3, "more")], "id int, text string")
    assert vector.index_status(changed, first).first()["n_embedded"] == 1
    second = vector.build_index(changed, first, provider=lambda texts: [[float(len(t)), 0.0] for t in texts])
    assert {r["id"]: r["dim"] for r in second.collect()} == {1: 256, 2: 2, 3: 2}
    assert asked == []


def test_bm25_matches_its_formula(spark):
    import math

    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog the dog"), (3, "Café cat"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cat cafe"), (2, "zzz"), (3, "")], "query_id long, query string")
    n = nodes.line_nodes(docs)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.fts_nodes(asked, n, 5).collect()}
    average = (3 + 4 + 2) / 3

    def w(tf, df, length):
        return max(1e-6, math.log((3 - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))

    assert got.keys() == {(1, 1), (1, 3)}
    assert abs(got[1, 1] + w(1, 2, 3)) < 1e-6 and abs(got[1, 3] + w(1, 2, 2) + w(1, 1, 2)) < 1e-6


def test_snippet(spark):
    text = " ".join(f"w{k}" for k in range(50))
    got = one(spark, text, lambda c: lexical.snippet(c, F.lit("w30"), 9))
    assert got == " ... w27 w28 w29 [w30] w31 w32 w33 w34 w35 ... "


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, node_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 20), (1, "x", 12)], "query_id int, node_id string, rank int")
    p = spark.createDataFrame([(1, 1.0, 1.0)], "query_id int, fts_weight double, vector_weight double")
    got = {r["node_id"]: r for r in hybrid.fuse(a, b, p).collect()}
    assert got["y"]["rank"] == 1 and abs(got["y"]["hybrid_score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert [got[n]["hybrid_conflict"] for n in "xyz"] == ["rank_divergence", "", "vector_without_fts"]


def test_routing(spark):
    docs = spark.createDataFrame([(1, "agent memory", "about agents"), (2, "other", "memory"), (3, None, None)], "doc_id int, title string, abstract string")
    asked = spark.createDataFrame([(1, "Agent memory")], "query_id int, query string")
    got = {r["doc_id"]: r for r in hybrid.route(asked, docs).collect()}
    assert got[1]["routing_score"] == 3.0 * 2 + 2.5 and got[2]["routing_score"] == 2.5 and 3 not in got
    assert got[1]["field_hits"] == ["title", "abstract"] and got[1]["fallback_reason"] == "doc_card_field_match"
