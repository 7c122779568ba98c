"""Packets, rule facts, roll-ups and snapshots on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import fact_terms
from lexforge.operators import citations, packets, rollups, rule_facts, snapshots

NODES = "doc_id long, node_id string, order_index int, type string, heading string, node_path string, text string"


def test_overlapping_hits_are_one_packet(spark):
    rows = [(d, f"{d}:{i}", i, "paragraph", "Methods" if d == 2 else "", "", f"t{d}.{i}") for d in (1, 2) for i in range(10)]
    nodes = spark.createDataFrame(rows, NODES)
    hit = lambda rows: spark.createDataFrame(rows, "query_id int, rank int, node_id string, score double")
    modes = {"fts": hit([(1, 1, "1:2", -3.0), (1, 2, "1:4", -2.0), (1, 3, "1:9", -1.0), (2, 1, "2:0", -1.0)]), "like": hit([(1, 1, "1:4", 0.0), (1, 2, "2:5", 0.0)])}
    got = {(r["query_id"], r["rank"]): r for r in packets.packets(packets.merged_hits(modes), nodes).collect()}
    # 1..3 and 3..5 overlap; 8..10 is cut to the last node; ranks go by the best hit
    assert [(r["doc_id"], r["first"], r["last"], r["hits"], r["modes"]) for k, r in sorted(got.items())] == [(1, 1, 5, 2, ["fts", "like"]), (2, 4, 6, 1, ["like"]), (1, 8, 9, 1, ["fts"]), (2, 0, 1, 1, ["fts"])]
    assert got[1, 1]["excerpt"] == "\n\n".join(f"t1.{i}" for i in range(1, 6)) and got[1, 1]["evidence_type"] == "paragraph" and got[2, 1]["evidence_type"] == "method"
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    report = {r["query_id"]: r for r in packets.report(asked, modes, nodes).collect()}
    assert report[1]["counts"] == "fts:3,like:2" and report[1]["agreed"] == 1 and report[1]["documents"] == 2
    assert report[2]["warnings"] == "no_like_results" and report[3]["warnings"] == "no_fts_results,no_like_results,no_search_results" and report[3]["top_doc"] is None


def test_rule_facts_with_their_own_lists(spark):
    rows = [
        (1, "n0", 0, "section", "绪论", "", "本文提出一种任务规划方法用于服务机器人。引用见[1]和[2]。"),
        (1, "n1", 1, "paragraph", "", "", "该方法的局限是任务规划在动态环境中难以扩展，需要进一步验证。"),
        (1, "n2", 2, "paragraph", "", "", "nothing of note in this one at all"),
        (1, "n3", 3, "reference", "", "References", "[1] 张三. 任务规划综述. 2019"),
        (1, "n4", 4, "paragraph", "", "", "evidence without any of the terms, chosen by hand"),
        (2, "m0", 0, "paragraph", "", "", None),
    ]
    nodes = spark.createDataFrame(rows, NODES).withColumn("kind", F.col("type"))
    evidence = spark.createDataFrame([(1, "n4", 0), (1, "gone", 1)], "doc_id long, node_id string, at int")
    refs, said = citations.citation_map(nodes)
    order = said.join(nodes.select("node_id", "order_index"), "node_id").groupBy("doc_id", "node_id").agg(F.min("order_index").alias("at"))
    chosen = rule_facts.fact_nodes(nodes, evidence, order).orderBy("place").collect()
    assert [(r["node_id"], r["tier"]) for r in chosen] == [("n4", 0), ("n0", 1), ("n1", 2)]
    assert [r["node_id"] for r in rule_facts.fact_nodes(nodes, evidence, order, most=2).orderBy("place").collect()] == ["n4", "n0"]
    terms = spark.createDataFrame(rule_facts.dictionary(), "term string, type string, priority int")
    docs = spark.createDataFrame([(1, "论文"), (2, None)], "doc_id long, title string")
    facts = rule_facts.extracted(docs, nodes, refs, said, terms, evidence).collect()
    claims = {r["node_id"]: r["type"] for r in facts if r["fact_type"] == "claim"}
    # types go by the first list that has a token: a method before a contribution, a problem (难以) before a limitation
    assert claims["n0"] == "method" and claims["n1"] == "problem" and claims["n4"] == "claim"
    entities = {(r["node_id"], r["type"], r["text"]) for r in facts if r["fact_type"] == "entity"}
    assert {("n0", "task", "任务规划"), ("n0", "scenario", "服务机器人"), ("n1", "scenario", "动态环境"), ("n0", "citation", "任务规划综述"), ("n0", "citation", "ref_2")} <= entities
    relations = {(r["type"], r["object_name"]) for r in facts if r["fact_type"] == "relation"}
    assert {("supports", "n0"), ("uses", "任务规划"), ("cites", "ref_1"), ("cites", "ref_2")} <= relations
    assert all(r["doc_id"] == 1 for r in facts)
    limits = rule_facts.A.mentions(spark.createDataFrame([r for r in facts if r["fact_type"] == "claim"]).withColumn("type", F.lit("limitation")), spark.createDataFrame([r for r in facts if r["fact_type"] == "entity"]))
    assert {r["type"] for r in limits.collect()} == {"limits"}
    assert set(fact_terms.CLAIM_TOKENS) == {"problem", "method", "contribution", "result", "limitation"}


def test_rollups_tell_null_keys_from_totals(spark):
    rows = [("a", 1, "answerable", ["w:1"], 2), ("a", None, "conflicting", ["w:2", "v"], 1), (None, 1, None, [], 4), ("b", 2, "answerable", None, 1)]
    plans = spark.createDataFrame(rows, "side string, topic int, answerability string, warnings array<string>, strong int")
    for b in rollups.BUCKETS[1:]:
        plans = plans.withColumn(b, F.lit(None).cast("int"))
    got = {(r["level"], r["side"], r["topic"]): r for r in rollups.answer_plans(plans, ["side", "topic"]).collect()}
    assert len(got) == 1 + 3 + 4 and got[0, None, None]["plans"] == 4 and got[0, None, None]["strong"] == 8 and got[0, None, None]["related"] == 0
    assert got[1, None, None]["plans"] == 1 and got[2, "a", None]["strong"] == 1 and got[1, "a", None]["answerability_counts"] == "answerable:1,conflicting:1"
    top = {(r["level"], r["side"], r["topic"], r["rank"]): (r["warning"], r["n"]) for r in rollups.warnings(plans, ["side", "topic"]).collect()}
    assert top[0, None, None, 1] == ("w", 2) and top[0, None, None, 2] == ("v", 1) and top[2, "a", 1, 1] == ("w", 1)
    groups = spark.createDataFrame([("a", 3, 2, True, 0.5), ("a", 1, 1, False, 0.25), ("b", 2, 1, False, 1.0)], "side string, claims int, documents int, conflicting boolean, score double")
    total = rollups.alignments(groups, ["side"]).filter("level = 0").first()
    assert (total["groups"], total["claims"], total["conflicting_groups"], total["gaps"], total["max_score"]) == (3, 6, 1, 2, 1.0)


@pytest.mark.parametrize("changes", [0, 5, 400])
def test_snapshots_read_only_what_differs(spark, changes):
    rng = random.Random(changes)
    old = {f"doc/{k}": f"h{k}" for k in range(1500)}
    new = dict(old)
    for k in rng.sample(range(1500), changes):
        kind = rng.choice(["added", "removed", "changed"])
        new.pop(f"doc/{k}") if kind == "removed" else new.update({f"doc/{k}" if kind == "changed" else f"new/{k}": "other"})
    left, right = (spark.createDataFrame(list(x.items()), "path string, hash string") for x in (old, new))
    want = {p: "added" if p not in old else "removed" if p not in new else "changed" for p in old.keys() | new.keys() if old.get(p) != new.get(p)}
    assert {r["path"]: r["change"] for r in snapshots.compared(left, right).collect()} == want
    share = snapshots.read_share(left, right).collect()
    assert [r["ranges"] for r in share] == [16, 256, 4096] and all(r["differing"] <= len(want) for r in share)
    with pytest.raises(ValueError):
        snapshots.compared(left, right, (20,))
