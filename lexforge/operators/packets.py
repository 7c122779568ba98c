"""From hits to evidence: the nodes around hits as packets, and a report that
joins the results of several ways of search.

Each hit opens a window of nodes on either side of it. Windows of one query in
one document that touch or overlap are one packet: sorted by where they begin, a
window opens a new packet if it begins beyond the furthest end so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.lexical import ranked

# What path and heading say about evidence, in order, and its usual confidence.
KINDS = {
    "abstract": ["abstract", "摘要"],
    "method": ["method", "方法", "算法", "模型", "框架"],
    "result": ["experiment", "evaluation", "result", "实验", "评估", "结果", "消融"],
    "limitation": ["limitation", "discussion", "局限", "不足", "讨论"],
    "reference": ["reference", "citation", "参考文献", "引用"],
}
PLAIN = ["document", "section", "page", "paragraph"]
CONFIDENCE = 0.75


def evidence_type(kind: Column, path: Column, heading: Column) -> Column:
    text = F.lower(F.concat_ws(" ", path, heading))
    out = F.when(kind.isin(PLAIN), kind).otherwise("paragraph")
    for name, words in reversed(KINDS.items()):
        out = F.when(T.any_term(text, words), name).otherwise(out)
    return F.when(kind.isin("abstract", "reference"), kind).otherwise(out)


def merged_hits(modes: dict[str, DataFrame]) -> DataFrame:
    """(query_id, node_id, modes, best, score): each node once, with the modes
    that found it in the order of their names, its best rank and that mode's
    score. Each of ``modes`` has (query_id, rank, node_id, score)."""
    every = reduce(DataFrame.unionByName, [df.select("query_id", "node_id", "rank", F.col("score").cast("double").alias("score"), F.lit(name).alias("mode")) for name, df in modes.items()])
    return every.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_set("mode")).alias("modes"), F.min("rank").alias("best"), F.min_by("score", F.struct("rank", "mode")).alias("score"))


def windows(hits: DataFrame, nodes: DataFrame, around: int = 1) -> DataFrame:
    """(query_id, doc_id, first, last, hits, best, modes): packets as ranges of
    ``order_index``; ``hits`` counts the nodes that were found in one."""
    at = nodes.select("node_id", "doc_id", "order_index")
    spans = hits.join(at, "node_id").select("query_id", "doc_id", "best", "modes", (F.col("order_index") - around).alias("low"), (F.col("order_index") + around).alias("high"))
    order = Window.partitionBy("query_id", "doc_id").orderBy("low")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # one packet also where a window begins right behind the one before
    opened = spans.withColumn("_new", F.coalesce((F.col("low") > before + 1).cast("int"), F.lit(1))).withColumn("packet", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return opened.groupBy("query_id", "doc_id", "packet").agg(F.min("low").alias("first"), F.max("high").alias("last"), F.count("*").alias("hits"), F.min("best").alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("modes")))).alias("modes")).drop("packet")


def packets(hits: DataFrame, nodes: DataFrame, around: int = 1, k: int = 8) -> DataFrame:
    """The best ``k`` packets of each query, ordered by their best hit: (query_id,
    rank, doc_id, first, last, hits, modes, evidence_type, confidence, excerpt).

    ``nodes`` (doc_id, node_id, order_index, type, heading, node_path, text). The
    excerpt is the text of all nodes of a packet, in order; its type is that of
    its first node. Ends are cut to nodes that there are.
    """
    found = windows(hits, nodes, around)
    best = ranked(found, k, F.col("best"), F.col("doc_id"), F.col("first"))
    parts = best.withColumn("order_index", F.explode(F.sequence("first", "last"))).select("query_id", "rank", "doc_id", "order_index")
    own = nodes.select("doc_id", F.col("order_index").cast("long").alias("order_index"), evidence_type(F.col("type"), T.text_of("node_path"), T.text_of("heading")).alias("kind"), "text")
    said = parts.withColumn("order_index", F.col("order_index").cast("long")).join(own, ["doc_id", "order_index"]).groupBy("query_id", "rank").agg(
        F.min("order_index").alias("from_"), F.max("order_index").alias("to_"), F.min_by("kind", "order_index").alias("evidence_type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "text"))), lambda x: x["text"]), "\n\n").alias("excerpt"),
    )
    out = best.join(said, ["query_id", "rank"])
    return out.select("query_id", "rank", "doc_id", F.col("from_").alias("first"), F.col("to_").alias("last"), "hits", "modes", "evidence_type", F.lit(CONFIDENCE).alias("confidence"), "excerpt")


def report(queries: DataFrame, modes: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """One row for each query: (query_id, nodes, documents, counts, top_doc, agreed, warnings).

    ``counts`` has the number of results of each mode, ``agreed`` the nodes that
    more than one mode found; a mode without a result, and a query without any,
    are warned of.
    """
    hits = merged_hits(modes).join(nodes.select("node_id", "doc_id"), "node_id")
    names = sorted(modes)
    found = lambda n: F.count_if(F.array_contains("modes", n))
    per = hits.groupBy("query_id").agg(F.count("*").alias("nodes"), F.count_distinct("doc_id").alias("documents"), F.min_by("doc_id", F.struct("best", "doc_id")).alias("top_doc"), F.count_if(F.size("modes") > 1).alias("agreed"), *[found(n).alias(f"_{n}") for n in names])
    both = queries.select("query_id").join(per, "query_id", "left").fillna(0, ["nodes", "documents", "agreed", *[f"_{n}" for n in names]])
    counts = F.concat_ws(",", *[F.concat(F.lit(f"{n}:"), F.col(f"_{n}").cast("string")) for n in names])
    warnings = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{n}") == 0, f"no_{n}_results") for n in names], F.when(F.col("nodes") == 0, "no_search_results"))), ",")
    return both.select("query_id", "nodes", "documents", counts.alias("counts"), "top_doc", "agreed", warnings.alias("warnings"))
