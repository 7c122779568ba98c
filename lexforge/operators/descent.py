"""Descent in heading trees: from chosen sections to evidence, with its trace.

A node's place in reading order and the place where its subtree ends number the
tree, so "below a section" is an interval. The best leaf of a section is an
interval join with an arg-max, and so is the best score of a subtree; no node is
copied to each of its ancestors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators import tree
from lexforge.operators.lexical import ranked

#: Beyond the last node of any document.
END = (1 << 63) - 1


def intervals(nodes: DataFrame) -> DataFrame:
    """Adds ``leave``: the place of the first later node of the same or a
    smaller level, or ``END``. A node's subtree is order_index .. leave - 1."""
    back = Window.partitionBy("doc_id").orderBy(F.col("order_index").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # of the nodes read before, backwards, the last of each level is the nearest
    near = {n: F.last(F.when(F.col("level") <= n, F.col("order_index")), ignorenulls=True).over(back) for n in range(tree.LEVELS + 2)}
    marked = nodes.withColumns({f"_n{n}": c for n, c in near.items()})
    leave = reduce(lambda rest, n: F.when(F.col("level") == n, F.col(f"_n{n}")).otherwise(rest), near, F.lit(None).cast("long"))
    return marked.withColumn("leave", F.coalesce(leave, F.lit(END))).drop(*[f"_n{n}" for n in near])


def all_scores(nodes: DataFrame, routed: DataFrame, signals: DataFrame, profiles: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Scores of every node of the documents that queries are routed to.

    ``routed`` (query_id, doc_id); ``signals`` (query_id, node_id, rank,
    vector_score) of the nodes that a flat search found; others have none.
    """
    every = routed.select("query_id", "doc_id").distinct().join(nodes.select("doc_id", "node_id"), "doc_id").select("query_id", "node_id")
    return tree.node_scores(nodes, every.join(signals.select("query_id", "node_id", "rank", "vector_score"), ["query_id", "node_id"], "left"), profiles, quality)


def evidence(scored: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, doc_id, place, node_id, section_id, score): the chosen nodes
    (query_id, doc_id, node_id, place), each section replaced by the best leaf
    below it, if it has any; a node that comes twice stays where it came first."""
    there = intervals(nodes).select("doc_id", "node_id", "order_index", "leave", (F.col("text") == "").alias("bare"))
    own = chosen.select("query_id", "doc_id", "node_id", "place").join(there, ["doc_id", "node_id"])
    leaves = scored.filter("text <> ''").select("query_id", "doc_id", F.col("node_id").alias("leaf"), F.col("order_index").alias("at"), F.col("score").alias("leaf_score"))
    below = own.filter("bare").join(leaves, ["query_id", "doc_id"]).filter("at > order_index AND at < leave")
    best = below.groupBy("query_id", "doc_id", "node_id").agg(F.min_by("leaf", F.struct(-F.round("leaf_score", 9), "at", "leaf")).alias("leaf"))
    down = own.join(best, ["query_id", "doc_id", "node_id"], "left").select("query_id", "doc_id", "place", F.col("node_id").alias("section_id"), F.coalesce("leaf", "node_id").alias("node_id"))
    once = down.groupBy("query_id", "doc_id", "node_id").agg(F.min("place").alias("place"), F.min_by("section_id", "place").alias("section_id"))
    order = Window.partitionBy("query_id", "doc_id").orderBy("place")
    kept = once.withColumn("place", F.row_number().over(order))
    return kept.join(scored.select("query_id", "node_id", "score"), ["query_id", "node_id"]).select("query_id", "doc_id", "place", "node_id", "section_id", "score")


def subtree_scores(scored: DataFrame, subtrees: DataFrame) -> DataFrame:
    """``subtrees`` (query_id, doc_id, node_id, order_index, leave) with the best
    score in each."""
    scores = scored.select("query_id", "doc_id", F.col("order_index").alias("at"), "score")
    met = subtrees.join(scores, ["query_id", "doc_id"]).filter("at >= order_index AND at < leave")
    return met.groupBy("query_id", "doc_id", "node_id").agg(F.max("score").alias("subtree_score"))


def paths(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, doc_id, place, node_id, path): the way to each evidence node."""
    return found.select("query_id", "doc_id", "place", "node_id").join(nodes.select("node_id", "path"), "node_id").select("query_id", "doc_id", "place", "node_id", "path")


def expanded(found: DataFrame, nodes: DataFrame, scored: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, doc_id, node_id, chosen, rank, child, subtree_score): every
    node on the ways, the child that was taken first, and its ``most`` best
    children by the best score in their subtrees."""
    steps = paths(found, nodes).select("query_id", "doc_id", "place", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("k", "node_id"))
    steps = steps.select("query_id", "doc_id", "place", "k", "node_id", F.get("path", F.col("k") + 1).alias("chosen"))
    first = steps.groupBy("query_id", "doc_id", "node_id").agg(F.min_by("chosen", F.struct("place", "k")).alias("chosen"))
    child = intervals(nodes).select("doc_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child"), "order_index", "leave")
    both = first.join(child, ["doc_id", "node_id"])
    best = subtree_scores(scored, both.select("query_id", "doc_id", F.col("child").alias("node_id"), "order_index", "leave")).withColumnRenamed("node_id", "child")
    scored_children = both.join(best, ["query_id", "doc_id", "child"], "left").withColumn("subtree_score", F.coalesce("subtree_score", F.lit(0.0))).withColumn("_g", F.concat_ws("|", F.col("query_id").cast("string"), "node_id"))
    return ranked(scored_children, most, F.round("subtree_score", 9).desc(), F.col("order_index"), partition="_g").select("query_id", "doc_id", "node_id", "chosen", "rank", "child", "subtree_score")


def tree_search(nodes: DataFrame, routed: DataFrame, signals: DataFrame, profiles: DataFrame, quality: DataFrame | None = None, k: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, paths, expanded) of queries over the documents they are routed
    to: results (query_id, rank, doc_id, place, node_id, section_id, score).

    Each document gives at least two nodes and its share of ``k``.
    """
    # the trees of other documents are in no way's reach; as a key of all windows, the document cuts them before they are made
    nodes = nodes.join(F.broadcast(routed.select("doc_id").distinct()), "doc_id", "left_semi")
    scored = all_scores(nodes, routed, signals, profiles, quality)
    share = routed.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.greatest(F.lit(2), F.ceil(F.lit(k) / F.count("*"))).alias("budget"))
    chosen = tree.select_nodes(scored.join(share, "query_id"), "budget")
    found = evidence(scored, nodes, chosen)
    results = ranked(found, k, F.round("score", 9).desc(), F.col("doc_id"), F.col("place"))
    return results.select("query_id", "rank", "doc_id", "place", "node_id", "section_id", "score"), paths(found, nodes), expanded(found, nodes, scored)
