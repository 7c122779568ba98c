"""Graphs of facts: nodes and edges, neighbourhoods and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first in order, or the last."""
    by = [F.col(c).desc() if last else F.col(c) for c in order]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_r = 1").drop("_r")


def knowledge_graph(facts: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, doc_id) and edges (id, source, target, type).

    Documents, evidence nodes and facts are nodes; an edge leads from each
    document to its facts, from each fact to its evidence, and from a
    relation's subject to its object where both resolve: by fact id, else by
    name within the document, else by name in any document. Of equal node ids
    the first row stays (facts: by type, then label), of equal edges the last.
    """
    doc = docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("document").alias("type"), F.col("title").cast("string").alias("label"), "doc_id", F.lit(0).alias("part"))
    fact = facts.select(F.concat(F.lit("fact:"), "fact_id").alias("id"), F.col("fact_type").alias("type"), F.substring("text", 1, 120).alias("label"), "doc_id", F.lit(1).alias("part"))
    evidence = facts.filter("node_id <> ''").select(F.concat(F.lit("node:"), "node_id").alias("id"), F.lit("evidence").alias("type"), F.col("node_id").alias("label"), "doc_id", F.lit(2).alias("part")).distinct()
    nodes = first_wins(doc.unionByName(fact).unionByName(evidence), ["id"], ["part", "type", "label"]).drop("part")
    of = facts.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source"), F.concat(F.lit("fact:"), "fact_id").alias("target"), F.lit("has_fact").alias("type"))
    by = facts.filter("node_id <> ''").select(F.concat(F.lit("fact:"), "fact_id").alias("source"), F.concat(F.lit("node:"), "node_id").alias("target"), F.lit("supported_by").alias("type"))
    edges = of.unionByName(by).unionByName(_relations(facts))
    edges = edges.select("source", "target", "type").distinct()  # equal edges differ in nothing that is kept
    return nodes, edges.withColumn("id", F.substring(F.sha2(F.concat_ws("|", "source", "target", "type"), 256), 1, 16)).select("id", "source", "target", "type")


def _relations(facts: DataFrame) -> DataFrame:
    out = facts.filter("fact_type = 'relation'").select("doc_id", "subject_name", "object_name", "type")
    others = facts.filter("fact_type <> 'relation'")
    # texts that are longer than every name asked for are none of them, so they are not sent to meet those
    longest = out.agg(F.max(F.greatest(F.length("subject_name"), F.length("object_name"))).alias("_longest"))
    named = others.select("fact_id", "doc_id", F.col("text").alias("name"), "position").join(F.broadcast(longest), F.length("name") <= F.col("_longest")).drop("_longest")
    # the last of each name, by aggregates: a name may be that of most facts
    last = F.max(F.struct("position", "fact_id"))["fact_id"]
    here = named.groupBy("doc_id", "name").agg(last.alias("by_doc"))
    anywhere = named.groupBy("name").agg(last.alias("by_name"))
    ids = others.select(F.col("fact_id").alias("name")).distinct().withColumn("by_id", F.col("name"))
    for end in ("subject", "object"):
        found = out.join(ids.withColumnRenamed("name", f"{end}_name"), f"{end}_name", "left")
        found = found.join(here.withColumnRenamed("name", f"{end}_name"), ["doc_id", f"{end}_name"], "left")
        found = found.withColumn(end, F.coalesce("by_id", "by_doc"))
        # only ends that are not resolved ask by name alone; the others are spread, not met at a common name
        asks = F.when(F.col(end).isNull(), F.concat(F.lit("n"), f"{end}_name")).otherwise(F.concat(F.lit("-"), end))
        found = found.withColumn("_asks", asks).join(anywhere.select(F.concat(F.lit("n"), "name").alias("_asks"), "by_name"), "_asks", "left")
        out = found.withColumn(end, F.coalesce(end, "by_name")).drop("by_id", "by_doc", "by_name", "_asks")
    ends = out.filter("subject IS NOT NULL AND object IS NOT NULL")
    return ends.select(F.concat(F.lit("fact:"), "subject").alias("source"), F.concat(F.lit("fact:"), "object").alias("target"), "type")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps (0 to 4) of ``seeds`` (id), edges
    taken in both directions, with the fewest steps."""
    depth = max(0, min(4, depth))
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = seen.filter(F.col("depth") == d - 1).select(F.col("id").alias("source"))
        step = both.join(front, "source", "left_semi").select(F.col("target").alias("id")).distinct()
        seen = seen.unionByName(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
    return seen


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, type, degree) of every node; isolated nodes have 0."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id", "type").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(ends, "id", "left_anti")


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, type, n): counts of nodes and edges by type, and of isolated nodes."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_met", F.lit(True))
    counted = nodes.select("id", "type").join(ends, "id", "left").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("_met").isNull()).alias("alone"))
    parts = F.array(F.struct(F.lit("node").alias("part"), F.col("n")), F.struct(F.lit("isolated").alias("part"), F.col("alone").alias("n")))
    n = counted.select("type", F.explode(parts).alias("p")).select("p.part", "type", "p.n").filter("n > 0")
    e = edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "type", "n")
    return n.unionByName(e)


def fact_report(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """The :func:`report` of the :func:`knowledge_graph` of facts and documents,
    counted from the facts, without the graph: neither nodes nor edges are made.

    Ids of facts are not null. A fact's edge from its document leaves neither of
    them alone, so only documents without facts are isolated.
    """
    # what differs within a fact id is counted where the id's rows meet, by ranks: a count of distinct values would deal the rows out twice more
    met = facts.select("fact_id", "fact_type", "doc_id", F.nullif("node_id", F.lit("")).alias("node_id")).repartition("fact_id")
    place = lambda c: F.dense_rank().over(Window.partitionBy("fact_id").orderBy(c))
    ranked = met.withColumns({"_of": place("doc_id"), "_by": place("node_id")})  # null has a rank: a fact without a document has an edge all the same, one without a node has none
    each = ranked.groupBy("fact_id").agg(F.min("fact_type").alias("type"), F.max("_of").alias("of"), (F.max("_by") - F.max(F.col("node_id").isNull().cast("int"))).alias("by"))
    counted = each.groupBy("type").agg(F.count("*").alias("n"), F.sum("of").alias("of"), F.sum("by").alias("by"))
    row = lambda part, kind, n: F.struct(F.lit(part).alias("part"), kind.alias("type"), n.alias("n"))
    spread = lambda df, *rows: df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    has = facts.select("doc_id").distinct().withColumn("_met", F.lit(True))
    known = docs.select("doc_id").distinct().join(has, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(F.col("_met").isNull()).alias("alone"))
    evidence = facts.filter("node_id <> ''").select("node_id").distinct().agg(F.count("*").alias("n"))
    relations = _relations(facts).distinct().groupBy("type").agg(F.count("*").alias("n"))
    parts = [
        spread(counted, row("node", F.col("type"), F.col("n")), row("edge", F.lit("has_fact"), F.col("of")), row("edge", F.lit("supported_by"), F.col("by"))),
        spread(known, row("node", F.lit("document"), F.col("n")), row("isolated", F.lit("document"), F.col("alone"))),
        spread(evidence, row("node", F.lit("evidence"), F.col("n"))),
        relations.select(F.lit("edge").alias("part"), "type", "n"),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("part", "type").agg(F.sum("n").alias("n")).filter("n > 0")


def mermaid(nodes: DataFrame, edges: DataFrame, max_nodes: int = 80, max_edges: int = 160) -> str:
    """A drawing of the first nodes and edges by id: a report with fixed limits."""
    some = {r["id"]: (f"n{k}", (r["label"] or r["id"]).replace('"', "'")) for k, r in enumerate(nodes.orderBy("id").limit(max_nodes).collect())}
    lines = ["graph LR", *(f'  {short}["{label}"]' for short, label in some.values())]
    for r in edges.orderBy("id").limit(max_edges).collect():
        if r["source"] in some and r["target"] in some:
            lines.append(f"  {some[r['source']][0]} -->|{r['type']}| {some[r['target']][0]}")
    return "\n".join(lines)
