"""Facts of documents by rules, with term lists of their own: which nodes are
read, the claims and entities in them, and what relates them.

Nodes come in tiers: those that are evidence of something, those that cite, and
those that score by their terms. Each tier has its order, a node counts in the
first tier that has it, and a document takes the first ``NODES`` of all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import fact_terms as C
from lexforge.functions import text as T
from lexforge.operators import facts as A
from lexforge.operators import nodes as N
from lexforge.operators.containment import with_terms
from lexforge.operators.lexical import ranked


def term_score(text: Column, kind: Column, tokens: dict[str, list[str]] | None = None) -> Column:
    """Two for each token of each type, and for abstracts and sections."""
    words = [w for group in (tokens or C.CLAIM_TOKENS).values() for w in group]
    return 2 * T.count_terms(text, words) + F.when(kind.isin("abstract", "section"), 2).otherwise(0)


def fact_nodes(nodes: DataFrame, evidence: DataFrame | None = None, citing: DataFrame | None = None, tokens: dict[str, list[str]] | None = None, most: int = C.NODES) -> DataFrame:
    """(doc_id, node_id, place, tier): the nodes that facts are taken from.

    ``nodes`` (doc_id, node_id, order_index, kind, text); ``evidence`` and
    ``citing`` (doc_id, node_id, at), in the order of ``at``; nodes that are not
    there do not count.
    """
    score = term_score(T.text_of("text"), F.col("kind"), tokens)
    own = nodes.filter((T.text_of("text") != "") & (F.col("kind") != "reference")).withColumn("_s", score).filter("_s > 0")
    row = lambda tier, first, second: F.struct(F.lit(tier).alias("tier"), first.cast("long").alias("a"), second.cast("long").alias("b"))
    parts = [own.select("doc_id", "node_id", row(2, -F.col("_s"), F.col("order_index")).alias("at"))]
    known = nodes.select("doc_id", "node_id").distinct()
    for tier, named in enumerate((evidence, citing)):
        if named is not None:
            parts.append(named.join(known, ["doc_id", "node_id"], "left_semi").select("doc_id", "node_id", row(tier, F.col("at"), F.lit(0)).alias("at")))
    first = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "node_id").agg(F.min("at").alias("at"))
    return ranked(first, most, F.col("at"), F.col("node_id"), partition="doc_id", name="place").select("doc_id", "node_id", "place", F.col("at.tier").alias("tier"))


def dictionary(known: dict[str, list[str]] | None = None) -> list[tuple[str, str, int]]:
    """(term, type, priority) of a dictionary of entities."""
    return [(t, kind, n) for n, (kind, terms) in enumerate((known or C.KNOWN_ENTITIES).items()) for t in terms]


def readings(nodes: DataFrame, chosen: DataFrame, terms: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, node_id, order_index, sentences, terms, found, names): what facts
    are made of, for each node of ``chosen`` (doc_id, node_id).

    ``terms`` are those of a dictionary of any size (term) that the text holds:
    one automaton goes over the nodes where they lie. ``found`` are entities by
    patterns, without noise, ``names`` the different names of both, of all rows
    of a node.
    """
    text = T.text_of("hay")
    read = nodes.select("doc_id", "node_id", "order_index", T.text_of("text").alias("hay")).join(chosen.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_semi")
    found = F.filter(A.entity_list(text, {}, patterns or C.ENTITY_PATTERNS), lambda e: ~A.noisy_entity(e["name"], e["type"]))
    lists = with_terms(read, terms).select("doc_id", "node_id", "order_index", N.sentence_list(text).alias("sentences"), "terms", found.alias("found"))
    own = F.concat("terms", F.transform("found", lambda e: e["name"]))
    names = F.array_distinct(F.flatten(F.collect_list(own).over(Window.partitionBy("doc_id", "node_id"))))
    return lists.withColumn("names", names)


def dictionary_entities(read: DataFrame, terms: DataFrame, source: Column, confidence: float = 0.62) -> DataFrame:
    """Entities of :func:`readings` by a dictionary (term, type, priority): terms
    that are found take type and priority from it."""
    found = read.select("doc_id", "node_id", "order_index", F.explode("terms").alias("term")).join(terms.select("term", "type", "priority").distinct(), "term")
    place = F.col("order_index").cast("long") * 10_000_000 + 1000 * (F.col("priority") + 1)
    rows = found.select("doc_id", "node_id", place.alias("position"), F.col("term").alias("text"), "type", F.lit(confidence).alias("confidence"), source.alias("source"))
    return A._shaped(rows.withColumn("normalized_key", T.normalize_key(F.col("text"))), "entity")


def cited_works(refs: DataFrame, citations: DataFrame, source: Column) -> DataFrame:
    """An entity for each entry that a document cites, where it first does: its
    title, or else its text, or its number."""
    first = citations.groupBy("doc_id", "ref_id").agg(F.min_by("node_id", F.struct("order_index", "mark_no")).alias("node_id"), F.min("order_index").alias("order_index"))
    entry = refs.groupBy("doc_id", "ref_id").agg(F.min_by(F.struct("title", "raw"), F.col("number")).alias("r"))
    named = first.join(entry, ["doc_id", "ref_id"], "left")
    name = F.coalesce(*[F.nullif(T.text_of(c), F.lit("")) for c in ("r.title", "r.raw")], F.col("ref_id"))
    rows = named.select("doc_id", "node_id", (F.col("order_index").cast("long") * 10_000_000 + 9_000_000).alias("position"), T.excerpt(name, 160).alias("text"), F.lit("citation").alias("type"), F.lit(C.CITATION_CONFIDENCE).alias("confidence"), source.alias("source"), F.col("ref_id").alias("object_name"))
    return A._shaped(rows.withColumn("normalized_key", T.normalize_key(F.col("text"))), "entity")


def supports(claims: DataFrame) -> DataFrame:
    """A relation from each claim to its node."""
    rows = claims.select("doc_id", "node_id", "position", F.concat(F.lit("claim supported by "), F.col("node_id")).alias("text"), F.lit("supports").alias("type"), F.lit(C.SUPPORT_CONFIDENCE).alias("confidence"), "source", F.col("fact_id").alias("subject_name"), F.col("node_id").alias("object_name"))
    return A._shaped(rows.withColumn("normalized_key", F.concat_ws("->", "subject_name", "object_name")), "relation")


def cites(docs: DataFrame, citations: DataFrame, source: Column) -> DataFrame:
    """A relation from each document (doc_id, title) to each entry that a node of
    it cites."""
    once = citations.groupBy("doc_id", "node_id", "ref_id").agg(F.min("order_index").alias("order_index"), F.min("mark_no").alias("mark_no"))
    titled = once.join(docs.select("doc_id", "title"), "doc_id", "left").withColumn("subject_name", F.coalesce(F.nullif(T.text_of("title"), F.lit("")), F.col("doc_id").cast("string")))
    rows = titled.select("doc_id", "node_id", (F.col("order_index").cast("long") * 10_000_000 + F.col("mark_no")).alias("position"), F.concat_ws(" cites ", "subject_name", "ref_id").alias("text"), F.lit("cites").alias("type"), F.lit(C.CITES_CONFIDENCE).alias("confidence"), source.alias("source"), "subject_name", F.col("ref_id").alias("object_name"))
    return A._shaped(rows.withColumn("normalized_key", F.concat_ws("->", T.normalize_key(F.col("subject_name")), "object_name")), "relation")


def extracted(docs: DataFrame, nodes: DataFrame, refs: DataFrame, citations: DataFrame, terms: DataFrame, evidence: DataFrame | None = None, tokens: dict[str, list[str]] | None = None, patterns: dict[str, str] | None = None, most: int = C.NODES, kept: Callable[[str, DataFrame], DataFrame] = lambda _, rows: rows) -> DataFrame:
    """All facts of documents by rules, in the shape of :mod:`facts`.

    ``docs`` (doc_id, title); ``nodes`` (doc_id, node_id, order_index, kind,
    text); ``refs`` and ``citations`` are those of :mod:`citations`; ``terms``
    (term, type, priority) is the dictionary of entities. ``kept`` may write
    what texts are read into, which several kinds of facts are made from, and
    read it again, so that texts are searched once.
    """
    source = F.lit("rule")
    said = citations.join(nodes.select("doc_id", "node_id", "order_index"), ["doc_id", "node_id"])
    order = said.groupBy("doc_id", "node_id").agg(F.min("order_index").alias("at"))
    known = terms.filter(~A.noisy_entity(F.col("term"), F.col("type")))
    read = kept("read", readings(nodes, fact_nodes(nodes, evidence, order, tokens, most), known, patterns))
    sentences = read.select("doc_id", "node_id", "order_index", "names", F.posexplode("sentences").alias("position", "sentence")).withColumn("position", F.col("order_index").cast("long") * 10 + F.col("position"))
    claims = A.claims(sentences, tokens or C.CLAIM_TOKENS, F.lit(C.CLAIM_CONFIDENCE), source, ("names",))
    entities = dictionary_entities(read, known, source).unionByName(A.listed_entities(read, F.col("found"), source))
    parts = [claims.drop("names"), entities, cited_works(refs, said, source), supports(claims), A.mentions_within(claims), cites(docs, said, source)]
    return reduce(DataFrame.unionByName, parts)
