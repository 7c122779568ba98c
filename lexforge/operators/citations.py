"""The citation map of documents: their reference lists, and the marks in their
text that name an entry, with the words around them.

Lines of a list are of three kinds. One with a number starts an entry, one that
goes on belongs to the entry before it, and what is neither is noise. Entries
are the islands between starts: a running count of starts numbers them, and
lines of a number are one entry. Before the first start, the first line with a
year opens an entry of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T

# What lines of a list and marks look like, and how far a mark's context and a range go.
EMBEDDED = r"(?U)\s+(?=\[\d{1,3}\]\s*)"
NUMBERED = r"^(?:\[(\d{1,3})\]|(\d{1,3})[.)、])\s*.+"
ENTRY = r"^\[?(\d+)\]?[.)、]?\s*(.+)$"
LEADERS = r"\.{4,}|…{2,}"
NOT_ENTRIES = ["摘要", "关键词", "Abstract", "Keywords"]
YEAR = r"(?:19|20)\d{2}"
MARK = r"\[(\d+(?:\s*(?:[-,，、]\s*)\d+)*)\]"
INTERVALS = ["0,1", "0，1"]
LIST_PATHS = ["参考文献", "References"]
AROUND, WIDEST = 80, 50


def reference_number(line: Column) -> Column:
    """The number that starts an entry, above zero, or null."""
    flat = T.compact(line)
    digits = F.concat(F.regexp_extract(flat, NUMBERED, 1), F.regexp_extract(flat, NUMBERED, 2))
    n = F.nullif(digits, F.lit("")).cast("int")
    return F.when(n > 0, n)


def list_lines(nodes: DataFrame) -> DataFrame:
    """(doc_id, order_index, part, line): lines of the reference lists among
    ``nodes`` (doc_id, order_index, kind, node_path, text), cut at numbers
    within them."""
    listed = nodes.filter((F.col("kind") == "reference") & T.any_term(T.text_of("node_path"), LIST_PATHS))
    parts = F.filter(F.transform(F.split(T.compact(T.text_of("text")), EMBEDDED), T.strip), lambda x: x != "")
    return listed.select("doc_id", "order_index", F.posexplode(parts).alias("part", "line"))


def entries(lines: DataFrame) -> DataFrame:
    """(doc_id, number, ref_id, raw, authors, title, year) of lists of lines
    (doc_id, order_index, part, line); ``number`` counts a list's entries."""
    clean = lines.withColumn("line", T.compact(T.text_of("line"))).filter((F.col("line") != "") & ~F.regexp_like("line", F.lit(LEADERS)))
    long = F.length("line") >= 8
    start = reference_number(F.col("line")).isNotNull()
    order = Window.partitionBy("doc_id").orderBy("order_index", "part")
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = clean.withColumns({"_start": start, "_dated": long & F.regexp_like("line", F.lit(YEAR)), "_goes_on": long & ~F.col("line").isin(NOT_ENTRIES)})
    # dated lines open an entry only while no numbered one has come
    counted = marked.withColumn("_n", F.sum(F.col("_start").cast("int")).over(before)).withColumn("_d", F.sum((F.col("_dated") & (F.col("_n") == 0)).cast("int")).over(before))
    inside = counted.filter((F.col("_n") > 0) | (F.col("_d") > 0)).filter(F.col("_start") | F.col("_goes_on"))
    joined = inside.groupBy("doc_id", "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_index", "part", "line"))), lambda x: x["line"]), " ").alias("raw"))
    numbered = joined.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("_n")))
    return numbered.select("doc_id", "number", *_fields(T.compact(F.col("raw")), F.col("number")))


def _fields(raw: Column, index: Column) -> list[Column]:
    digits = F.regexp_extract(raw, ENTRY, 1)
    body = F.when(digits != "", F.regexp_extract(raw, ENTRY, 2)).otherwise(raw)
    parts = F.filter(F.transform(F.split(body, "[.。]", 3), lambda x: F.trim(x)), lambda x: x != "")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    year = F.nullif(F.regexp_extract(body, YEAR, 0), F.lit("")).cast("int")
    number = F.when(digits != "", F.regexp_replace(digits, "^0+(?=.)", "")).otherwise(index.cast("string"))
    return [F.concat(F.lit("ref_"), number).alias("ref_id"), raw.alias("raw"), part(0).alias("authors"), part(1).alias("title"), year.alias("year")]


def expanded(mark: Column) -> Column:
    """The numbers of a mark such as ``1, 3-5``; ranges above ``WIDEST`` go."""

    def numbers(part):
        one = T.let(F.trim(part).try_cast("int"), lambda n: F.when(n > 0, F.array(n)).otherwise(none))
        return F.when(F.contains(part, F.lit("-")), T.let(F.split(part, r"\s*-\s*", 2), between)).otherwise(one)

    def between(ends):
        low, high = F.get(ends, F.lit(0)).try_cast("int"), F.get(ends, F.lit(1)).try_cast("int")
        spread = F.when((low > 0) & (low <= high) & (high <= low + WIDEST), F.sequence(low, F.greatest(low, F.least(high, low + WIDEST))))
        return F.coalesce(spread, none)

    none = F.array().cast("array<int>")
    alone = ~T.any_term(mark, ["-", ",", "，", "、"])
    return F.when(alone, numbers(mark)).otherwise(F.flatten(F.transform(F.split(mark, "[,，、]"), numbers)))


def marks(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, mark_no, ref_id, context): every number of every mark in
    the text of nodes that are no references, with up to ``AROUND`` characters
    on either side of the mark.

    The text between marks and the marks themselves give each mark's place.
    """
    rows = nodes.filter(F.col("kind") != "reference").select("doc_id", "node_id", T.text_of("text").alias("text")).filter(F.regexp_like("text", F.lit(MARK)))
    found = rows.withColumns({"_m": F.regexp_extract_all("text", F.lit(MARK), F.lit(0)), "_b": F.split("text", MARK, -1)})
    each = found.select("doc_id", "node_id", "text", "_b", "_m", F.posexplode("_m").alias("_k", "mark"))
    lengths = lambda a, k: F.aggregate(F.slice(a, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
    start = lengths("_b", F.col("_k") + 1) + lengths("_m", F.col("_k"))
    placed = each.withColumn("_s", start).withColumn("_e", F.col("_s") + F.length("mark"))
    low = F.greatest(F.lit(0), F.col("_s") - AROUND)
    context = T.compact(F.substring("text", low + 1, F.col("_e") + AROUND - low))
    inner = F.substring("mark", 2, F.length("mark") - 2)  # a mark without its brackets
    said = placed.filter(~F.replace(inner, F.lit(" "), F.lit("")).isin(INTERVALS))
    return said.select("doc_id", "node_id", (F.col("_k") + 1).alias("mark_no"), F.explode(expanded(inner)).alias("n"), context.alias("context")).select("doc_id", "node_id", "mark_no", F.concat(F.lit("ref_"), F.col("n")).alias("ref_id"), "context")


def citation_map(nodes: DataFrame, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(references, citations) of documents: citations say whether their entry is
    in the list (``matched_reference``). Documents without a list among their
    nodes take ``lines`` (doc_id, order_index, line), if they are given."""
    own = list_lines(nodes)
    if lines is not None:
        rest = lines.join(own.select("doc_id").distinct(), "doc_id", "left_anti")
        parts = F.filter(F.transform(F.split(T.compact(T.text_of("line")), EMBEDDED), T.strip), lambda x: x != "")
        own = own.unionByName(rest.select("doc_id", "order_index", F.posexplode(parts).alias("part", "line")))
    refs = entries(own)
    known = refs.select("doc_id", "ref_id").distinct().withColumn("_in", F.lit(True))
    said = marks(nodes).join(known, ["doc_id", "ref_id"], "left")
    return refs, said.select("doc_id", "node_id", "mark_no", "ref_id", "context", F.coalesce("_in", F.lit(False)).alias("matched_reference"))


def status(docs: DataFrame, refs: DataFrame, citations: DataFrame) -> DataFrame:
    """(doc_id, references, citations, matched, status, warnings) of each document."""
    r = refs.groupBy("doc_id").agg(F.count("*").alias("references"))
    c = citations.groupBy("doc_id").agg(F.count("*").alias("citations"), F.count_if("matched_reference").alias("matched"))
    both = docs.select("doc_id").distinct().join(r, "doc_id", "left").join(c, "doc_id", "left").fillna(0, ["references", "citations", "matched"])
    some = F.col("references") > 0
    return both.withColumns({"status": F.when(some | (F.col("citations") > 0), "extracted").otherwise("partial"), "warnings": F.when(some, "").otherwise("missing_reference_list")})
