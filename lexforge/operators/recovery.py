"""Tables recovered from captions and what follows them.

A caption takes the bodies among the next ``AHEAD`` blocks: tables without a
caption and paragraphs of two or more rows. Blocks before the first body are
passed over; after it the first block that is no body ends the table, and a
heading, figure or reference ends it anywhere. What lies ahead of a block is a
window of a fixed number of rows, so nothing grows with the document.

Three sources give tables, and the first that has one of an id is taken:
structured cells from a parser, blocks with their line breaks, and blocks of the
page layout, whose text is one line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.tables import METHOD, METRIC

AHEAD = 7

# What ends a table, what a caption and a number look like, confidences and names of sources.
ENDS = ["heading", "figure", "reference"]
CAPTION = r"(?i)^(表\s*\d+|table\s+\d+)"
NUMBER = r"\p{Nd}"
RULER = ":：|- "
SURE, WEAK = 0.68, 0.58
SOURCES = ["docling_table", "table_rule"]

_NONE = "array<array<string>>"


def is_caption(c: Column) -> Column:
    return F.regexp_like(T.compact(c), F.lit(CAPTION))


def _like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def row_of(line: Column, clean=T.compact) -> Column:
    """Cells of a line, each made ``clean``: parted by bars, else by spaces. Two
    cells are a row only if one of them is a metric or a number."""
    parted = lambda by: F.filter(F.transform(F.split(line, by), lambda x: clean(x)), lambda x: x != "")
    cells = F.when(F.contains(line, F.lit("|")), parted(r"\|")).otherwise(parted(" "))

    def usable(v):
        return (F.size(v) >= 3) | ((F.size(v) == 2) & F.exists(v, lambda x: _like(x, NUMBER) | _like(x, METRIC)))

    return T.let(cells, lambda v: F.when(usable(v), v).otherwise(F.array().cast("array<string>")))


def flat_rows(text: Column) -> Column:
    """Rows of a text without line breaks: at least six words, two of them
    numbers; a row is as long as the way to the first number, two to six cells."""
    words = F.filter(F.split(T.compact(text), " "), lambda w: w != "")

    def cut(v):
        numbers = F.filter(F.transform(v, lambda w, i: F.when(_like(w, NUMBER), i)), lambda i: i.isNotNull())

        def rows(at):
            n = F.greatest(F.lit(2), F.least(F.lit(6), F.get(at, F.lit(0)) + 1))
            starts = F.sequence(F.lit(0), F.ceil(F.size(v) / n).cast("int") - 1)
            return F.filter(F.transform(starts, lambda k: F.slice(v, k * n + 1, n)), lambda r: F.size(r) >= 2)

        return T.let(numbers, lambda at: F.when(F.size(at) >= 2, rows(at)).otherwise(F.array().cast(_NONE)))

    return T.let(words, lambda v: F.when(F.size(v) >= 6, cut(v)).otherwise(F.array().cast(_NONE)))


def _parsed(text: Column) -> Column:
    """(lines, alone): the rows of a text's lines, and what they are if the text is
    the only one of its table; null if that is the same."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.split(F.regexp_replace(unix, r"(?U)[\s&&[^\n]]+", " "), "\n")
    bare = F.transform(lines, lambda x: F.trim(F.btrim(F.trim(x), F.lit("|"))))
    rows = F.filter(F.transform(F.filter(bare, lambda x: F.btrim(x, F.lit(RULER)) != ""), lambda x: row_of(x, F.trim)), lambda r: F.size(r) > 0)
    flat = ~F.contains(text, F.lit("\n"))
    return T.let(rows, lambda r: F.struct(r.alias("lines"), F.when((F.size(r) < 2) & flat, flat_rows(text)).alias("alone")))


def _alone(parsed: Column) -> Column:
    return F.coalesce(parsed["alone"], parsed["lines"])


def rows_of(text: Column) -> Column:
    """The rows of a text: its lines, or parts of its only line."""
    return T.let(_parsed(text), _alone)


def _named(blocks: DataFrame, n: Column) -> Column:
    name = F.concat(F.lit("table_"), F.lpad(n.cast("string"), F.greatest(F.lit(3), F.length(n.cast("string"))), "0"))
    return F.coalesce(F.nullif(T.text_of("caption_id"), F.lit("")), name) if "caption_id" in blocks.columns else name


def captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, position, table_id, caption, text): every caption; a table's id
    counts all blocks of kind table in its document."""
    order = Window.partitionBy("doc_id").orderBy("position")
    tables = blocks.filter(F.col("kind") == "table").withColumn("n", F.row_number().over(order))
    return tables.filter(is_caption(T.text_of("text"))).select("doc_id", "position", _named(blocks, F.col("n")).alias("table_id"), T.compact(T.text_of("text")).alias("caption"))


def taken(ahead: Column) -> Column:
    """The bodies among the blocks ahead (off, ends, body, position, text)."""
    first = lambda keep: F.array_min(F.transform(F.filter(ahead, keep), lambda x: x["off"]))
    far = F.lit(AHEAD + 1)
    end = F.coalesce(first(lambda x: x["ends"]), far)
    start = F.coalesce(first(lambda x: x["body"]), far)
    gap = F.coalesce(first(lambda x: ~x["body"] & (x["off"] > start)), far)
    return F.filter(ahead, lambda x: x["body"] & (x["off"] < F.least(end, gap)))


def captioned(blocks: DataFrame, ways: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(doc_id, table_id, caption, position, content_positions, grid, _p) of every
    caption, by the first of ``ways`` that gives rows: 1 sees texts with their line
    breaks, 2 without them, as the layout of a page has them. A caption without
    rows has an empty grid.

    Blocks are dealt and sorted once, by their documents; a block is parsed once for
    a way, and a text without line breaks once for both.
    """
    order = Window.partitionBy("doc_id").orderBy("position")
    text, table = F.col("text"), F.coalesce(F.col("kind") == "table", F.lit(False))
    kept = ["doc_id", "position", "kind", *[c for c in ("caption_id",) if c in blocks.columns]]
    rows = blocks.select(*kept, T.text_of("text").alias("text"))
    # numbers come before parsing, so that what is sorted is still small
    rows = rows.withColumn("_n", F.sum(table.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_caption", table & is_caption(text))
    broken = F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\r"))
    part = F.when((table | (F.col("kind") == "paragraph")) & ~F.col("_caption"), True)
    makes = {1: F.when(part, _parsed(text)), 2: F.when(part & broken, _parsed(T.compact(text)))}
    rows = rows.withColumns({f"_r{w}": makes[w] for w in {1, *ways}})
    if 2 in ways:
        rows = rows.withColumn("_r2", F.coalesce("_r2", "_r1"))
    body = lambda w: F.coalesce(part & (table | (F.size(_alone(F.col(f"_r{w}"))) >= 2)), F.lit(False))
    seen = F.struct("position", F.col("kind").isin(ENDS).alias("ends"), *[x for w in ways for x in (body(w).alias(f"body{w}"), F.col(f"_r{w}"))])
    rows = rows.withColumn("_seen", seen)
    rows = rows.select(*kept, "text", "_n", "_caption", F.array(*[F.lead("_seen", n).over(order) for n in range(1, AHEAD + 1)]).alias("_ahead")).filter("_caption")

    def by(w: int) -> Column:
        ahead = F.transform(F.filter("_ahead", lambda x: x.isNotNull()), lambda x, i: F.struct((i + 1).alias("off"), x["ends"].alias("ends"), x[f"body{w}"].alias("body"), x["position"].alias("position"), x[f"_r{w}"].alias("rows")))
        grid = lambda b: F.when(F.size(b) == 1, _alone(F.get(b, F.lit(0))["rows"])).otherwise(F.flatten(F.transform(b, lambda x: x["rows"]["lines"])))
        return T.let(T.let(ahead, taken), lambda b: F.struct(F.transform(b, lambda x: x["position"]).alias("content_positions"), grid(b).alias("grid"), F.lit(w).alias("_p")))

    def first(some: tuple[int, ...]) -> Column:
        return by(some[0]) if len(some) == 1 else T.let(by(some[0]), lambda t: F.when(F.size(t["grid"]) > 0, t).otherwise(first(some[1:])))

    # outer: else a filter by the grid makes it again
    out = rows.select("doc_id", _named(blocks, F.col("_n")).alias("table_id"), T.compact(text).alias("caption"), "position", F.explode_outer(F.array(first(ways))).alias("_t"))
    return out.select("doc_id", "table_id", "caption", "position", "_t.*")


def from_blocks(blocks: DataFrame, one_line: bool = False) -> DataFrame:
    """(doc_id, table_id, caption, position, content_positions, grid) of every
    caption whose bodies give rows. ``one_line`` sees texts without line breaks,
    as the layout of a page has them."""
    return captioned(blocks, (2 if one_line else 1,)).filter(F.size("grid") > 0).drop("_p")


def from_cells(cells: DataFrame) -> DataFrame:
    """The same of structured cells (doc_id, table_id, caption, row_index,
    column_index, text): cells are pivoted into rows, empty ones go."""
    kept = cells.withColumn("text", T.compact(T.text_of("text"))).filter("text <> ''")
    row = kept.groupBy("doc_id", "table_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "text"))), lambda x: x["text"]).alias("cells"), F.max("caption").alias("caption"))
    grid = row.groupBy("doc_id", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda x: x["cells"]).alias("grid"), F.max("caption").alias("caption"))
    return grid.select("doc_id", "table_id", T.compact(T.text_of("caption")).alias("caption"), F.lit(None).cast("int").alias("position"), F.array().cast("array<int>").alias("content_positions"), "grid")


def _head() -> Column:
    return (F.size("grid") >= 2) & ~F.exists(F.get("grid", F.lit(0)), lambda c: _like(c, NUMBER))


def _wide() -> Column:
    return F.array_max(F.transform("grid", F.size))


def recovered(blocks: DataFrame, cells: DataFrame | None = None, layout: DataFrame | None = None) -> DataFrame:
    """Tables of documents, one row each: (doc_id, table_id, caption, position,
    content_positions, headers, rows, row_count, column_count, cell_count,
    source, confidence, warnings).

    ``blocks`` (doc_id, position, kind, text[, caption_id]); ``layout`` has the
    same columns and by default is ``blocks``. The first row is the header if
    none of its cells holds a number and more rows follow.
    """
    columns = ["caption", "position", "content_positions", "grid", "_p"]
    if layout is None:
        parts = [captioned(blocks).filter(F.size("grid") > 0)]
    else:
        parts = [from_blocks(blocks).withColumn("_p", F.lit(1)), from_blocks(layout, one_line=True).withColumn("_p", F.lit(2))]
    if cells is not None:
        parts.insert(0, from_cells(cells).withColumn("_p", F.lit(0)))
    first = reduce(DataFrame.unionByName, [p.withColumns({"position": F.col("position").cast("long"), "content_positions": F.col("content_positions").cast("array<long>")}) for p in parts])
    if len(parts) > 1 or "caption_id" in blocks.columns:  # numbers of blocks are unique, other ids may come twice
        first = first.groupBy("doc_id", "table_id").agg(F.min_by(F.struct(*columns), "_p").alias("t")).select("doc_id", "table_id", "t.*")
    none = F.array().cast("array<string>")
    head, wide = _head(), _wide()
    weak = (F.col("_p") > 0) & ((F.size("grid") < 2) | (wide < 2))
    made = first.withColumns({"headers": F.when(head, F.get("grid", F.lit(0))).otherwise(none), "rows": F.when(head, F.slice("grid", 2, F.greatest(F.size("grid") - 1, F.lit(0)))).otherwise(F.col("grid"))})
    return made.select(
        "doc_id", "table_id", "caption", "position", "content_positions", "headers", "rows",
        F.size("rows").alias("row_count"), wide.alias("column_count"), F.aggregate("grid", F.lit(0), lambda n, r: n + F.size(r)).alias("cell_count"),
        F.when(F.col("_p") == 0, SOURCES[0]).otherwise(SOURCES[1]).alias("source"),
        F.when(F.col("_p") == 0, F.lit(0.95)).when(weak, F.lit(WEAK)).otherwise(F.lit(SURE)).alias("confidence"),
        F.when(weak, F.array(F.lit("weak_table_structure"))).otherwise(none).alias("warnings"),
    )


def grid_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, row_index, column_index, header, text), a row a cell."""
    row = tables.select("doc_id", "table_id", "headers", F.posexplode("rows").alias("row_index", "cells"))
    return row.select("doc_id", "table_id", "row_index", "headers", F.posexplode("cells").alias("column_index", "text")).withColumn("header", F.get("headers", F.col("column_index"))).drop("headers")


def items(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Every caption with the size of its table, if it was recovered."""
    sized = tables.select("doc_id", "table_id", "row_count", "column_count", "cell_count", "warnings")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    warned = F.coalesce("warnings", F.array(F.lit("table_content_not_extracted"))).alias("warnings")
    return captions(blocks).join(sized, ["doc_id", "table_id"], "left").select("doc_id", "table_id", "caption", n("row_count"), n("column_count"), n("cell_count"), warned)


def summaries(tables: DataFrame) -> DataFrame:
    """What the cells of a table are: metrics (of headers too), methods, results."""
    flat = F.flatten("rows")
    few = lambda c, p, n: F.slice(F.array_distinct(F.filter(c, lambda x: _like(x, p))), 1, n)
    return tables.select(
        "doc_id", "table_id", "caption", "headers", "row_count", "column_count", "cell_count", "source", "warnings",
        few(F.concat("headers", flat), METRIC, 12).alias("metrics"), few(flat, METHOD, 12).alias("methods"), few(flat, NUMBER, 16).alias("results"),
    )


def parse_score(items_: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, captions, complete, score): the share of captions whose table has
    rows and columns, with a bonus for structured ones."""
    whole = tables.groupBy("doc_id").agg(F.count_if((F.col("row_count") > 0) & (F.col("column_count") > 1)).alias("complete"), F.max((F.col("source") == SOURCES[0]).cast("int")).alias("structured"))
    per = items_.groupBy("doc_id").agg(F.count("*").alias("captions")).join(whole, "doc_id", "full")
    return _scored(per)


def _scored(per: DataFrame) -> DataFrame:
    share = F.least(F.lit(1.0), F.coalesce("complete", F.lit(0)) / F.col("captions"))
    score = F.when(F.col("captions").isNull(), 0.85).when(F.col("complete").isNull(), 0.0).otherwise(F.least(F.lit(1.0), share + 0.1 * F.col("structured")))
    return per.select("doc_id", F.coalesce("captions", F.lit(0)).alias("captions"), F.coalesce("complete", F.lit(0)).alias("complete"), F.round(score, 2).alias("score"))


def block_scores(blocks: DataFrame) -> DataFrame:
    """:func:`parse_score` of documents with captions, whose tables come of their
    blocks alone: captions and tables are counted in one pass."""
    if "caption_id" in blocks.columns:
        tables = recovered(blocks)
        return parse_score(items(blocks, tables), tables)
    whole = (F.size("grid") - _head().cast("int") > 0) & (_wide() > 1)
    counts = captioned(blocks).groupBy("doc_id").agg(F.count("*").alias("captions"), F.count_if(whole).alias("complete"))
    return _scored(counts.withColumn("structured", F.lit(0)))
