"""Blocks of papers from lines: headings, abstracts, captions, tables, references.

What a line becomes depends on what came before it in two ways only: whether a
list of references is open, and under which heading or caption it stands. Each
line either sets one of these or leaves it alone, so the state before a line is
the last value set, and two stretches of lines compose by "the later one that
sets it". Values are carried within chunks of ``CHUNK`` lines, then over the
chunks of ``CHUNK`` blocks, then over those, so one long document is no single
task, and where chunks are cut makes no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.recovery import CAPTION, row_of

CHUNK = 4096

# Kinds that stay whole, and what headings, captions and entries look like.
WHOLE = ["abstract", "keywords", "figure", "table", "reference", "formula"]
CARRIED = ["abstract", "keywords", "reference"]
CHAPTER = r"^第[一二三四五六七八九十百千万0-9]+章\s*[\p{L}\p{N}_（）()《》:：、，,\- ]{0,80}$"
NUMBERED = r"^(\d+(?:\.\d+){0,3})[\s、.．]+(.{1,80})$"
ORDERED = r"^[一二三四五六七八九十]+[、.．]\s*.{1,80}$"
ENTRY = r"^(\[\d+\]|\d+[.)、]\s+).+"
ABSTRACT = r"(?i)^(摘\s*要|Abstract)\s*[:：]?\s*(.*)$"
BARE_ABSTRACTS = ["摘要", "摘 要", "Abstract"]
KEYWORDS = r"(?i)^(关键词|关键字|Keywords?)\s*[:：]?\s*(.*)$"
REFERENCES = r"(?i)^(参考文献|References|Bibliography)\s*[:：]?$"
CONCLUSION = r"(?i)^(结论|总结|讨论|致谢|Conclusion|Discussion)\s*[:：]?$"
FIGURE = r"(?i)^(图\s*\d+|Figure\s+\d+)"
SENTENCE_END = r"[。！？!?；;]$"
ABSTRACT_HEADING, KEYWORD_HEADING, REFERENCE_HEADING = "摘要", "关键词", "参考文献"
CONTEXTS = {"abstract": ["摘要", "abstract"], "keywords": ["关键词", "关键字", "keywords", "keyword"], "reference": ["参考文献", "references", "bibliography"]}


def _like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def context_of(heading: Column) -> Column:
    flat = F.lower(F.regexp_replace(heading, r"(?U)\s+", ""))
    out = F.lit("")
    for kind, names in CONTEXTS.items():
        out = F.when(flat.isin(names), kind).otherwise(out)
    return out


def heading_of(line: Column) -> Column:
    """(heading, level, body_kind, body) if a compacted line is a heading, else
    null: an abstract or keywords with or without their text, a list of
    references, a chapter, a conclusion, or a numbered title."""

    def made(heading, level, kind="", body=F.lit("")):
        return F.struct(heading.alias("heading"), level.cast("int").alias("level"), F.lit(kind).alias("body_kind"), body.alias("body"))

    said, short = F.regexp_extract(line, ABSTRACT, 2), F.length(line) <= 96
    title = lambda t: (F.length(t) <= 72) & (t != "") & ~_like(t, SENTENCE_END)
    number, rest = F.regexp_extract(line, NUMBERED, 1), T.compact(F.regexp_extract(line, NUMBERED, 2))
    one = F.lit(1)
    return (
        F.when(_like(line, ABSTRACT) & ((said != "") | F.regexp_extract(line, ABSTRACT, 1).isin(BARE_ABSTRACTS)), made(F.lit(ABSTRACT_HEADING), one, "abstract", T.compact(said)))
        .when(_like(line, KEYWORDS), made(F.lit(KEYWORD_HEADING), one, "keywords", T.compact(F.regexp_extract(line, KEYWORDS, 2))))
        .when(_like(line, REFERENCES), made(F.lit(REFERENCE_HEADING), one))
        .when(short & (_like(line, CHAPTER) | _like(line, CONCLUSION)), made(line, one))
        .when(short & (number != "") & title(rest), made(line, F.least(F.size(F.split(number, r"\.")), F.lit(4))))
        .when(short & _like(line, ORDERED) & title(line), made(line, F.lit(2)))
    )


def carried(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``name_before`` for each of ``names``: its last value that is not
    null in the rows of the document before, by (position, k)."""
    rows = rows.withColumns({"_c1": F.floor(F.col("k") / CHUNK), "_c2": F.floor(F.col("position") / CHUNK)})
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n, w: F.last(n, ignorenulls=True).over(w)
    latest = lambda n, *order: F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))).alias(n)
    chunks = rows.groupBy("doc_id", "position", "_c1", "_c2").agg(*[latest(n, "k") for n in names])
    groups = chunks.groupBy("doc_id", "_c2").agg(*[latest(n, "position", "_c1") for n in names])
    w2, w3 = before(["doc_id", "_c2"], ["position", "_c1"]), before(["doc_id"], ["_c2"])
    chunks = chunks.select("doc_id", "position", "_c1", *[last(n, w2).alias(f"{n}_2") for n in names])
    groups = groups.select("doc_id", "_c2", *[last(n, w3).alias(f"{n}_3") for n in names])
    w1 = before(["doc_id", "position", "_c1"], ["k"])
    own = rows.withColumns({f"{n}_1": last(n, w1) for n in names}).join(chunks, ["doc_id", "position", "_c1"]).join(groups, ["doc_id", "_c2"])
    out = own.withColumns({f"{n}_before": F.coalesce(*[F.col(f"{n}_{k}") for k in (1, 2, 3)]) for n in names})
    return out.drop("_c1", "_c2", *[f"{n}_{k}" for n in names for k in (1, 2, 3)])


def units(blocks: DataFrame) -> DataFrame:
    """What a state machine would read: headings, whole blocks, and the lines of
    the rest, with what each of them sets."""
    text, heading = T.text_of("text"), T.compact(F.coalesce(F.nullif(T.text_of("heading"), F.lit("")), T.text_of("text")))
    lines = F.filter(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), T.compact), lambda x: x != "")
    shape = F.when(F.col("kind") == "heading", "heading").when(F.col("kind").isin(WHOLE), "block").otherwise("line")
    rows = blocks.select("doc_id", "position", "kind", F.coalesce("level", F.lit(0)).alias("level"), shape.alias("shape"), F.posexplode(F.when(shape == "heading", F.array(heading)).when(shape == "block", F.array(text)).otherwise(lines)).alias("k", "line"))
    rows = rows.filter((F.col("shape") == "block") | (F.col("line") != ""))
    head = rows.withColumn("head", F.when(F.col("shape") != "block", heading_of(F.col("line"))))
    title = F.when(F.col("shape") == "heading", F.col("line")).when(F.col("shape") == "line", F.col("head.heading"))
    caption = (F.col("shape") == "line") & F.col("head").isNull() & ~_like(F.col("line"), FIGURE) & _like(F.col("line"), CAPTION)
    sets_list = F.when(title.isNotNull(), _like(title, REFERENCES)).when((F.col("shape") == "block") & (F.col("kind") == "reference"), True)
    sets_context = F.when(title.isNotNull(), context_of(title)).when((F.col("shape") == "block") & F.col("kind").isin(CARRIED), F.col("kind")).when(caption, "table")
    return head.withColumns({"title": title, "caption": caption, "in_list": sets_list, "context": sets_context})


def normalized(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, position, kind, level, heading, text) cut into paper
    structure: (doc_id, position, part, kind, level, heading, text), ordered by
    position and part; a block may become several. Runs of plain lines are one
    paragraph, runs of rows below a caption one table.
    """
    seen = carried(units(blocks), ["in_list", "context"])
    listed, context = F.coalesce("in_list_before", F.lit(False)), F.coalesce("context_before", F.lit(""))
    row = (F.length("line") <= 180) & (F.size(row_of(F.col("line"))) >= 2)
    line_kind = (
        F.when(F.col("title").isNotNull(), "heading")
        .when(_like(F.col("line"), FIGURE), "figure")
        .when(F.col("caption"), "table")
        .when(listed | _like(F.col("line"), ENTRY), "reference")
        .when((context == "table") & row, "rows")
        .otherwise("text")
    )
    made = seen.withColumns({"what": F.when(F.col("shape") == "line", line_kind).otherwise(F.col("shape")), "under": F.when(context.isin("abstract", "keywords"), context).otherwise("paragraph")})
    made = made.select("doc_id", "position", "k", "kind", "level", "shape", "line", "head", "what", "under")
    run = F.col("what").isin("rows", "text")
    previous = made.select("doc_id", "position", (F.col("k") + 1).alias("k"), F.col("what").alias("was"))
    starts = made.join(previous, ["doc_id", "position", "k"], "left").withColumn("start", F.when(~run | F.col("was").isNull() | (F.col("was") != F.col("what")), F.col("k")))
    placed = carried(starts, ["start"]).withColumn("run", F.coalesce("start", "start_before"))
    runs = placed.filter(run).groupBy("doc_id", "position", "run", "what").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("l"), F.min("under").alias("under"))
    runs = runs.select("doc_id", "position", F.struct("run", F.lit(0).alias("sub")).alias("at"), F.when(F.col("what") == "rows", "table").otherwise(F.col("under")).alias("kind"), F.lit(0).alias("level"), F.lit("").alias("heading"), F.when(F.col("what") == "rows", F.array_join("l", "\n")).otherwise(F.array_join("l", " ")).alias("text"))
    block = lambda sub, kind, level, heading, text: F.struct(F.struct(F.col("k").alias("run"), F.lit(sub).alias("sub")).alias("at"), kind.alias("kind"), level.cast("int").alias("level"), heading.alias("heading"), text.alias("text"))
    none, empty = F.lit(0), F.lit("")
    heading = F.when(F.col("shape") == "heading", F.col("line")).otherwise(F.col("head.heading"))
    level = F.when(F.col("shape") == "heading", F.when(F.col("level") > 0, F.col("level")).otherwise(F.coalesce("head.level", F.lit(1)))).otherwise(F.col("head.level"))
    body = F.when((F.col("shape") == "line") & (F.coalesce("head.body", empty) != ""), F.array(block(1, F.col("head.body_kind"), none, empty, F.col("head.body")))).otherwise(F.array().cast(_BLOCK))
    kind = F.when(F.col("what") == "block", F.col("kind")).otherwise(F.col("what"))
    single = F.when(F.col("what") == "heading", F.concat(F.array(block(0, F.lit("heading"), level, heading, empty)), body)).otherwise(F.array(block(0, kind, F.when(F.col("what") == "block", F.col("level")).otherwise(none), empty, F.col("line"))))
    singles = placed.filter(~run).select("doc_id", "position", F.explode(single).alias("b")).select("doc_id", "position", "b.at", "b.kind", "b.level", "b.heading", "b.text")
    both = singles.unionByName(runs)
    return both.withColumn("part", F.row_number().over(Window.partitionBy("doc_id", "position").orderBy("at"))).select("doc_id", "position", "part", "kind", "level", "heading", "text")


_BLOCK = "array<struct<at: struct<run: int, sub: int>, kind: string, level: int, heading: string, text: string>>"


def markdown(blocks: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) of normalized blocks; a title (doc_id, title) comes
    first unless a heading of the first level says it."""
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.greatest("level", F.lit(1)), F.lit(6))), F.lit(" "), F.col("heading"))
    part = F.when(F.col("kind") == "heading", T.strip(heading)).otherwise(T.strip(F.col("text")))
    same = F.lit(False)
    rows = blocks.withColumn("_t", part)
    if titles is not None:
        rows = rows.join(titles.select("doc_id", "title"), "doc_id", "left")
        same = (F.col("kind") == "heading") & (F.least(F.greatest("level", F.lit(1)), F.lit(6)) == 1) & (F.col("heading") == F.col("title"))
    else:
        rows = rows.withColumn("title", F.lit(""))
    kept = rows.filter("_t <> ''").withColumn("_same", F.coalesce(same, F.lit(False)))
    joined = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "part", "_t"))), lambda x: x["_t"]), "\n\n").alias("m"), F.max("_same").alias("has"), F.first("title").alias("title"))
    first = F.when(~F.col("has") & (T.text_of("title") != ""), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))).otherwise("")
    return joined.select("doc_id", F.concat(first, "m", F.lit("\n")).alias("markdown"))
