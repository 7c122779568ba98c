"""Tables in text: rows, cells, and the facts they state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T

# What kind a header or cell looks like.
METRIC = r"(?i)(率|时间|开销|准确|精度|召回|F1|AUC|BLEU|ROUGE|指标|性能|鲁棒|延迟|吞吐)"
METHOD = r"(?i)(方法|算法|模型|框架|基线|baseline|ours|本文)"
BASELINE = r"(?i)(基线|baseline|对比|传统|规则)"
OURS = r"(?i)(本文|ours|提出|本方法|所提)"
RESULT = r"(?i)[-+]?\d+(?:\.\d+)?\s*(?:%|ms|s|秒|分|x|倍)?"
DATASET = r"(?i)(数据集|dataset|benchmark|场景|语料|任务集)"


def split_row(line: Column) -> Column:
    """Cells of a line: parted by tabs, bars, runs of spaces, else spaces."""
    clean = lambda a: F.filter(F.transform(a, T.compact), lambda x: x != "")
    return F.when(F.contains(line, F.lit("\t")), clean(F.split(line, "\t"))).when(F.contains(line, F.lit("|")), clean(F.split(line, r"\|"))).when(F.regexp_like(line, F.lit(r"\S {2,}\S")), clean(F.split(line, " {2,}"))).otherwise(clean(F.split(line, " ")))


def content(tables: DataFrame) -> DataFrame:
    """Rows of tables (table_id, text): (table_id, row_index, header, cells).

    The first line is the header if no cell of it holds a number."""
    lines = F.filter(F.split(T.text_of("text"), "\n"), lambda x: F.trim(x) != "")
    parsed = tables.select("table_id", F.transform(lines, split_row).alias("rows"))  # a column, so that a text is parsed once
    head = F.get("rows", F.lit(0))
    named = ~F.exists(F.coalesce(head, F.array().cast("array<string>")), lambda c: F.regexp_like(c, F.lit(r"\d")))
    marked = parsed.select("table_id", head.alias("first"), named.alias("named"), "rows")
    made = marked.select("table_id", "first", "named", F.posexplode_outer("rows").alias("row_index", "cells")).filter("row_index IS NOT NULL")  # outer: else a filter by size parses it again
    kept = made.filter(~(F.col("named") & (F.col("row_index") == 0)))
    header = F.when(F.col("named"), F.col("first")).otherwise(F.transform("first", lambda x, i: F.concat(F.lit("column_"), i + 1)))
    return kept.select("table_id", (F.col("row_index") - F.col("named").cast("int")).alias("row_index"), header.alias("header"), "cells")


def summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table_id").agg(F.count("*").alias("row_count"), F.max(F.size("header")).alias("column_count"), F.sum(F.size("cells")).alias("cell_count"))


def cell_kind(header: Column, cell: Column) -> Column:
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    return F.when(like(header, DATASET), "dataset").when(like(header, METRIC) & like(cell, RESULT), "result").when(like(header, METHOD) | like(cell, METHOD), "method").when(like(cell, RESULT), "result").otherwise("value")


def facts(rows: DataFrame) -> DataFrame:
    """(table_id, row_index, method, metric, result, is_ours, is_baseline): each
    result of a row with the row's method, the first cell that is no number."""
    method = F.get(F.filter("cells", lambda c: ~F.regexp_like(c, F.lit(r"^[-+]?\d"))), F.lit(0))
    each = rows.select("table_id", "row_index", method.alias("method"), F.explode(F.arrays_zip(F.col("header").alias("header"), F.col("cells").alias("cells"))).alias("c"))
    found = each.select("table_id", "row_index", "method", F.col("c.header").alias("metric"), F.col("c.cells").alias("result")).filter("metric IS NOT NULL AND result IS NOT NULL")
    found = found.filter((cell_kind(F.col("metric"), F.col("result")) == "result") & (F.col("result") != F.coalesce("method", F.lit(""))))
    return found.withColumns({"is_ours": F.regexp_like(F.coalesce("method", F.lit("")), F.lit(OURS)), "is_baseline": F.regexp_like(F.coalesce("method", F.lit("")), F.lit(BASELINE))})


def comparisons(found: DataFrame, baselines: int = 3) -> DataFrame:
    """Own methods against up to ``baselines`` others of the same table and metric."""
    order = Window.partitionBy("table_id", "metric").orderBy("row_index", "method")
    other = found.filter("is_baseline AND NOT is_ours").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= baselines)
    right = other.select("table_id", "metric", F.col("method").alias("baseline"), F.col("result").alias("baseline_result"))
    return found.filter("is_ours").join(right, ["table_id", "metric"]).select("table_id", "metric", "method", "result", "baseline", "baseline_result")
