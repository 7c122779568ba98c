"""Tables recovered from captions, and citation maps, on small fixtures."""

from lexforge.operators import citations, recovery

BLOCKS = "doc_id long, position long, kind string, text string"


def recovered(spark, rows, **more):
    out = recovery.recovered(spark.createDataFrame(rows, BLOCKS), **more)
    return {(r["doc_id"], r["table_id"]): r for r in out.collect()}


def test_bodies_follow_captions(spark):
    rows = [
        (1, 0, "heading", "3 Results"),
        (1, 1, "table", "Table 1  accuracy of methods"),
        (1, 2, "paragraph", "as follows"),  # passed over: nothing has been taken yet
        (1, 3, "table", "| method | 准确率 |\n|---|:--|\n| ours | 91.2% |"),
        (1, 4, "paragraph", "base 88.1%\nrules 80%"),
        (1, 5, "paragraph", "prose ends the table"),
        (1, 6, "paragraph", "late 1 2\nrows 3 4"),
        (1, 7, "table", "表 2 只有标题"),  # a caption alone
        (1, 8, "heading", "4 Next"),
        (1, 9, "paragraph", "a 1 2\nb 3 4"),
        (2, 0, "table", "Table 9"),
        (2, 1, "figure", "Figure 1"),  # ends it at once
        (2, 2, "table", "x 1\ny 2"),
        (3, 0, "table", "Table 1"),
        (3, 1, "paragraph", "ours 20 30 base 40 50"),  # one line, cut at its numbers
        (4, 0, "table", "Table 1"),
        *[(4, k, "paragraph", "nothing") for k in range(1, 8)],
        (4, 8, "table", "x 1\ny 2"),  # beyond the seven blocks
        (5, 0, "table", "no caption\nx 1"),
        (6, 0, "table", None),
    ]
    got = recovered(spark, rows)
    assert set(got) == {(1, "table_001"), (3, "table_001")}
    one = got[1, "table_001"]
    assert one["headers"] == ["method", "准确率"] and one["rows"] == [["ours", "91.2%"], ["base", "88.1%"], ["rules", "80%"]]
    assert one["content_positions"] == [3, 4] and (one["row_count"], one["column_count"], one["cell_count"]) == (3, 2, 8)
    assert one["confidence"] == 0.68 and one["warnings"] == [] and one["caption"] == "Table 1 accuracy of methods"
    assert got[3, "table_001"]["rows"] == [["ours", "20"], ["30", "base"], ["40", "50"]] and got[3, "table_001"]["headers"] == []
    df = spark.createDataFrame(rows, BLOCKS)
    items = {(r["doc_id"], r["table_id"]): r for r in recovery.items(df, recovery.recovered(df)).collect()}
    # ids count all blocks of kind table, so the caption after a body is the third
    assert set(items) == {(1, "table_001"), (1, "table_003"), (2, "table_001"), (3, "table_001"), (4, "table_001")}
    assert items[1, "table_003"]["warnings"] == ["table_content_not_extracted"] and items[1, "table_001"]["row_count"] == 3
    scores = {r["doc_id"]: r["score"] for r in recovery.parse_score(recovery.items(df, recovery.recovered(df)), recovery.recovered(df)).collect()}
    assert scores == {1: 0.5, 2: 0.0, 3: 1.0, 4: 0.0}


def test_structured_cells_come_first_and_weak_tables_warn(spark):
    rows = [(1, 0, "table", "Table 1 a"), (1, 1, "table", "x 1\ny 2"), (1, 2, "table", "Table 2 b"), (1, 3, "table", "z 5\n")]
    cells = spark.createDataFrame([(1, "table_001", " Table 1  real ", r, c, f"r{r}c{c}") for r in range(3) for c in (1, 0)] + [(1, "table_001", "", 9, 0, " ")], "doc_id long, table_id string, caption string, row_index int, column_index int, text string")
    got = recovered(spark, rows, cells=cells)
    first = got[1, "table_001"]
    assert first["source"] == "docling_table" and first["confidence"] == 0.95 and first["caption"] == "Table 1 real"
    assert first["rows"][0] == ["r0c0", "r0c1"] and first["row_count"] == 3
    assert got[1, "table_003"]["warnings"] == ["weak_table_structure"] and got[1, "table_003"]["confidence"] == 0.58
    summary = {r["table_id"]: r for r in recovery.summaries(recovery.recovered(spark.createDataFrame([(1, 0, "table", "Table 1"), (1, 1, "table", "method 召回 time\nours 9 8\nbaseline 7 8")], BLOCKS))).collect()}["table_001"]
    assert summary["metrics"] == ["召回"] and summary["methods"] == ["ours", "baseline"] and summary["results"] == ["9", "8", "7"]


def test_empty_blocks(spark):
    assert recovered(spark, []) == {}


NODES = "doc_id long, node_id string, order_index long, kind string, node_path string, text string"


def test_citation_map(spark):
    rows = [
        (1, "a", 0, "paragraph", "Intro", "As [1] and [2-4, 9] show, not [0,1] or [7-3]; see [12、 1]."),
        (1, "r0", 5, "reference", "References", "Contents ........ 3"),
        (1, "r1", 6, "reference", "References", "Old work of 1987 without a number"),
        (1, "r2", 7, "reference", "References", "goes on here"),
        (1, "r3", 8, "reference", "References", "[1] Smith J. A title. Venue 2001. [2] Doe. Other, 1999"),
        (1, "r4", 9, "reference", "References", "with a second line"),
        (1, "r5", 10, "reference", "References", "short"),
        (1, "r6", 11, "reference", "References", "3. Roe. Third 2010"),
        (1, "r7", 12, "reference", "Appendix", "[44] not in a list 2001"),
        (2, "b", 0, "paragraph", "", "x" * 100 + " [5] " + "y" * 100),
        (3, "c", 0, "paragraph", "", None),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    refs, said = citations.citation_map(nodes)
    got = [tuple(r) for r in refs.orderBy("doc_id", "number").collect()]
    assert [(r[1], r[2], r[5], r[6]) for r in got] == [(1, "ref_1", "", 1987), (2, "ref_1", "A title", 2001), (3, "ref_2", "Other, 1999 with a second line", 1999), (4, "ref_3", "Third 2010", 2010)]
    assert got[0][3] == "Old work of 1987 without a number goes on here" and got[1][4] == "Smith J"
    marks = [(r["doc_id"], r["mark_no"], r["ref_id"], r["matched_reference"]) for r in said.orderBy("doc_id", "mark_no").collect()]
    assert sorted(marks) == sorted([(1, 1, "ref_1", True), (1, 2, "ref_2", True), (1, 2, "ref_3", True), (1, 2, "ref_4", False), (1, 2, "ref_9", False), (1, 5, "ref_12", False), (1, 5, "ref_1", True), (2, 1, "ref_5", False)])
    assert said.filter("doc_id = 2").first()["context"] == "x" * 79 + " [5] " + "y" * 79
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    status = {r["doc_id"]: (r["references"], r["citations"], r["matched"], r["status"], r["warnings"]) for r in citations.status(docs, refs, said).collect()}
    assert status == {1: (4, 7, 4, "extracted", ""), 2: (0, 1, 0, "extracted", "missing_reference_list"), 3: (0, 0, 0, "partial", "missing_reference_list")}
    # a document without a list of its own takes the lines it is given
    lines = spark.createDataFrame([(2, 0, "[5] Late. Found 2020"), (1, 0, "[9] not asked 2000")], "doc_id long, order_index long, line string")
    refs, said = citations.citation_map(nodes, lines)
    assert refs.count() == 5 and said.filter("doc_id = 2").first()["matched_reference"] and not said.filter("ref_id = 'ref_9'").first()["matched_reference"]
