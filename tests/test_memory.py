"""Memory writes over a table and over a stream."""

from lexforge.streaming import memory

SCHEMA = "scope string, type string, subject_key string, seq long, at long, content string, importance double, confidence double, ttl long, refs string, force boolean"
ROWS = [
    ("p", "rule", "k", 0, 1000, "use  spaces", 0.4, None, None, "", False),
    ("p", "rule", "k", 1, 2000, "use spaces", 0.9, 0.5, None, "r1", False),
    ("p", "rule", "k", 2, 3000, "and tabs", None, 0.2, 9000, "", None),
    ("p", "rule", "k", 3, 2500, "too late", 1.0, 1.0, None, "", False),
    ("p", "rule", "k", 4, 9500, "after its time", 0.1, 0.3, None, "", False),
    ("p", "rule", "k", 5, 9600, "forced", 0.0, 0.0, None, "", True),
    ("p", "rule", "other", 6, 9700, None, None, None, 12000, None, False),
    (None, "rule", "k", 7, 9800, "AFTER its  time", 0.5, 0.5, None, "", False),
    ("q", "rule", "k", 8, 9900, "after its time", 0.5, 0.5, None, "", False),
]


def test_fold_of_a_table(spark):
    log = {r["seq"]: r for r in memory.folded(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect()}
    assert [log[n]["action"] for n in range(9)] == ["accepted", "merged", "merged", "late", "accepted", "accepted", "accepted", "accepted", "accepted"]
    # the first write keeps its text; the fold compacts when it merges
    assert log[1]["content"] == "use spaces" and log[1]["importance"] == 0.9 and log[1]["confidence"] == 1.0
    assert log[2]["content"] == "use spaces\nand tabs" and log[2]["refs"] == "r1" and log[2]["ttl"] == 9000 and log[2]["importance"] == 0.9
    assert log[3]["content"] == "use spaces\nand tabs" and log[4]["content"] == "after its time" and log[5]["importance"] == 0.0
    items = memory.items(memory.folded(spark.createDataFrame(ROWS, SCHEMA)))
    assert {(r["scope"], r["subject_key"]): r["content"] for r in items.collect()} == {("p", "k"): "forced", ("p", "other"): "", ("", "k"): "AFTER its  time", ("q", "k"): "after its time"}
    assert memory.items(memory.folded(spark.createDataFrame(ROWS, SCHEMA)), now=12000).count() == 3
    assert [(r["content"], r["n"]) for r in memory.duplicates(items).collect()] == [("after its time", 2)]
    assert memory.folded(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_and_table_agree(spark, tmp_path):
    """In micro-batches, with a late write and an item that a timer drops."""
    rows = ROWS[:7] + [("p", "rule", "last", 9, 50_000, "moves the clock", None, None, None, "", False), ("p", "rule", "last", 10, 55_000, "again", None, None, None, "", False), ("p", "rule", "other", 11, 60_000, "anew", None, None, None, "", False)]
    for k, part in enumerate((rows[:3], rows[3:7], rows[7:8], rows[8:9], rows[9:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    memory.followed(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(memory.LOG).parquet(f"{tmp_path}/out").collect()
    expired = [(r["subject_key"], r["ttl"]) for r in got if r["action"] == "expired"]
    assert expired == [("other", 12000)]
    want = sorted(tuple(r) for r in memory.folded(spark.createDataFrame(rows, SCHEMA)).collect())
    assert sorted(tuple(r) for r in got if r["action"] != "expired") == want


def test_long_items_go_out_a_few_at_a_time():
    rows = [("s", "t", "k", n, n, "merged", "x" * (1 << 20), 0.5, 1.0, None, "") for n in range(40)]
    made = list(memory._logged(iter(rows)))
    assert sum(b.num_rows for b in made) == 40 and max(b.num_rows for b in made) == memory.CHARACTERS >> 20
