"""A lexical index kept up by changes against one that is rebuilt."""

import random

from lexforge.operators import lexical
from lexforge.operators.nodes import chunk_nodes
from lexforge.streaming import index

WORDS = "planner robot task graph latency été Été alpha beta gamma".split()


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_any_sequence_of_changes_equals_a_rebuild(spark, tmp_path):
    rng, docs = random.Random(3), {}
    folder = f"file://{tmp_path}/index"
    asked = spark.createDataFrame([(1, "planner latency"), (2, "ete beta"), (3, "nothing")], "query_id int, query string")
    for batch in range(4):
        rows = []
        for seq in range(8):
            doc = f"d{rng.randint(0, 6)}"
            if rng.random() < 0.3:
                rows.append((doc, "delete", None, seq))
                docs.pop(doc, None)
            else:
                text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 12, 400])))
                rows.append((doc, "upsert", text, seq))
                docs[doc] = text
        changes = spark.createDataFrame(rows, "doc_id string, op string, text string, seq int")
        index.apply_batch(spark, folder, batch, changes)
        if batch == 2:
            index.apply_batch(spark, folder, batch, changes)  # run again: nothing changes
    nodes = chunk_nodes(spark.createDataFrame(list(docs.items()), "doc_id string, text string"))
    assert found(index.bm25(asked, folder)) == found(lexical.fts_nodes(asked, nodes))
    assert index.nodes(spark, folder).count() == nodes.count()


def test_a_stream_of_changes(spark, tmp_path):
    schema = "doc_id string, op string, text string"
    for k, rows in enumerate(([("a", "upsert", "planner robot"), ("b", "upsert", "robot")], [("a", "delete", None), ("c", "upsert", "planner planner")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    folder = f"file://{tmp_path}/index"
    for _ in range(2):  # the second run finds nothing new
        changes = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        index.keep_up(changes, folder, f"{tmp_path}/checkpoint").awaitTermination()
    asked = spark.createDataFrame([(1, "planner")], "query_id int, query string")
    assert [r["doc_id"] for r in index.bm25(asked, folder).collect()] == ["c"]
