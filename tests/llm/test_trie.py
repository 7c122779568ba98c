import hashlib
import random
import zlib

import duckdb
import pytest

from lexforge.llm import trie
from lexforge.llm.queries import oracle_sql

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, sha_key(role or "", text or ""), role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in convs.items()}


def plain(rows, rebuild=True):
    was = ordered(rows)
    convs = was
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in was}
        convs = {c: was.get(c - c % 5, [])[: h[c]] + turns[h[c] :] for c, turns in was.items()}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        leaves = sum(q not in children for q in below)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows, said = [], ["hi", "", "é", "how", "ok", None]
    for c in rng.sample(range(200), 40):
        n = rng.choice([0, 1, 2, 3, 5, 8, 12, 19])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "bot", None]) if rng.random() < 0.1 else "user", rng.choice(said) if t < 12 else "same"))
    return rows


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,rebuild", [(1, True), (2, False)])
def test_trie_equals_brute_force(spark, seed, rebuild):
    rows = corpus(seed)
    rows += [(0, None, "user", "first of all"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (None, 0, "user", "lost"), (-3, 0, "user", "hi"), (-3, 1, "bot", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", spark_lit("clash")).withColumn("depth", spark_lit("clash")).repartition(3)
    assert found(trie.conversation_trie(df, rebuild=rebuild)) == plain(rows, rebuild)


def spark_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_one_conversation_over_many_ranges(spark):
    rows = [(1, t, "user", f"w{t % 3}") for t in range(100)] + [(c, t, "user", f"w{t % 3}") for c in range(2, 8) for t in range(c)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), rebuild=False)) == plain(rows, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_tables_and_turnless_conversations(spark):
    assert found(trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    # conversation 3 begins with up to eight turns of conversation 0, which is absent: it may lose all of its turns
    lone = [(c, 0, "user", "x") for c in (1, 2, 3, 4)]
    assert found(trie.conversation_trie(spark.createDataFrame(lone, SCHEMA))) == plain(lone)


def test_query_equals_sql_and_brute_force(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    df = spark.read.parquet(path)
    got = found(trie.conversation_trie(df))
    assert got == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    assert sorted(con.sql(oracle_sql()["op12_conversation_trie"]).fetchall(), key=str) == got


def test_long_lists_of_ends_are_hashed_in_order(spark, monkeypatch):
    ends = spark.createDataFrame([(5, c) for c in range(3000)] + [(6, 9)], "node long, conv_id long").repartition(5)
    want = {5: hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest(), 6: hashlib.sha256(b"9").hexdigest()}
    assert {r["node"]: r["ends_sha256"] for r in trie.digests(ends).collect()} == want
