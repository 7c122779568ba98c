import random

import duckdb
import numpy as np
import pytest

from lexforge.llm import jaccard
from lexforge.llm.queries import oracle_sql


def grams(text, width=3):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    k = min(width, len(w))
    return {b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(rows, percent=90):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(sets[k]), least.get(find(k), d)) for k, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n_groups=12):
    """Prose of all sizes, chains of edits, and a passage that many texts share."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    common, out = prose(70), []
    for _ in range(n_groups):
        now = prose(rng.choice([4, 9, 12, 20, 40, 90, 200, 400]))
        for _ in range(rng.randint(1, 12)):
            out.append(" ".join(now))
            now = list(now)
            for _ in range(rng.randint(0, max(1, len(now) // 70))):
                at = rng.randrange(len(now))
                now[at : at + rng.randint(0, 2)] = prose(rng.randint(0, 2))
            now = now or prose(3)
    out += [" ".join(prose(rng.randint(1, 60)) + common) for _ in range(40)]
    out += ["one", "One ", "one two", "ONE\ttwo", "", " \n", "one two three", "a b c d e f g h i j k", "a b c d e f g h i j k l"]
    rng.shuffle(out)
    return [(3 * k + 1, t.upper() if k % 4 == 0 else t) for k, t in enumerate(out)] + [(9000, None), (None, out[0]), (9001, out[1]), (9001, out[1])]


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed,tile", [(1, None), (2, 300)])
def test_components_equal_brute_force(spark, monkeypatch, seed, tile):
    """With blocks whole, and cut into tiles of 300 n-grams."""
    if tile:
        monkeypatch.setattr(jaccard, "TILE", tile)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(jaccard.joined(df)) == plain(rows)


def test_signatures_meet_for_every_linked_pair():
    """Pairs exactly at the bound, of all sizes, share a signature."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        both = int(rng.integers(1, 600))
        most = int(both * 10 / 9) - both
        extra_a = int(rng.integers(0, most + 1))
        extra_b = int(rng.integers(0, most - extra_a + 1))
        all_of = rng.integers(0, 1 << 63, both + extra_a + extra_b, np.uint64) * np.uint64(2)
        a, b = np.unique(all_of[: both + extra_a]), np.unique(np.append(all_of[:both], all_of[both + extra_a :]))
        assert 100 * both >= 90 * len(all_of)
        if len(a) == len(b) == both:
            continue
        assert np.isin(jaccard.signatures(a), jaccard.signatures(b)).any(), (both, extra_a, extra_b)


def test_unlike_texts_rarely_share_a_signature():
    rng = np.random.default_rng(6)
    seen = [set(jaccard.signatures(np.unique(rng.integers(0, 1 << 63, int(n), np.uint64) * np.uint64(2))).tolist()) for n in rng.integers(100, 900, 300)]
    assert sum(bool(a & b) for k, a in enumerate(seen) for b in seen[:k]) == 0


def test_near_copies_cost_few_products():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 62, 400, np.uint64))
    sets = [np.unique(np.append(np.delete(base, rng.integers(0, len(base), 6)), rng.integers(0, 1 << 62, 6, np.uint64))) for _ in range(500)]
    links, products = jaccard.links_within(sets, np.arange(500))
    assert len(links) == 499 and products <= 48
    apart = [np.unique(rng.integers(0, 1 << 62, 50, np.uint64)) for _ in range(40)]
    assert jaccard.links_within(apart, np.arange(40))[0] == []


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(jaccard.joined(odd_docs.withColumnRenamed("id", "class"))) == plain(rows)
    assert found(jaccard.joined(no_docs)) == []
    with pytest.raises(ValueError):
        jaccard.joined(no_docs, percent=100)


def test_other_bounds(spark):
    rows = corpus(4, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.joined(df, percent=70)) == plain(rows, 70)


def test_query_equals_sql_and_brute_force(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    df = spark.read.parquet(path)
    got = found(jaccard.joined(df))
    assert got == plain([(r["doc_id"], r["text"]) for r in df.collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    assert sorted(con.sql(oracle_sql()["op11_jaccard_join"]).fetchall(), key=str) == got
