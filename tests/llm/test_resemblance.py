import random

import numpy as np
import pytest

from lexforge.llm import jaccard, resemblance, simhash


def plain_similarity(a, b, width=5):
    def shingles(text):
        words = (text or "").lower().split()
        n = min(width, len(words))
        return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x & y else 0.0


def plain_groups(rows, least=0.8):
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, s) in enumerate(rows):
        for b, t in rows[:k]:
            same = (s or "").lower().split() == (t or "").lower().split()
            if same or plain_similarity(s, t) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def corpus(seed, passages):
    """Prose, exact and edited copies, and texts that share a long passage."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(800)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, common = [], prose(60)
    for k in range(14):
        base = prose(rng.randint(60, 300))
        rows.append(base)
        for _ in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    rows += [prose(12) + common + prose(12) for _ in range(passages)]
    rows += [prose(3), prose(1), [], []]
    rng.shuffle(rows)
    return [(k * 3 + 1, " ".join(w).upper() if k % 5 == 0 else "  ".join(w)) for k, w in enumerate(rows)] + [(1000, None)]


@pytest.mark.parametrize("limit", [resemblance.LIMIT, 7])
def test_groups_equal_brute_force(spark, monkeypatch, limit):
    """With cells whole, and dealt into parts of seven."""
    monkeypatch.setattr(resemblance, "LIMIT", limit)
    rows = corpus(limit, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert got == plain_groups(rows)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {d for d, c in got.items() if d == c}


def test_nearest_finds_every_pair_and_skips_tiles():
    rng = np.random.default_rng(3)
    sim = rng.integers(0, 1 << 63, 600).astype(np.int64) & rng.integers(0, 1 << 63, 600).astype(np.int64)
    sim[300:] = sim[:300] ^ (np.int64(1) << rng.integers(0, 62, 300))
    sim[:40] = rng.integers(0, 4, 40)
    fp, n, root = rng.permutation(600).astype(np.int64), rng.integers(90, 100, 600), rng.integers(0, 500, 600)
    want = {(i, j) for i in range(600) for j in range(600) if i != j and root[i] != root[j] and int(sim[i] ^ sim[j]).bit_count() <= 6 and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])}
    a, b, whole, compared, skipped = resemblance.nearest(fp, sim, n, root, 600, radius=6, tile=32)
    assert set(zip(a.tolist(), b.tolist())) == want and whole and skipped > 0.1 * (compared + skipped)
    a, b, whole = resemblance._small(np.repeat(np.arange(10), 60), fp, sim, n, root, 600, 0.8, 6)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in want if i // 60 == j // 60} and whole
    one = resemblance.nearest(fp, sim, n, root, 1, radius=6)
    assert len(set(one[0].tolist())) == len(one[0]) == len({i for i, _ in want}) and not one[2]


def keyed(text):
    hashes = np.unique(resemblance.shingle_hashes(resemblance.words_of(text)))
    return hashes, resemblance.band_keys(hashes), resemblance.folded(hashes)


def is_found(x, y):
    """Whether two texts share a cell and are candidates in it."""
    return bool((x[1] == y[1]).any()) and ((x[2] ^ y[2]) & ((1 << 64) - 1)).bit_count() <= resemblance.RADIUS


def test_sets_give_the_similarity_and_no_pair_is_lost():
    """Prose, texts of a few shingles, and texts that repeat shingles."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    near = found = 0
    for k in range(1500):
        base = prose(150) if k % 3 else prose(rng.randint(8, 16))
        copy = list(base)
        for _ in range(rng.randint(1, 4) if k % 3 else 1):
            copy[rng.randrange(len(copy)) if k % 3 else -1] = rng.choice(words)
        if k % 3 == 1:
            copy += copy[-20:] * rng.randint(1, 30)
        x, y = keyed(" ".join(base)), keyed(" ".join(copy))
        s = resemblance.similarity(*(np.unique(h[0].astype(np.uint32)).tobytes() for h in (x, y)))
        assert abs(s - plain_similarity(" ".join(base), " ".join(copy))) < 1e-9
        if s >= 0.8:
            near += 1
            found += is_found(x, y)
    assert near > 500 and found >= near - 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_near_pair_of_the_tables_is_found(sf):
    import pyarrow.parquet as pq

    texts = sorted({t for t in pq.read_table(f"/root/testdata/{sf}/documents.parquet").column("text").to_pylist() if t})
    made = [keyed(t) for t in texts]
    block = jaccard.Block([m[0] for m in made], 80)
    pairs = [(i, j) for i in range(len(texts)) for j in block.linked(i, np.arange(len(texts))).tolist() if i < j]
    assert pairs and all(is_found(made[i], made[j]) for i, j in pairs)
