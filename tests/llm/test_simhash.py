import random

import numpy as np
import pytest
import xxhash

from lexforge.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def clusters(rng, n, centres, flips):
    out = []
    for _ in range(n):
        x = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_fingerprint_equals_its_definition():
    rng = random.Random(0)
    for text in [None, "", " \t", "One", "one TWO", "É À b", *(" ".join(rng.choice("abcdEF") * rng.randint(1, 3) for _ in range(n)) for n in (3, 4, 50, 400))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("tile", [3, 16, 1024])
def test_tiles_link_all_pairs_within_the_radius(tile):
    rng = random.Random(tile)
    fps = list({*clusters(rng, 150, [rng.getrandbits(64) for _ in range(12)], 3), *(rng.getrandbits(64) for _ in range(100))})
    signed = np.array(fps, np.uint64).view(np.int64)
    root, compared, skipped = simhash.link_tiles(signed, None, 2, tile)
    want = plain_components(fps, 2)
    assert [[a == b for b in root] for a in root] == [[a == b for b in want] for a in want]
    assert tile != 3 or skipped > 0


@pytest.mark.parametrize("cell_size,cell_limit", [(4, 100000), (64, 20), (100000, 30)])
def test_links_lose_no_pair(spark, cell_size, cell_limit):
    """Small cells, cells cut into pairs of tiles, and one cell for all."""
    rng = random.Random(cell_limit)
    fps = sorted({*clusters(rng, 250, [rng.getrandbits(64) for _ in range(10)], 4), *(rng.getrandbits(64) for _ in range(60))})
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = components.components(simhash.near_links(classes, 2, cell_size, cell_limit, tile=16)).collect()
    label = {int(np.int64(r["node"]).view(np.uint64)): r["root"] for r in found}
    want = plain_components(fps, 2)
    for i in range(len(fps)):
        for j in range(i):
            same = fps[i] in label and fps[j] in label and label[fps[i]] == label[fps[j]]
            assert same == (want[i] == want[j])


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(50)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows(odd_docs, no_docs, all_plain):
    fps = [plain_fingerprint(t) for _, t in all_plain]
    root = plain_components(fps, 2)
    smallest = {}
    for (doc_id, _), r in zip(all_plain, root):
        if doc_id is not None:
            smallest[r] = min(doc_id, smallest.get(r, doc_id))
    want = [(d, f"{f:016x}", smallest.get(r)) for (d, _), f, r in zip(all_plain, fps, root)]
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each_group_stays(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and ids.count(9) == 1 and ids.count(None) == 1
    assert 4 in ids and 5 not in ids and 7 not in ids  # no words at all: one group
    assert simhash.keep_one(no_docs).count() == 0
