import random

import numpy as np

from lexforge.llm import resemblance, simhash
from test_resemblance import plain_groups, plain_similarity


def alike(n, seed=1):
    """Edited copies of one text, most pairs of which are below 0.8."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(200)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(len(copy)), 4):
            copy[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_pairs_of_a_group_stay_inside_tasks(spark, monkeypatch):
    """Whatever leaves a task grows with the classes, not with their pairs."""
    texts = alike(150)
    rows = list(enumerate(texts))
    near = sum(plain_similarity(a, b) >= 0.8 for k, a in enumerate(texts) for b in texts[:k])
    assert near < 0.2 * 150 * 149 / 2
    counts, write = {}, resemblance.written

    def counted(df, tag):
        out = write(df, tag)
        counts[tag] = max(counts.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(resemblance, "written", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert got == plain_groups(rows)
    assert counts and max(counts.values()) <= resemblance.BANDS * len(rows)


def test_a_place_gives_one_link_for_each_merge():
    texts = alike(80, 2) + alike(1, 3) * 3
    made = [np.unique(resemblance.shingle_hashes(resemblance.words_of(t))) for t in texts]
    n = len(texts)
    rows = {"fp": np.arange(n), "root": np.arange(n), "sim": np.array([resemblance.folded(h) for h in made]), "n": np.array([len(h) for h in made]), "side": np.zeros(n, int), "band": np.zeros(n, int), "keys": np.zeros((n, resemblance.BANDS), np.int32)}
    sets = [np.unique(h.astype(np.uint32)) for h in made]
    for side in (np.zeros(n, int), np.arange(n) % 2):
        links = resemblance.place_links(rows | {"side": side}, sets, radius=64)
        want = [(a, b) for a in range(n) for b in range(a) if plain_similarity(texts[a], texts[b]) >= 0.8 and (not side.any() or side[a] != side[b])]
        assert simhash_groups(n, links) == simhash_groups(n, want) and len(links) == n - len(set(simhash_groups(n, want)))


def simhash_groups(n, links):
    root = np.arange(n)
    if links:
        a, b = np.array(links).T
        root = simhash._join(root, a, b)
    return root.tolist()
