import hashlib
import random
import zlib

import numpy as np
import pytest

from lexforge.llm import periodic


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def plain_runs(w):
    """Every stretch, by the definition."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q) and smallest_period(w[s : e + q]) == q:
                out.append((s, e + q - s, q))
            s = max(e, s) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    log = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(log.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def texts(seed, count=400):
    """Random words over small alphabets with powers inside powers."""
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        w = []
        while len(w) < rng.randint(0, 160):
            block = [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 12))]
            if rng.random() < 0.3:
                block = block * rng.randint(1, 6) + [rng.choice("xyz")]
            w += block * rng.randint(1, 9)
        out.append(w[: rng.randint(0, 200)])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_definition(seed):
    given = texts(seed)
    assert periodic.found_runs([[x.encode() for x in w] for w in given]) == [plain_runs(w) for w in given]


def test_fibonacci_words_and_long_powers():
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    for w in (b[:600], ["a"] * 500, (["a"] * 6 + ["b"]) * 40, (["a", "b"] * 5 + ["c"]) * 20 + ["a"] * 30):
        assert periodic.found_runs([[x.encode() for x in w]])[0] == plain_runs(w)
    # one word 300,000 times: a single run, whatever the number of its multiples
    assert periodic.found_runs([[b"w"] * 300_000]) == [[(0, 300_000, 1)]]


def test_many_texts_are_probed_as_one(monkeypatch):
    words = np.array([1, 1, 1, 1, 1, 1, -1, 1, 1, 1, 1, 1, -2], np.int32)
    assert periodic.runs_of(words, np.array([7, 6])) == [(0, 6, 1)]
    assert periodic.runs_of(np.zeros(0, np.int32), np.zeros(0, np.int64)) == []


def test_rows_equal_brute_force(spark):
    rows = [(k, " ".join(w)) for k, w in enumerate(texts(9, 120))]
    rows += [(None, "a a a a a a a"), (500, None), (501, ""), (502, " \t\n"), (503, "é é é é é é x"), (503, "é é é é é é x"), (-7, "A a A a A a A a"), (504, "a " * 5), (505, "a\x0ba\x0ca\ra a a a")]
    docs = spark.createDataFrame([(i, t, "runs", 3) for i, t in rows], "doc_id long, text string, runs string, start long").repartition(3)
    got = sorted((tuple(r) for r in periodic.longest_runs(docs).collect()), key=str)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=str)


def test_sf_and_odd_rows(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 3000")
    for given in (docs, odd_docs.filter("length(text) < 20000 OR text IS NULL")):
        want = sorted((plain_row(r["doc_id"], r["text"]) for r in given.collect()), key=str)
        assert sorted((tuple(r) for r in periodic.longest_runs(given).collect()), key=str) == want
    assert periodic.longest_runs(odd_docs).count() == odd_docs.count()
    assert periodic.longest_runs(no_docs).collect() == []


def test_the_operator_keeps_spans_and_text(spark):
    docs = spark.createDataFrame([("k", "go " * 8 + "on")], "doc_id string, text string")
    row = periodic.with_runs(docs, keep_text=True).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 8, 1)] and row["collapsed"] == "go on"
