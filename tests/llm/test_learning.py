import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexforge.llm import langid, quality, toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic words in one document of seven, junk marks in one of six, two languages."""
    rng = random.Random(7)
    en, fr = ["the", "thing", "ering", "ation", "onth"], ["le", "queaux", "eauté", "oire", "ment"]
    rows, labels = [], []
    for k in range(1600):
        words = [rng.choice(en if k % 2 else fr) + rng.choice(["", "er", "on", "al", "is", "um"]) for _ in range(rng.randint(20, 60))]
        toxic, junk = k % 7 == 0, k % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "grimword"]))
        if junk:
            words = [w + "###" for w in words]
        rows.append((k, " ".join(words), "en" if k % 2 else "fr", "s", 1))
        if k % 5 < 4:
            labels.append((k, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_risk(rows, w, b, prior):
    """The non-negative risk of rows (features, positive), and its two parts, one row at a time."""
    plus = minus_p = minus_u = n_p = 0.0
    for found, positive in rows:
        g = b + sum(w[k] for k in found)
        minus_u += math.log1p(math.exp(g))
        if positive:
            n_p += 1
            plus += math.log1p(math.exp(-g))
            minus_p += math.log1p(math.exp(g))
    return prior * plus / n_p, minus_u / len(rows) - prior * minus_p / n_p


def risk_rows():
    rng = random.Random(1)
    rows = [([0, *sorted(rng.sample(range(2, 9), 2))], True) for _ in range(20)] + [([1] * (k % 2) + sorted(rng.sample(range(2, 9), 3)), False) for k in range(80)] + [([], False)] * 5
    counted = Counter((tuple(f), p) for f, p in rows)
    arrays = [np.array(f, np.int64) for f, _ in counted]
    return rows, lambda w, b: toxicity.gradient(arrays, np.array([p for _, p in counted]), np.array(list(counted.values()), float), w, b)


def test_risk_and_gradient_equal_plain_python():
    rows, sums = risk_rows()
    rng, prior, n_p, n_u = np.random.default_rng(2), 0.3, 20, len(rows)
    for _ in range(4):
        w, b = rng.normal(size=9), float(rng.normal())
        plus, minus_p, minus_u = np.split(sums(w, b), 3)
        first, second = plain_risk(rows, w, b, prior)
        assert np.isclose(prior * plus[0] / n_p, first) and np.isclose(minus_u[0] / n_u - prior * minus_p[0] / n_p, second)
        for k in range(-1, 9):  # slopes by small differences
            e = 1e-6
            up, down = (plain_risk(rows, w + s * e * (np.arange(9) == k), b + s * e * (k < 0), prior) for s in (1, -1))
            at = 1 + 1 + k
            assert np.isclose(prior * plus[at] / n_p, (up[0] - down[0]) / 2 / e, atol=1e-5)
            assert np.isclose(minus_u[at] / n_u - prior * minus_p[at] / n_p, (up[1] - down[1]) / 2 / e, atol=1e-5)


def test_training_lowers_the_risk_and_turns_back_below_zero():
    rows, sums = risk_rows()
    # a prior above the share of positives drives the second part below zero
    seconds = []

    def watched(w, b):
        seconds.append(plain_risk(rows, w, b, 0.6)[1])
        return sums(w, b)

    w, b, risks = toxicity.descend(watched, 9, 20, len(rows), 0.6, steps=200)
    assert risks[-1] < risks[0] and min(seconds) < 0 and min(seconds) > -0.5
    assert any(x < 0 and y > x for x, y in zip(seconds, seconds[1:]))
    w, b, risks = toxicity.descend(sums, 9, 20, len(rows), 0.2)
    assert risks[-1] < 0.8 * risks[0] and w[0] > 1 > w[1]


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    mine = [k for k in got if held(k)]
    right = sum((got[k]["predicted"] == 1) == (k % 7 == 0) for k in mine)
    assert len(mine) > 300 and right / len(mine) > 0.97
    assert {k: r["score"] for k, r in got.items()} == {r["doc_id"]: r["score"] for r in toxicity.learned_scores(docs, labels).collect()}
    kept = {r["doc_id"] for r in toxicity.clean(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if not r["predicted"]}


def test_toxicity_odd_rows(odd_docs, no_docs, corpus):
    model = toxicity.train(*corpus)
    rows = toxicity.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.scored(no_docs, model).count() == 0
    assert toxicity.clean(odd_docs, corpus[1]).columns == odd_docs.columns
    assert toxicity.clean(no_docs, corpus[1]).count() == 0
    empty = toxicity.train(no_docs, corpus[1])
    assert all(r["predicted"] == 0 for r in toxicity.scored(odd_docs, empty).collect())


def test_weights_equal_their_definition(corpus):
    docs, labels = corpus
    model = quality.fit(docs, labels)
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for r in docs.collect():
        n = np.bincount(quality.grams(r["text"]), minlength=quality.BUCKETS)
        raw += n
        target += n * (r["doc_id"] in good)
    want = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(model.ratio, want)
    assert quality.grams(None).size == 0 and quality.grams("a").size == 1 and quality.grams("a, b").size == 5


def test_the_k_largest_keys_stay(corpus):
    docs, labels = corpus
    rows = quality.resampled(docs, labels, share=0.5).collect()
    keys = sorted((r["gumbel_key"] for r in rows), reverse=True)
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in rows if r["gumbel_key"] >= keys[len(rows) // 2 - 1]}
    rows = quality.resampled(docs, labels).collect()
    junk = [r["kept"] for r in rows if r["doc_id"] % 6 == 0]
    clean = [r["kept"] for r in rows if r["doc_id"] % 6]
    assert sum(junk) / len(junk) < 0.15 and all(clean)
    kept = {r["doc_id"] for r in quality.sample(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in rows if r["kept"]}


def test_kth_largest_is_exact(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(-5, 5)]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 3000):
        assert quality.kth_largest(df, "v", k) == ordered[k - 1]
    assert quality.kth_largest(df, "v", 3001) is None
    doubles = np.array([-np.inf, -2.5, -1e-300, 0.0, 1e-300, 3.0, np.inf])
    assert (np.diff(quality.order_key(doubles)) > 0).all()


def test_quality_odd_rows(odd_docs, no_docs, corpus):
    labels = corpus[1]
    rows = quality.resampled(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["kept"] for r in quality.resampled(odd_docs, labels.limit(0)).collect())
    assert quality.resampled(no_docs, labels).count() == 0
    assert quality.sample(odd_docs, labels).columns == odd_docs.columns
    assert not any(r["kept"] for r in quality.resampled(odd_docs, labels, share=0.0).collect())


def test_languages_held_out(corpus):
    docs, _ = corpus
    model = langid.train(docs)
    rows = [r for r in langid.identified(docs, model).collect() if r["held_out"]]
    assert len(rows) > 300 and sum(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") for r in rows) / len(rows) > 0.98


def test_mixtures_are_found(corpus):
    model = langid.train(corpus[0])
    en, fr = "the thinger ationon onthal erings " * 40, "le queauxer eautéon oireal mentis " * 40
    both = dict(model.mix(en + fr))
    assert set(both) == {"en", "fr"} and 0.3 < both["en"] < 0.7
    assert set(dict(model.mix(en))) == {"en"}
    assert model.mix("123 !!!") == [] and model.mix(None) == []


def test_language_sets_equal_an_exhaustive_search():
    """Over all sets of languages: the best penalised likelihood, each set by its own mixture."""
    rng = np.random.default_rng(8)
    p = rng.dirichlet(np.full(langid.BUCKETS, 0.02), 4).T + 1e-7
    model = langid.Model(["a", "b", "c", "d"], p / p.sum(axis=0))
    for trial in range(12):
        text = "".join(rng.choice(list("abcdefgh ij"), 60 + 40 * trial))
        found, counts = langid.trigrams(text)
        best = None
        for size in range(1, 5):
            for some in itertools.combinations(range(4), size):
                share, got = langid.mixture(model.p[found][:, some], counts, rounds=500, tolerance=1e-6)
                value = got / langid.OVERLAP - size * 0.5 * np.log(counts.sum() + 1)
                if best is None or value > best[0] + 1e-6:
                    best = (value, {model.names[k] for k in some})
        assert {n for n, _ in model.mix(text)} == best[1], (trial, model.mix(text), best)


def test_mixture_raises_the_likelihood():
    rng = np.random.default_rng(3)
    p, counts = rng.dirichlet(np.ones(50), 3).T + 1e-6, rng.integers(1, 9, 50)
    share, best = langid.mixture(p, counts, tolerance=1e-9, rounds=2000)
    assert abs(share.sum() - 1) < 1e-9
    for _ in range(200):
        other = rng.dirichlet(np.ones(3))
        assert counts @ np.log(p @ other) <= best + 1e-6


def test_trigrams_of_strips_equal_the_whole(monkeypatch):
    text = "Ça va? " * 500 + "漢字 x"
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "STRIP", 64)
    cut = langid.trigrams(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_language_odd_rows(odd_docs, no_docs, corpus):
    model = langid.train(corpus[0])
    rows = {(r["doc_id"], r["lang_pred"]) for r in langid.identified(odd_docs, model).collect()}
    assert {(4, "und"), (5, "und"), (7, "und"), (11, "und")} <= rows
    assert langid.identified(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert {r["lang_pred"] for r in langid.identified(odd_docs, nothing).collect()} == {"und"}
