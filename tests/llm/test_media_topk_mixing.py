import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from lexforge.llm import mixing, tiff, topk


def some_bytes(rng):
    return [b"", b"a", b"ab" * 300, bytes(rng.randrange(256) for _ in range(5000)), b"\0" * 9000, b"the cat sat on the mat " * 400, bytes(range(256)) * 30]


def test_codecs_round_trip():
    for data in some_bytes(random.Random(0)):
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 16])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (37, 53), dtype=np.uint8), rng.integers(0, 60000, (20, 16, 3)).astype(np.uint16), np.zeros((1, 64), np.uint8)]
    back = list(tiff.read_pages(tiff.write_tiff(pages, compression, predictor, tile, strip_rows=8, order=order)))
    assert [p.number for p in back] == [0, 1, 2] and {p.layout for p in back} == {"tiles" if tile else "strips"}
    for want, got in zip(pages, back):
        assert (got.pixels.squeeze(-1) if want.ndim == 2 else got.pixels).tolist() == want.tolist() and got.predictor == predictor


def test_pages_rows(spark):
    good = tiff.write_tiff([np.arange(64, dtype=np.uint8).reshape(8, 8)] * 2)
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0garbage"), (5, good[: len(good) // 2]), (1, good)]
    got = tiff.pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert sorted((r["doc_id"], r["page"]) for r in got if r["error"] is None) == [(1, 0), (1, 0), (1, 1), (1, 1), (5, 0)]  # half a file still has its first page
    assert {r["doc_id"] for r in got if r["error"]} == {3, 4, 5}
    assert all(r["pixels"] == bytes(range(64)) for r in got if r["error"] is None)


def test_text_media_rows(odd_docs, no_docs, all_plain):
    got = tiff.text_media(odd_docs, keep_media=True).collect()
    want = Counter()
    for doc_id, text in all_plain:
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want[doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    assert all(r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() for r in got)
    assert tiff.text_media(no_docs).count() == 0


def test_long_texts_take_several_pages():
    payload = bytes(k % 251 for k in range(64 * (tiff.PAGE_ROWS + 5)))
    pages = list(tiff.read_pages(tiff.stored(payload)))
    assert len(pages) == 2 and b"".join(p.pixels.tobytes() for p in pages) == payload


def test_decoders_stop_at_the_size_of_a_strip():
    """A small strip that would unpack to much more is cut at its size."""
    zeros = bytes(1 << 20)
    for encode, decode in ((tiff.lzw_encode, tiff.lzw_decode), (tiff.packbits_encode, tiff.packbits_decode)):
        packed = encode(zeros)
        assert decode(packed) == zeros and 1000 <= len(decode(packed, 1000)) < 1000 + 4096
    # a table that is never cleared does not grow beyond twelve bits
    assert tiff.lzw_decode(tiff.lzw_encode(bytes(range(256)) * 300)) == bytes(range(256)) * 300


def test_payloads_take_every_form():
    import zlib

    rng = random.Random(1)
    seen = set()
    for n in range(2000):
        payload = bytes(rng.choice(b"abc \0") for _ in range(64 * rng.randint(1, 3)))
        if zlib.crc32(payload) % tiff.SHARE < len(tiff.FORMS) and zlib.crc32(payload) % tiff.SHARE not in seen:
            seen.add(zlib.crc32(payload) % tiff.SHARE)
            form = tiff.FORMS[zlib.crc32(payload) % tiff.SHARE]
            (page,) = tiff.read_pages(tiff.stored(payload))
            assert page.pixels.tobytes() == payload and (page.compression, page.predictor, page.layout) == (tiff.NAMES[form[0]], form[1], "tiles" if form[2] else "strips")
    assert seen == set(range(len(tiff.FORMS)))


def test_damaged_files_give_error_rows(spark):
    rng = random.Random(9)
    nprng = np.random.default_rng(9)
    whole = [tiff.write_tiff([nprng.integers(0, 255, (9, 11, 3)).astype(np.uint8)], compression=c, tile=t) for c in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE) for t in (None, 16)]
    files = []
    for _ in range(3000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        files.append(bytes(data[: rng.randrange(len(data))] if rng.random() < 0.2 else data))
    df = spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")
    rows = tiff.pages(df).collect()
    assert {r["doc_id"] for r in rows} == set(range(3000)) and sum(r["error"] is not None for r in rows) > 500


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_samples_below_a_byte(bits):
    rng = np.random.default_rng(bits)
    pixels = rng.integers(0, 1 << bits, (5, 7)).astype(np.uint8)
    ones = ((pixels[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).reshape(5, -1).astype(np.uint8)
    strip = np.packbits(ones, axis=1).tobytes()
    tags = [(256, 7), (257, 5), (258, bits), (259, 1), (262, 1), (273, 8), (277, 1), (278, 5), (279, len(strip))]
    body = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
    at = 8 + len(strip) + len(strip) % 2
    data = b"II" + struct.pack("<HI", 42, at) + strip.ljust(at - 8, b"\0") + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0)
    page = next(tiff.read_pages(data))
    assert (page.pixels[:, :, 0] == pixels).all() and page.bits == bits


def plain_top(rows, k, every):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-0.5, -0.25, 0.1, 0.3, 0.7]) if k % 3 else rng.gauss(0, 1) for _ in range(24)]) for k in range(400)]
    rows += [(1000, None), (1001, []), (1002, [None] * 24), (1003, [float("nan")] * 24), (1004, [float("inf")] + [0.0] * 23), (None, [1.0] * 24), (1010, [1.0] * 24), (1011, [1.0] * 24), (1020, [0.5, 0.5]), (1021, [0.5, -0.5]), (1030, [3e9] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).selectExpr("*", "1 AS id", "2 AS v", "3 AS score")
    got = sorted(tuple(r) for r in topk.top_k(df, 5, 10).collect())
    assert got == plain_top(rows, 5, 10)
    assert topk.top_k(df.limit(0), 5, 10).count() == 0


def test_query_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "QUERY_BYTES", 9 * 8 * 7)
    assert sorted(tuple(r) for r in topk.top_k(df, 3, 5).collect()) == plain_top(rows, 3, 5)


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(500, 64)) * np.repeat([3, 0.1, 1, 0.2], 16))
    for n in topk.LEVELS:
        s = topk.segments(x, n)
        assert (s @ s.T + 1e-6 >= x @ x.T).all()
    # vectors around three hundred centres: whole groups fall to the bounds
    x = np.floor(256 * (np.repeat(rng.normal(size=(300, 64)).cumsum(axis=1), 20, axis=0) + 0.3 * rng.normal(size=(6000, 64))))
    scores = x[:20] @ x.T
    np.fill_diagonal(scores, -np.inf)
    floor = np.sort(scores, axis=1)[:, -5]
    block = topk.Block(np.arange(20), np.arange(20), x[:20], floor, (1, 4, 16))
    got = [block.meet(np.arange(s, s + 3000), x[s : s + 3000], topk.tile_stats(x[s : s + 3000]), 5) for s in (0, 3000)]
    assert block.pairs == 20 * 6000 and block.exact < 0.05 * block.pairs and sum(block.passed) > 0
    found = {(int(q), int(i) + s) for s, (qi, xi, _, own) in zip((0, 3000), got) for q, i, o in zip(qi, xi, own) if not o}
    want = {(q, int(i)) for q in range(20) for i in np.flatnonzero(scores[q] >= floor[q])}
    assert want <= found


def test_under_half_of_the_given_pairs_are_scored():
    """The tables' vectors are alike in all directions: coarse levels leave all
    pairs, the front levels few."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = table.column("vec_id").to_numpy(), np.floor(256 * np.array(table.column("embedding").to_pylist(), float))
    asked = ids % 50 == 0
    scores = x[asked] @ x.T
    scores[ids[asked][:, None] == ids[None, :]] = -np.inf
    floor = np.sort(scores, axis=1)[:, -5]
    block = topk.Block(np.arange(asked.sum()), ids[asked], x[asked], floor)
    qi, xi, _, own = block.meet(ids, x, topk.tile_stats(x), 5)
    assert set(zip(*np.nonzero(scores >= floor[:, None]))) <= set(zip(qi[~own].tolist(), xi[~own].tolist()))
    assert block.exact < 0.03 * block.pairs and block.passed[0] == block.pairs
    assert block.passed == sorted(block.passed, reverse=True) and block.passed[3] < 0.25 * block.pairs


def test_top_k_of_repeated_ids_and_huge_components(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [0.0, 1.0]), (11, [1.0, 1.0]), (12, [1e200, -1e200]), (20, [2e155, 1e155]), (21, [1e155, 1e155])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, 3, 10).collect())
    whole = [(i, [int(x * 256) if abs(x) > 2**52 else math.floor(256 * x) for x in v]) for i, v in rows]
    top, want = (1 << 63) - 1, []
    for n, (q, a) in enumerate(whole):
        if q % 10 == 0:
            scored = sorted((-max(-top - 1, min(top, sum(x * y for x, y in zip(a, b)))), i) for m, (i, b) in enumerate(whole) if m != n)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:3])]
    assert got == sorted(want)


def test_poisson_counts(spark):
    """Counts follow the distribution and its inverse exactly, for small and large means."""
    rows = [(k, "t", "en", "big" if k % 10 else "small", 1) for k in range(4000)] + [(90_000, "t", "en", "rare", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"big": 1.0, "small": 2.0, "rare": 0.1}
    table = {r["source"]: r["rate"] for r in mixing.rates(docs, weights=weights).collect()}
    assert math.isclose(table["small"], 2 / 3.1 * 4001 / 400) and table["rare"] > 100
    got = Counter(r["doc_id"] for r in mixing.mixed(docs, weights=weights).collect())

    def uniform(doc_id, part):
        return int(hashlib.md5(f"7|{doc_id}|{part}".encode()).hexdigest()[:13], 16) / 2**52

    def inverse(mean, u):
        p = c = math.exp(-mean)
        k = 0
        while c <= u:
            k += 1
            p *= mean / k
            c += p
        return k

    for doc_id, _, _, source, _ in rows:
        parts = max(1, math.ceil(table[source] / mixing.PART))
        assert got[doc_id] == sum(inverse(table[source] / parts, uniform(doc_id, n)) for n in range(1, parts + 1))


def test_mixing_odd_rows(odd_docs, no_docs):
    out = mixing.mixed(odd_docs)
    assert out.columns == [*odd_docs.columns, "copy_no", "shuffle_key"]
    assert mixing.mixed(no_docs).count() == 0
    assert mixing.mixed(odd_docs, weights={"nowhere": 1.0}).count() == 0
    assert mixing.mixed(odd_docs, copy_col=None, key_col=None).columns == odd_docs.columns
    # a column of the input that is named like a new one makes way, whatever its case
    clash = odd_docs.withColumnRenamed("batch", "Copy_No").withColumnRenamed("rank", "shuffle_key")
    made = mixing.mixed(clash)
    assert made.columns == [c for c in odd_docs.columns if c not in ("batch", "rank")] + ["copy_no", "shuffle_key"]
    assert sorted((str(r["doc_id"]), r["copy_no"]) for r in made.collect()) == sorted((str(r["doc_id"]), r["copy_no"]) for r in out.collect())
    assert "Copy_No" in mixing.mixed(clash, copy_col="nth", key_col=None).columns


def test_mixing_stays_native(odd_docs):
    plan = mixing.mixed(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
