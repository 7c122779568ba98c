import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from lexforge.llm import bpe, caches, sstable, token_counts

WORD, BYTE = (str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def texts():
    rng = random.Random(1)
    alphabet = "abcdetheing'sllre dvm  \n\t0123²½éÉßİıΣσςé́ á 漢字\x85\xa0　\x1c!?*#😀<|endoftext|>"
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    long = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (300, 900, 2000)]
    return some + long + ["x<|endoftext|>y <|startoftext|>", "ΑΣ ΟΔΟΣ", "a" * 3000, "ab" * 2000, "!" * 900, "in" * 777 + "g" * 40, " lead", "trail ", "two  gaps", "a \nb", "a\n b"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encode_and_decode_equal_the_library(path):
    own, library = bpe.Tokenizer(path), Library.from_file(path)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        assert own.encode(text) == data, text
        assert "".join(own.decode(data)) == library.decode(ids, skip_special_tokens=False), text


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_stream_equals_whole_for_any_cut(path):
    own, rng = bpe.Tokenizer(path).merges, random.Random(5)
    for n in (own.lookahead * 2, own.lookahead * 5):
        for letters in ("etaoinshr", "ab", "a", "thein"):
            chars = "".join(rng.choice(letters) for _ in range(n))
            whole = own.merged(own.symbols(chars, True))
            for size in (7, 64, 300):
                assert list(own.stream(chars[k : k + size] for k in range(0, n, size))) == whole


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_text_fed_in_slices_equals_the_library(path, monkeypatch):
    """Pre-tokens longer than what is held go through a transducer of their own."""
    monkeypatch.setattr(bpe, "HOLD", 40)
    own, library, rng = bpe.Tokenizer(path), Library.from_file(path), random.Random(6)
    parts = ["a" * 300, "!?" * 150, " " * 200, "7" * 150, "é" * 90 + "e\u0301" * 60, "x'll" * 50, "\n \t" * 60, "<|endoftext|>", "it's", " ", "漢字", "\u0c5c" * 60, "ἈΣ", "e" + "\u0301\u0323" * 30]
    for _ in range(12):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for size in (7, 64, 1000):
            assert b"".join(own.stream(text[k : k + size] for k in range(0, len(text), size))) == want, (size, text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_characters_newer_than_the_tables(path):
    own, library = bpe.Tokenizer(path), Library.from_file(path)
    for c in [*range(0x300, 0x2FA20, 997), 0x558, 0x1C89, 0xA7CB, 0x1E5F1, 0x3FC36, 0x10940, 0x1D7CE, 0x85, 0x2028]:
        if not 0xD800 <= c < 0xE000:
            text = f"ab{chr(c)}cd 1{chr(c)} {chr(c)}"
            assert own.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(c)


@pytest.mark.parametrize("unit", ["ab", "!?", "漢", "lorem ipsum "])
def test_memory_does_not_grow_with_a_text(unit):
    import tracemalloc

    own = bpe.Tokenizer(WORD)
    peaks = []
    for times in (40_000, 200_000):
        tracemalloc.start()
        decoder, n = bpe.IdDecoder(own), 0
        piece = unit * 2000
        for ids in own.stream(piece for _ in range(times // 2000 // len(unit))):
            n += len(decoder.feed(ids))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert n > 0 and peaks[1] < 1.3 * peaks[0] + 100_000


def test_kept_maps_are_bounded_in_bytes():
    made = []
    kept = caches.Kept(lambda k: made.append(k) or k.encode(), "test", budget=40_000)
    for k in range(5000):
        assert kept.new[f"key {k}"] == f"key {k}".encode()
        assert kept.new["often"] == b"often"
    size = sum(caches._size(k) + caches._size(v) + caches.SLOT for g in (kept.new, kept.old) for k, v in g.items())
    assert size <= 40_000 and made.count("often") < 60 and len(made) >= 5000
    assert kept.new["x" * 300] == b"x" * 300 and "x" * 300 not in kept.new
    caches.enter("another")
    assert not kept.new and not kept.old


def test_lookahead_of_a_small_merge_list():
    merges = [("a", "b"), ("c", "ab"), ("d", "c")]
    length = {"a": 1, "b": 1, "c": 1, "d": 1, "ab": 2, "cab": 3, "dc": 2}
    # whether d joins c hinges on whether c joins ab, which hinges on b after a
    assert bpe.sufficient_lookahead(merges, length) >= 3


def test_decoder_holds_back_unfinished_characters():
    machine = bpe.Decoder()
    data = "aé漢😀".encode()
    assert "".join(machine.feed(bytes([b])) for b in data) + machine.end() == "aé漢😀"
    assert machine.feed(b"\xe6\xbc") == "" and machine.end() == "�"


def test_merges_made_of_later_tokens_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_encode_decode_rows(odd_docs, no_docs, all_plain):
    library = Library.from_file(WORD)
    got = bpe.encode_decode(odd_docs, WORD, keep_ids=True, keep_text=True).collect()
    want = []
    for doc_id, text in all_plain:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert bpe.encode_decode(no_docs, WORD).count() == 0


def test_counts_equal_the_library():
    library, counter = Library.from_file(BYTE), token_counts.Counter(BYTE, token_counts.frequent_lengths(BYTE, texts()[::3], 500))
    for text in texts():
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    assert 0 < counter.encoded <= counter.missed < counter.asked
    assert counter.frequent.counts.max() > 1  # counts, not a mere set


def test_compact_table_finds_what_it_holds():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))): rng.randint(0, 255) for _ in range(5000)}
    table = token_counts.CompactLengths(words)
    assert all(table.get(w) == n for w, n in words.items()) and table.get("not there") is None
    asked = [*words, *(w + "?" for w in words), ""]
    assert table.look_up([w.encode() for w in asked]).tolist() == [words.get(w, -1) for w in asked]
    assert table.look_up([]).tolist() == [] and token_counts.CompactLengths({}).look_up([b"x", b""]).tolist() == [-1, -1]
    # entries whose hashes are made to be alike are told apart by their bytes
    alike = token_counts.CompactLengths({"abc": 3, "abd": 4, "ab": 5})
    alike.hashes[:] = alike.hashes[0]
    assert alike.look_up([b"abd", b"abx"]).tolist()[1] == -1
    with pytest.raises(ValueError):
        token_counts.CompactLengths({"x": 256})


def test_count_rows(odd_docs, no_docs, all_plain):
    library = Library.from_file(BYTE)
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in all_plain]
    assert sorted(map(str, map(tuple, token_counts.count_tokens(odd_docs, BYTE).collect()))) == sorted(map(str, want))
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0


def test_shard_file_round_trip(tmp_path):
    rng, rows = random.Random(4), []
    for doc_id in sorted([None, -5, -5, *rng.sample(range(10**12), 500)], key=lambda d: (d is not None, d or 0)):
        rows.append((doc_id, np.array([rng.randint(0, 70_000) for _ in range(rng.choice([0, 1, 3, 400]))], "<u4")))
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        writer = sstable.Writer(f, block=4096)
        for doc_id, ids in rows:
            writer.add(sstable.key_of(doc_id), ids)
        writer.close()
    with open(path, "rb") as f:
        reader = sstable.Reader(f, path.stat().st_size)
        assert len(reader.blocks) > 5 and reader.docs == len(rows)
        assert [(d, i.tolist()) for d, i in reader] == [(d, i.tolist()) for d, i in rows]
        for doc_id in {d for d, _ in rows}:
            assert [i.tolist() for i in reader.get(doc_id)] == [i.tolist() for d, i in rows if d == doc_id]
        missing = [d for d in rng.sample(range(10**12), 2000) if d not in {d for d, _ in rows}]
        assert all(reader.get(d) == [] for d in missing)
        assert sum(reader.may_hold(sstable.key_of(d)) for d in missing) < 60  # about 1 % pass the filter
    data = bytearray(path.read_bytes())
    data[100] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(sstable.Reader(f, path.stat().st_size))


def test_keys_ascend():
    with pytest.raises(ValueError):
        import io

        writer = sstable.Writer(io.BytesIO())
        writer.add(sstable.key_of(2), np.zeros(0, "<u4"))
        writer.add(sstable.key_of(1), np.zeros(0, "<u4"))


def test_shards_of_a_table(odd_docs, no_docs, all_plain):
    library, start, want = Library.from_file(WORD), 0, []
    for doc_id, text in sorted(all_plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    rows = sstable.round_trip(odd_docs, WORD, shards=3).collect()
    assert sorted(str(tuple(r)[:4]) for r in rows) == sorted(map(str, want))
    assert {r["doc_id"]: r["looked_up"] for r in rows if r["looked_up"] is not None} == {100: True}


def test_rows_that_repeat_an_id_have_one_order_over_all_shards(spark):
    """Rows of one id fill several shards; their order is that of the text's hash."""
    import xxhash

    rng = random.Random(8)
    texts_ = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(1, 9))) for _ in range(400)] + ["same"] * 300
    rows = sstable.round_trip(spark.createDataFrame([(200, t) for t in texts_], "doc_id long, text string").repartition(4), WORD, shards=5).orderBy("start").collect()
    library = Library.from_file(WORD)
    signed = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode(), 42), "big", signed=True)
    want = [zlib.crc32(np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for t in sorted(texts_, key=signed)]
    assert [r["ids_crc32"] for r in rows] == want and all(r["looked_up"] for r in rows)


def test_empty_shards(no_docs):
    assert sstable.round_trip(no_docs, WORD, shards=2).count() == 0


def test_words_go_to_the_library_many_at_a_time(monkeypatch):
    """Texts of many stretches have the library's ids; a call is not one word's."""
    monkeypatch.setattr(sstable, "STRETCH", 3000)
    words, library = sstable.LibraryWords(WORD, 2), Library.from_file(WORD)
    plain = "".join(c for c in map(chr, range(0x250)) if bpe.PLAIN.fullmatch(c))
    rng, calls = random.Random(9), []
    mixed = [None, *texts(), *["".join(rng.choice(plain) for _ in range(90)) for _ in range(300)], "it's 'tis DON'T 12ab3 a--b"]
    for text, ids in zip(mixed, words.encoded(mixed), strict=True):
        assert ids.tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text

    class Counted:
        def encode(self, text, **kw):
            calls.append(text)
            return library.encode(text, **kw)

    words.cut = words.library = Counted()
    many = [" ".join(f"{a}{b}{c}," for b in "etaoin" for c in "shrdlu") for a in "abcdefghijklmnopq"]
    assert len(list(words.encoded(many))) == len(many) and 0 < len(calls) < 40  # of 612 words
    assert list(words.encoded([])) == []


def test_a_tokenizer_goes_when_another_operator_begins():
    tok = bpe.opened(WORD)
    assert bpe.opened(WORD) is tok
    caches.enter("another")
    assert bpe.opened(WORD) is not tok
