"""Token ids as sorted-string-table shards.

A shard file holds documents in ascending order of their key:

    data blocks   prefix-compressed entries, a restart every 16
    index block   first key, offset and length of each data block
    Bloom filter  k bits of a double hash for each distinct key
    footer        offsets and lengths of the two, counts, ids before this shard, magic

A key is the identifier as an order-preserving byte string and a value the
ids, so a reader finds a document with one look at the filter, a binary search
of the index and the scan of one block. Shards are cut by ranges of the key.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.bpe import PLAIN
from lexforge.llm.caches import enter
from lexforge.llm.shared import new_folder, opened_store, parts_for, written

MAGIC = b"LFSSTB01"
FOOTER = struct.Struct("<QQQQQQ8s")
RESTART = 16
BLOCK = 64 << 10
#: Characters of texts whose distinct words are encoded together, and pre-tokens in one call of the library.
STRETCH, AT_ONCE = 16 << 20, 64


def key_of(doc_id: int | None) -> bytes:
    """Order-preserving bytes of an identifier; null sorts first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def pack_ids(ids: np.ndarray) -> bytes:
    """One byte for the width (2 or 4), then the ids, little-endian."""
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" + ids.astype("<u2").tobytes()) if narrow else (b"\4" + ids.astype("<u4").tobytes())


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1)


class Writer:
    """Writes one shard to a file object; keys must come in ascending order."""

    def __init__(self, out, block: int = BLOCK, bits: int = 10):
        self.out, self.block, self.bits = out, block, bits
        self.buffer, self.restarts, self.entries, self.last, self.first = bytearray(), [], 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self.at = self.docs = self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.docs and key < self.last:
            raise ValueError("keys must ascend")
        if not self.hashes or key != self.last:
            self.hashes.append(xxhash.xxh64_intdigest(key))
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.buffer))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if not self.entries:
            self.first = key
        value = pack_ids(ids)
        self.buffer += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries, self.docs, self.tokens = key, self.entries + 1, self.docs + 1, self.tokens + len(ids)
        if len(self.buffer) >= self.block:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.entries:
            data = bytes(self.buffer) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<II", len(self.restarts), zlib.crc32(self.buffer))
            self.index.append((self.first, *self._put(data)))
            self.buffer, self.restarts, self.entries = bytearray(), [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        index_at = self._put(index)
        size = max(64, len(self.hashes) * self.bits)
        probes = max(1, round(self.bits * 0.69))
        bloom = np.zeros((size + 7) // 8 * 8, bool)
        if self.hashes:
            h = np.array(self.hashes, np.uint64)
            step = (h >> np.uint64(17)) | (h << np.uint64(47)) | np.uint64(1)
            for k in range(probes):
                bloom[((h + np.uint64(k) * step) % np.uint64(len(bloom))).astype(np.int64)] = True
        bloom_at = self._put(bytes([probes]) + np.packbits(bloom).tobytes())
        self._put(FOOTER.pack(*index_at, *bloom_at, self.docs, self.tokens, MAGIC))


class Reader:
    """Reads one shard: all entries in order, or one key by binary search."""

    def __init__(self, source, size: int):
        self.source = source
        *numbers, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        index_at, index_n, bloom_at, bloom_n, self.docs, self.tokens = numbers
        self.keys, self.blocks = [], []
        data, at = self._at(index_at, index_n), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            self.keys.append(data[at : at + n])
            self.blocks.append(struct.unpack("<QQ", data[at + n : at + n + 16]))
            at += n + 16
        bloom = self._at(bloom_at, bloom_n)
        self.probes, self.bloom = bloom[0], bloom[1:]

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data = self._at(*self.blocks[block])
        restarts, crc = struct.unpack("<II", data[-8:])
        body = data[: len(data) - 8 - 4 * restarts]
        if zlib.crc32(body) != crc:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in range(len(self.blocks)):
            for key, value in self._entries(b):
                yield id_of(key), unpack_ids(value)

    def may_hold(self, key: bytes) -> bool:
        h, m = xxhash.xxh64_intdigest(key), (1 << 64) - 1
        step = (h >> 17 | h << 47) & m | 1
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in (((h + k * step) & m) % (len(self.bloom) * 8) for k in range(self.probes)))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all rows with this identifier (none: an empty list)."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        at = max(0, bisect.bisect_left(self.keys, key) - 1)
        while at < len(self.keys) and self.keys[at] <= key:
            out += [unpack_ids(v) for k, v in self._entries(at) if k == key]
            at += 1
        return out


def _laid(ids: np.ndarray, counts: np.ndarray, of: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """The ids of the entries ``of``, end to end; entry n has ``counts[n]`` of ``ids``."""
    first = np.cumsum(counts) - counts if first is None else first
    many = counts[of]
    return ids[np.arange(many.sum()) + np.repeat(first[of] - (np.cumsum(many) - many), many)]


class LibraryWords:
    """Encodes with the tokenizers library, each distinct word of a stretch once.

    For files whose pre-tokenizer drops white space, a text is its words. Texts
    are taken ``STRETCH`` characters at a time: Arrow numbers the distinct words,
    the library encodes their pre-tokens many in a call, and the ids are laid out
    by the words' numbers, so nothing is kept from stretch to stretch. Texts with
    special tokens or characters outside the plain ones go to the library whole.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer as Library
        from tokenizers import pre_tokenizers

        self.library, self.end = Library.from_file(path), [] if end_id is None else [end_id]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        steps = file["pre_tokenizer"].get("pretokenizers") or [file["pre_tokenizer"]]
        rules = (file["normalizer"] or {}).get("normalizers", [file["normalizer"]])
        own, suffix = [s for s in steps if s["type"] == "Split"], file["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and [r and r["type"] for r in rules] == ["NFC", "Replace", "Lowercase"] and len(own) == 1 and own[0]["behavior"] == "Removed" and own[0]["invert"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in file["added_tokens"]) or "(?!)")
        if self.by_word:
            self.pattern = regex.compile(own[0]["pattern"]["Regex"])
            # for words that are normalised and cut: only the byte alphabet and the merges are left
            self.cut = Library.from_file(path)
            self.cut.normalizer = None
            self.cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = file["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain lower-case words laid end to end, and how many each has."""
        pretokens, pieces_of = [], np.ones(len(words), np.int64)
        for n, w in enumerate(words):
            if w.isalpha():
                pretokens.append(w)
            else:
                pieces = self.pattern.findall(w)
                pieces_of[n] = len(pieces)
                pretokens += pieces
        numbered = pa.array(pretokens, pa.string()).dictionary_encode()
        distinct, of = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        calls = [" ".join(distinct[at : at + AT_ONCE]) for at in range(0, len(distinct), AT_ONCE)]
        ids = np.concatenate([np.zeros(0, "<u4"), *[np.array(self.cut.encode(c, add_special_tokens=False).ids, "<u4") for c in calls]])
        ends = np.flatnonzero(self.ends[ids]) + 1  # a pre-token's last token carries the word end
        if len(ends) != len(distinct):
            raise ValueError("a pre-token has no token of a word end")
        counts = np.diff(ends, prepend=0)
        of_words = np.concatenate([[0], np.cumsum(counts[of])])[np.cumsum(pieces_of)]
        return _laid(ids, counts, of), np.diff(of_words, prepend=0)

    def encoded(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, with the end id."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= STRETCH:
                yield from self._stretch(held)
                held, size = [], 0
        yield from self._stretch(held)

    def _stretch(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [self.by_word and bool(PLAIN.fullmatch(t)) and not self.special.search(t) for t in texts]
        words = pc.ascii_split_whitespace(pa.array([t.lower() if ok else "" for t, ok in zip(texts, plain)], pa.large_string()))  # empty words have no pre-token
        numbered = words.flatten().dictionary_encode()
        ids, counts = self._words(numbered.dictionary.to_pylist()) if self.by_word else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        of, starts, first = numbered.indices.to_numpy(), words.offsets.to_numpy(), np.cumsum(counts) - counts
        for n, (text, ok) in enumerate(zip(texts, plain)):
            out = _laid(ids, counts, of[starts[n] : starts[n + 1]], first) if ok else self._whole(text)
            yield np.append(out, self.end).astype("<u4")

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encoded([text]))


_WORDS: dict[tuple[str, int | None], LibraryWords] = {}


def _words(path: str, end_id: int | None) -> LibraryWords:
    """The encoder of a file, kept by each worker from task to task."""
    enter("sstable")
    if (path, end_id) not in _WORDS:
        _WORDS[path, end_id] = LibraryWords(path, end_id)
    return _WORDS[path, end_id]


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int | None = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write ``docs`` to shard files in ``folder``; returns the
    manifest (shard, file, size, n_docs, n_tokens), one row for each file.

    Shards are ranges of the identifier, so shard order and order within a
    shard give ascending identifiers over all files. A task writes to a name of
    its own and then renames, so a task that is run again leaves whole files.
    ``folder`` must be one that all executors see.
    """
    shards = shards or parts_for(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        words, writer, out = _words(path, end_id), None, None
        store, base = opened_store(folder)
        shard = TaskContext.get().partitionId()
        name, draft = f"{base}/shard-{shard:06d}.sst", f"{base}/_draft-{uuid.uuid4().hex}"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encoded(t.as_py() for t in batch.column(1))):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(draft)
                    writer = Writer(out)
                writer.add(key_of(doc_id), ids)
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "size": [writer.at], "n_docs": [writer.docs], "n_tokens": [writer.tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows that repeat an id are ordered by a hash of their text, within shards as across them; a number parts equal rows
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(shards, *order, F.col("n")).sortWithinPartitions(*order, "text").select("id", "text")
    return dealt.mapInArrow(run, "shard long, file string, size long, n_docs long, n_tokens long")


#: Identifiers divisible by this are also looked up by their key when a shard is read.
LOOK_UP = 100


def read_shards(manifest: DataFrame, folder: str, id_col: str = "doc_id") -> DataFrame:
    """Read shard files again: (id_col, start, n_tokens, ids_crc32, looked_up),
    with ``start`` the ids of all documents before a document.

    Identifiers divisible by ``LOOK_UP`` are also looked up by their key, through
    the Bloom filter, the block index and one block: ``looked_up`` says whether
    that gave the same ids, and is null for the others.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = opened_store(folder)
        for frame in frames:
            for file, size, start in zip(frame["file"], frame["size"], frame["before"]):
                start, rows = int(start), []
                with store.open_input_file(file) as source, store.open_input_file(file) as again:
                    by_key = Reader(again, int(size))
                    for doc_id, ids in Reader(source, int(size)):
                        asked = doc_id is not None and doc_id % LOOK_UP == 0
                        same = any(np.array_equal(ids, x) for x in by_key.get(doc_id)) if asked else None
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), same))
                        start += len(ids)
                        if len(rows) >= 20_000:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    n = max(1, manifest.count())
    return files.repartition(n, "shard").mapInPandas(run, "id long, start long, n_tokens long, ids_crc32 long, looked_up boolean").withColumnRenamed("id", id_col)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32", "looked_up"])
    return out.astype({"id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64", "looked_up": "boolean"})


def round_trip(docs: DataFrame, path: str, end_id: int | None = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards to the shared folder and read them back.

    Defined results: null and empty texts have only the end id; null ids come
    first, rows that repeat an id are ordered by XXH64 of their text; an
    empty table gives an empty result; other columns are ignored.
    """
    folder = new_folder(docs.sparkSession, "sstable")
    manifest = written(write_shards(docs, path, folder, end_id, shards, id_col, text_col), "manifest")
    return read_shards(manifest, folder, id_col)
