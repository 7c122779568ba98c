"""Token counts by a two-tier lookup on the map side.

Tier 1 is a compact hash table of the token counts of frequent pre-tokens. They
are counted on a bounded sample of rows, the table is built once on the driver
and broadcast; it has at most ``ENTRIES`` entries whatever the corpus. Tier 2
is a cache in each worker, bounded in bytes, filled by the tokenizer's library
for pre-tokens that tier 1 lacks. Nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter as Tally
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from lexforge.llm.bpe import BYTE_LEVEL, PLAIN
from lexforge.llm.caches import Kept, enter

#: Entries of tier 1 at most, and the sample that they are counted on: rows, and bytes of a row.
ENTRIES, SAMPLE_ROWS, SAMPLE_BYTES = 1 << 16, 2048, 1 << 15
#: Pre-tokens that tier 1 is asked for at a time.
LOOK_UP = 1 << 14


class CompactLengths:
    """Open-addressing hash table: UTF-8 string -> small count, in flat arrays.

    ``slots`` holds entry numbers (-1: free), ``hashes`` the whole hash of each
    entry; entries lie end to end in ``blob``. Strings are looked up many at a
    time: all probe together, and what a hash finds is compared byte by byte, so
    a collision cannot give a wrong count.
    """

    def __init__(self, counts: dict[str, int]):
        keys = [k.encode() for k in counts]
        if any(n > 255 for n in counts.values()):
            raise ValueError("a count does not fit")
        self.counts = np.array(list(counts.values()), np.uint8)
        self.blob = np.frombuffer(b"".join(keys), np.uint8)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        self.mask = np.uint64((1 << max(1, (2 * len(keys)).bit_length())) - 1)
        slots = [-1] * (int(self.mask) + 1)
        for n, h in enumerate((self.hashes & self.mask).tolist()):
            while slots[h] >= 0:
                h = (h + 1) & int(self.mask)
            slots[h] = n
        self.slots = np.array(slots, np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The count of each word, -1 where the table lacks it."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        entry = np.full(len(words), -1, np.int32)
        at, open_ = (h & self.mask).astype(np.int64), np.arange(len(words))
        while len(open_):
            n = self.slots[at[open_]]
            taken = n >= 0
            open_, n = open_[taken], n[taken]
            same = self.hashes[n] == h[open_]
            entry[open_[same]] = n[same]
            open_ = open_[~same]
            at[open_] = (at[open_] + 1) & int(self.mask)
        hit = np.flatnonzero(entry >= 0)
        if not len(hit):
            return np.full(len(words), -1, np.int16)
        # the bytes of what was found, against those of the entries
        length = np.fromiter(map(len, words), np.int64, len(words))
        fits = length[hit] == self.lengths[entry[hit]]
        entry[hit[~fits]] = -1
        hit = hit[fits]
        size = length[hit]
        ends = np.cumsum(size)
        spread = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        text = np.frombuffer(b"".join(words), np.uint8)
        own = text[spread + np.repeat((np.cumsum(length) - length)[hit], size)]
        apart = own != self.blob[spread + np.repeat(self.starts[entry[hit]], size)]
        if apart.any():
            entry[hit[np.unique(np.searchsorted(ends, np.flatnonzero(apart), side="right"))]] = -1
        return np.where(entry >= 0, self.counts[np.maximum(entry, 0)].astype(np.int16), np.int16(-1))

    def get(self, key: str) -> int | None:
        n = int(self.look_up([key.encode("utf-8", "surrogatepass")])[0])
        return None if n < 0 else n

    def __len__(self) -> int:
        return len(self.counts)


class Cutter:
    """Cuts texts into special tokens and pre-tokens by the library's rules.

    Plain stretches are cut by the rules' pattern, others by the library's own
    pre-tokenizer, whose tables of characters may be of another age than the
    regex module's.
    """

    def __init__(self, path: str):
        self.library = Library.from_file(path)
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.pattern = regex.compile(BYTE_LEVEL)

    def stretches(self, text: str) -> Iterator[tuple[list[str], int]]:
        """(pre-tokens, special tokens after them) of each stretch of a text."""
        at = 0
        for m in self.special.finditer(text):
            yield self.pieces(text[at : m.start()]), 1
            at = m.end()
        yield self.pieces(text[at:] if at else text), 0

    def pieces(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def lengths(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(words, add_special_tokens=False)]


def frequent_lengths(path: str, texts: Iterable[str], entries: int = ENTRIES) -> CompactLengths:
    """Tier 1: the most frequent pre-tokens of some texts (ties: by the string),
    with the counts that the library gives them."""
    cutter, seen = Cutter(path), Tally()
    for text in texts:
        for pieces, _ in cutter.stretches(text):
            seen.update(pieces)
    words = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    return CompactLengths({w: n for w, n in zip(words, cutter.lengths(words)) if n < 256})


class Counter:
    """Counts the tokens of texts as the library would.

    ``frequent`` is asked first, for up to ``LOOK_UP`` pre-tokens at a time;
    what it lacks goes to ``tier2``, and what that lacks to the library.
    ``asked`` counts the pre-tokens, ``missed`` those that tier 1 lacked and
    ``encoded`` those that the library encoded.
    """

    def __init__(self, path: str, frequent: CompactLengths):
        self.cutter, self.frequent = Cutter(path), frequent
        self.asked = self.missed = self.encoded = 0
        self.tier2 = Kept(self._encode, "counts")

    def _encode(self, pretoken: str) -> int:
        self.encoded += 1
        return len(self.cutter.library.encode(pretoken, add_special_tokens=False).ids)

    def _sum(self, pieces: list[str]) -> int:
        found = self.frequent.look_up([p.encode("utf-8", "surrogatepass") for p in pieces])
        lacking = np.flatnonzero(found < 0)
        self.asked += len(pieces)
        self.missed += len(lacking)
        return int(found.sum(dtype=np.int64)) + len(lacking) + sum([self.tier2.new[pieces[k]] for k in lacking.tolist()])

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null counts as empty."""
        total = 0
        for pieces, special in self.cutter.stretches(text or ""):
            total += special + sum(self._sum(pieces[at : at + LOOK_UP]) for at in range(0, len(pieces), LOOK_UP))
        return total


_OPEN: dict[str, tuple[str, Counter]] = {}


def sampled(docs: DataFrame, text_col: str = "text") -> list[str]:
    """Texts to count frequent pre-tokens on: at most ``SAMPLE_ROWS`` of at most
    ``SAMPLE_BYTES`` each, drawn over the whole table. They only decide what
    tier 1 holds, never a count."""
    rows = docs.count()
    if not rows:
        return []
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    drawn = texts.sample(min(1.0, SAMPLE_ROWS / rows), seed=5) if rows > SAMPLE_ROWS else texts
    return [r[0] for r in drawn.filter(F.octet_length("text") <= SAMPLE_BYTES).limit(SAMPLE_ROWS).collect()]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each whole text.

    ``path`` is a byte-level BPE file of the tokenizers library without a
    pattern of its own. A narrow map over the rows: no shuffle.

    Defined results: null counts as empty (0 bytes, 0 tokens); special strings
    inside a text are one token each, as the library's default; null ids and
    repeated rows stay; an empty table gives an empty result; other columns are
    ignored.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path, sampled(docs, text_col)))
    kind, run_id = docs.schema[id_col].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("counts")
        if _OPEN.get(path, ("",))[0] != run_id:  # one table at a time
            for _, before in _OPEN.values():
                before.tier2.clear()
            _OPEN.clear()
            _OPEN[path] = (run_id, Counter(path, table.value))
        counter = _OPEN[path][1]
        for batch in batches:
            counts = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
