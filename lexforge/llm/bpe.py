"""BPE encoding as a bounded-lookahead streaming transducer, and decoding as an
incremental byte-to-text state machine.

A merge list has a *sufficient lookahead*: a number of symbols such that text
further to the right cannot move a token boundary. The transducer reads a
pre-token piece by piece, keeps that many symbols and the unfinished token, and
emits a token once it lies before the lookahead; its memory does not depend on
the length of the text. Pre-tokens, the normaliser and special tokens are those
of the tokenizer file.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from lexforge.llm.caches import BUDGET, Kept, enter, held

#: Symbols of a pre-token that are fed to the transducer at a time.
FEED = 1024
#: Characters of a text that are fed to the encoder at a time, and those of one
#: pre-token that it holds before it opens a transducer for it.
SLICE, HOLD = 1 << 16, 4096


def byte_alphabet() -> list[str]:
    """The printable character that byte-level tokenizers use for each byte.

    Printable Latin-1 bytes stand for themselves, the others for the
    characters from 256 on, in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    own_set = set(own)
    return [chr(b) if b in own_set else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols to the right of a boundary after which no text can move it.

    What happens at a position can only depend on the text to its right through
    a chain of merges of rising rank: a merge of (x, y) may hinge on whether y
    is still there, which in turn hinges on a merge of lower rank at y's right
    end. ``reach[t]`` is the most symbols that such a chain, all of whose ranks
    exceed the present one, passes to the left of the left edge of a token t
    that is in doubt. Ranks are walked downwards, so each rule is looked at
    once. The product of a merge must be made of tokens of lower rank, as in
    every trained merge list.
    """
    reach: dict[str, int] = {}
    most = 0
    for left, right in reversed(merges):
        both = reach.get(left + right, 0)
        through = length[left] + max(reach.get(left, 0), both)
        if through > reach.get(right, 0):
            reach[right] = through
        if both > reach.get(left, 0):
            reach[left] = both
        most = max(most, through)
    return most + max(length.values(), default=1)


class Merges:
    """Vocabulary and ranked merges; encodes and streams symbols of one pre-token."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.vocab = vocab
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            made.setdefault(a + b, rank)
        for rank, (a, b) in enumerate(merges):
            if made.get(a, -1) >= rank or made.get(b, -1) >= rank:
                raise ValueError("a merge uses a token that is made later")
            self.pair.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.product = [vocab[a + b] for a, b in merges]
        self.none = (len(merges), -1)
        size = {t: len(t[: -len(suffix)] if suffix and t.endswith(suffix) and t != suffix else t) for t in vocab}
        self.width = {vocab[t]: n for t, n in size.items()}
        self.lookahead = sufficient_lookahead(merges, size)

    def symbols(self, chars: str, last: bool) -> list[int]:
        v = self.vocab
        out = [v[c] for c in (chars[:-1] if last and self.suffix else chars)]
        if last and self.suffix and chars:
            out.append(v[chars[-1] + self.suffix])
        return out

    def merged(self, ids: list[int]) -> list[int]:
        """All merges of a list of symbols, lowest rank first, leftmost first."""
        pair = self.pair
        if len(ids) <= 64:
            get, none, product = pair.get, self.none, self.product
            never, ids = none[0], ids[:]
            ranks = [get(p, none)[0] for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) != never:
                k = ranks.index(best)
                ids[k] = new = product[best]
                del ids[k + 1], ranks[k]
                if k < len(ranks):
                    ranks[k] = get((new, ids[k + 1]), none)[0]
                if k:
                    ranks[k - 1] = get((ids[k - 1], new), none)[0]
            return ids
        n = len(ids)
        ids = ids[:]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(got[0], k, ids[k], ids[k + 1], got[1]) for k in range(n - 1) if (got := pair.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, new = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j >= n or ids[k] != a or ids[j] != b:
                continue
            ids[k], alive[j], after[k] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (got := pair.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (got[0], x, ids[x], ids[y], got[1]))
        return [t for t, ok in zip(ids, alive) if ok]

    def stream(self, pieces: Iterable[str]) -> Iterator[int]:
        """Token ids of one pre-token that comes in pieces."""
        machine = Transducer(self)
        for piece in pieces:
            yield from machine.feed(piece)
        yield from machine.end()


class Transducer:
    """Encodes the symbols of one pre-token as they come.

    Holds at most one piece and twice the lookahead. A token is emitted when it
    and the lookahead after it have been read; the last symbol is always held,
    since it alone may carry the word end.
    """

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, ""

    def feed(self, chars: str) -> list[int]:
        merges = self.merges
        self.held += chars
        if len(self.held) <= 2 * merges.lookahead + 1:
            return []
        stable, at, out = len(self.held) - 1 - merges.lookahead, 0, []
        for t in merges.merged(merges.symbols(self.held[:-1], False)):
            if at + merges.width[t] > stable:
                break
            at += merges.width[t]
            out.append(t)
        self.held = self.held[at:]
        return out

    def end(self) -> list[int]:
        held, self.held = self.held, ""
        return self.merges.merged(self.merges.symbols(held, True)) if held else []


class Decoder:
    """Bytes to text as they come: holds back the bytes of an unfinished character.

    Ill-formed bytes become U+FFFD, one for each maximal ill-formed part.
    """

    def __init__(self):
        import codecs

        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._state.decode(data)

    def end(self) -> str:
        return self._state.decode(b"", True)


#: Characters for which Python's and the tokenizer file's classes agree.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")
#: The pre-token pattern of files without one of their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


LETTER, NUMBER, SPACE, OTHER = (regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+"))
_UNKNOWN: list[regex.Pattern] = []


def _unknown() -> regex.Pattern:
    """Characters that this Python's tables do not know: the library may class
    them otherwise than the regex module does."""
    if not _UNKNOWN:
        free = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
        starts = [c for k, c in enumerate(free) if not k or free[k - 1] != c - 1]
        ends = [c for k, c in enumerate(free) if k + 1 == len(free) or free[k + 1] != c + 1]
        _UNKNOWN.append(regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]"))
    return _UNKNOWN[0]


class Tokenizer:
    """A byte-level BPE tokenizer file, read by its own description."""

    def __init__(self, path: str, budget: int = BUDGET):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.path = path
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] for t in file["added_tokens"]):
            raise ValueError("special tokens with stripping, normalising or spaces are not supported")
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.margin = max(map(len, self.special), default=1) - 1
        steps = _steps(file["normalizer"], "normalizers")
        if not {s["type"] for s in steps} <= {"NFC", "Lowercase", "Replace"}:
            raise ValueError("unknown normaliser")
        self.steps = [(s["type"], regex.compile(s["pattern"]["Regex"]) if s["type"] == "Replace" else None, s.get("content")) for s in steps]
        self.lower = any(s[0] == "Lowercase" for s in self.steps)
        pre = _steps(file["pre_tokenizer"], "pretokenizers")
        own = [s for s in pre if s["type"] == "Split"]
        if own and not (own[0]["behavior"] == "Removed" and own[0]["invert"]):
            raise ValueError("unknown pre-tokenizer")
        self.pattern = regex.compile(own[0]["pattern"]["Regex"] if own else BYTE_LEVEL)
        self.by_word = bool(own) and any(s[0] == "Replace" for s in self.steps)  # white space only parts words
        self.alphabet = byte_alphabet()
        self.table = {i: c for i, c in enumerate(self.alphabet)}
        self.byte_decoder = bool(file["decoder"]) and file["decoder"]["type"] == "ByteLevel"
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        back = {c: bytes([b]) for b, c in enumerate(self.alphabet)}
        self.bytes = [b"".join(back.get(c, c.encode()) for c in t) if i not in self.special.values() else t.encode() for i, t in enumerate(self.names)]
        self.library: Library | None = None
        self.stand_ins: dict[str, str] = {}
        #: Ids of pre-tokens, and of words that are several.
        self.known = Kept(self._word, path, budget)

    def symbols_of(self, text: str) -> str:
        return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table)

    def _pretoken(self, text: str) -> bytes:
        """Ids (little-endian, 32 bits) of one pre-token, from the transducer."""
        chars, machine = self.symbols_of(text), Transducer(self.merges)
        ids = machine.feed(chars) if len(chars) <= FEED else [t for at in range(0, len(chars), FEED) for t in machine.feed(chars[at : at + FEED])]
        return array("I", ids + machine.end()).tobytes()

    def _word(self, text: str) -> bytes:
        """Ids of a stretch of normalised text that is cut into pre-tokens."""
        pieces = self.cut(text)
        if len(pieces) == 1:
            return self._pretoken(pieces[0])
        known = self.known.new
        return b"".join([known[p] for p in pieces])

    def shadow(self, text: str) -> str:
        """The text with a stand-in of the library's class for each character
        that Python's tables lack."""
        if PLAIN.fullmatch(text) or not (odd := set(_unknown().findall(text))):
            return text
        for c in odd - self.stand_ins.keys():
            self.library = self.library or Library.from_file(self.path)
            joins = [len(self.library.pre_tokenizer.pre_tokenize_str(before + c)) == 1 for before in ("a", "!")]
            self.stand_ins[c] = "a" if joins[0] else "!" if joins[1] else "1"
        return text.translate({ord(c): self.stand_ins[c] for c in odd})

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a normalised text."""
        shadow = self.shadow(text)
        return self.pattern.findall(text) if shadow is text else [text[m.start() : m.end()] for m in self.pattern.finditer(shadow)]

    def normalized(self, text: str) -> str:
        for kind, pattern, content in self.steps:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = pattern.sub(content, text)
            else:
                text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        if self.steps and not PLAIN.fullmatch(text) and (odd := set(_unknown().findall(text))):
            self.library = self.library or Library.from_file(self.path)
            text = text.translate({ord(c): self.library.normalizer.normalize_str(c) for c in odd})
        return text

    def plain(self, text: str) -> bytes:
        """Ids of a piece of text that no pre-token crosses, without special tokens."""
        if self.by_word:
            if PLAIN.fullmatch(text):
                words = (text.lower() if self.lower else text).split()
            else:
                words = self.normalized(text).split(" ")
            known = self.known.new
            return b"".join([known[w] for w in words])
        known = self.known.new
        return b"".join([known[p] for p in self.cut(self.normalized(text))])

    def stream(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids of a text that comes in pieces, in parts of bounded size."""
        machine = Encoder(self)
        for piece in pieces:
            yield machine.feed(piece)
        yield machine.end()

    def slices(self, text: str | None) -> Iterator[bytes]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, in
        parts. Null counts as empty. The strings of special tokens become their ids."""
        text = text or ""
        return self.stream(text[at : at + SLICE] for at in range(0, len(text), SLICE))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.slices(text))

    def decode(self, ids: bytes) -> Iterator[str]:
        """The text of ids, in parts of bounded length, special tokens included."""
        machine = IdDecoder(self)
        for at in range(0, len(ids), SLICE):
            yield machine.feed(ids[at : at + SLICE])
        yield machine.end()


def safe_cut(text: str) -> int:
    """The last place in a text that no pre-token, special token or composed
    character crosses: before a single space with characters on both sides (0:
    none)."""
    at = text.rfind(" ", 1, len(text) - 1)
    while at > 0 and (text[at - 1].isspace() or text[at + 1].isspace()):
        at = text.rfind(" ", 1, at)
    return max(at, 0)


def inert_cut(text: str, at: int) -> int:
    """The last place up to ``at`` where normalising may be cut: before a
    character that does not join the one before it."""
    while at > 0 and (unicodedata.category(text[at])[0] == "M" or 0x1160 <= ord(text[at]) <= 0x11FF):
        at -= 1
    return at


class Encoder:
    """Encodes a text as it comes, in memory that does not grow with it.

    What lies before a safe cut is encoded at once. A stretch without one, as a
    pre-token of millions of letters, is normalised and cut as it comes: a
    pre-token that is longer than ``HOLD`` is handed to a transducer of its own
    while it goes on. (Only a run of combining marks without end is held
    whole, since their order is settled at its end.)
    """

    def __init__(self, tok: Tokenizer):
        self.tok, self.raw, self.norm = tok, "", ""
        self.run: tuple[regex.Pattern, Transducer] | None = None

    def feed(self, text: str) -> bytes:
        tok, out = self.tok, []
        text = self.raw + text
        while m := tok.specials.search(text):
            out += [self._close(text[: m.start()]), tok.special[m[0]].to_bytes(4, "little")]
            text = text[m.end() :]
        if cut := safe_cut(text):
            out.append(self._close(text[:cut]))
            text = text[cut:]
        if len(text) > HOLD and (cut := inert_cut(text, len(text) - 1 - tok.margin)):
            out.append(self._grind(text[:cut], False))
            text = text[cut:]
        self.raw = text
        return b"".join(out)

    def end(self) -> bytes:
        text, self.raw = self.raw, ""
        out = []
        while m := self.tok.specials.search(text):
            out += [self._close(text[: m.start()]), self.tok.special[m[0]].to_bytes(4, "little")]
            text = text[m.end() :]
        return b"".join([*out, self._close(text)])

    def _close(self, text: str) -> bytes:
        """The rest of a stretch: no pre-token goes on after it."""
        return self._grind(text, True) if self.norm or self.run else self.tok.plain(text)

    def _run(self, chars: str) -> bytes:
        tok, machine = self.tok, self.run[1]
        symbols = tok.symbols_of(chars)
        return np.array([t for at in range(0, len(symbols), FEED) for t in machine.feed(symbols[at : at + FEED])], "<u4").tobytes()

    def _grind(self, text: str, last: bool) -> bytes:
        tok, out, at = self.tok, [], 0
        text = self.norm + tok.normalized(text)
        shadow = tok.shadow(text)
        if self.run:
            at = self._extent(shadow, 0, self.run[0], last)
            out.append(self._run(text[:at]))
            if at >= len(text) - 1 and not last:  # it may go on
                self.norm = text[at:]
                return b"".join(out)
            out.append(np.array(self.run[1].end(), "<u4").tobytes())
            self.run = None
        known, rest = tok.known.new, None
        for m in tok.pattern.finditer(shadow, at):
            if not last and m.end() > len(text) - 3:
                rest = m
                break
            out.append(known[text[m.start() : m.end()]])
            at = m.end()
        if last:
            self.norm = ""
            return b"".join(out)
        if rest and rest.end() - rest.start() > HOLD:
            kind = next(k for k in (LETTER, NUMBER, SPACE, OTHER) if k.match(shadow[rest.end() - 1]))
            self.run = (kind, Transducer(tok.merges))
            at = self._extent(shadow, rest.start() + (shadow[rest.start()] == " " and kind is not SPACE), kind, False)
            out.append(self._run(text[rest.start() : at]))
        self.norm = text[at:]
        return b"".join(out)

    @staticmethod
    def _extent(shadow: str, at: int, kind: regex.Pattern, last: bool) -> int:
        """Where a run of one class ends. The last white space before another
        character starts the next pre-token, so it is held back."""
        m = kind.match(shadow, at)
        end = m.end() if m else at
        return end - 1 if kind is SPACE and end > at and not (last and end == len(shadow)) else end


class IdDecoder:
    """Ids to text as they come.

    Files with a byte-level decoder give their tokens' bytes through the state
    machine; files without one give the tokens themselves, parted by a space.
    """

    def __init__(self, tok: Tokenizer):
        self.tok, self.machine, self.first = tok, Decoder(), True

    def feed(self, ids: bytes) -> str:
        part = np.frombuffer(ids, "<u4").tolist()
        if not part:
            return ""
        if self.tok.byte_decoder:
            return self.machine.feed(b"".join([self.tok.bytes[i] for i in part]))
        names = self.tok.names
        text = ("" if self.first else " ") + " ".join([names[i] for i in part])
        self.first = False
        return self.machine.feed(text.encode("utf-8"))

    def end(self) -> str:
        return self.machine.end()


def _steps(part: dict | None, name: str) -> list[dict]:
    return [] if not part else part[name] if part["type"] == "Sequence" else [part]


#: Rows that are given back at a time, so that ids and texts of a whole batch are never held together.
PART = 256


def opened(path: str) -> Tokenizer:
    """The tokenizer of a file, read once by each worker and kept until another operator's task begins."""
    enter(path)
    return held(path, "tokenizer", lambda: Tokenizer(path))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode each whole text, decode the ids again: (id_col, n_tokens,
    ids_sha256, decoded_sha256[, token_ids][, decoded]).

    ``ids_sha256`` is that of the ids as little-endian unsigned 32-bit
    integers, ``decoded_sha256`` that of the decoded text in UTF-8. A narrow
    map over the rows: no shuffle. A text is fed to the encoder in slices, and
    its ids to the digest and the decoder as they come; besides the batch, a
    worker holds a slice, the lookahead and its caches (``caches.BUDGET``).

    Defined results: null counts as empty, and an empty text has no tokens and
    decodes to nothing; null ids and repeated rows stay as they are; an empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = opened(path)
        for batch in (whole.slice(at, PART) for whole in batches for at in range(0, whole.num_rows, PART)):
            counts, shas, backs, lists, texts = array("q"), [], [], [], []
            for text in batch.column(1):
                sha, back, machine, n, ids_of, parts = hashlib.sha256(), hashlib.sha256(), IdDecoder(tok), 0, [], []
                for ids in tok.slices(text.as_py()):
                    sha.update(ids)
                    n += len(ids) // 4
                    part = machine.feed(ids)
                    back.update(part.encode("utf-8", "surrogatepass"))
                    if keep_ids:
                        ids_of.append(ids)
                    if keep_text:
                        parts.append(part)
                part = machine.end()
                back.update(part.encode("utf-8", "surrogatepass"))
                counts.append(n)
                shas.append(sha.hexdigest())
                backs.append(back.hexdigest())
                if keep_ids:
                    lists.append(np.frombuffer(b"".join(ids_of), "<i4"))
                if keep_text:
                    texts.append("".join([*parts, part]))
            columns = [batch.column(0), pa.array(np.frombuffer(counts, np.int64) if len(counts) else [], pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            columns += [pa.array(lists, pa.list_(pa.int32()))] * keep_ids + [pa.array(texts, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
