"""TIFF media columns.

Reads the image directories of a file, decodes PackBits, LZW or deflate strips
and tiles, undoes predictors, and gives one row for each page; writes such
files as well, so that any bytes can be stored as samples and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.caches import enter

# Fixed values of the format: tags, field types and their sizes, compressions.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}


class TiffError(ValueError):
    pass


def packbits_decode(data: bytes, most: int | None = None) -> bytes:
    """Stops at ``most`` bytes, or at most 127 beyond."""
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, at, start = bytearray(), 0, 0

    def literals(end: int) -> None:
        for k in range(start, end, 128):
            part = data[k : min(end, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            literals(at)
            out += bytes([257 - run, data[at]])
            at += run
            start = at
        else:
            at += run
    literals(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; the width
    grows one code early. Stops at ``most`` bytes, or less than 4,096 beyond."""
    left = len(data) * 4096 if most is None else most
    single = [bytes([b]) for b in range(256)] + [b"", b""]
    table, out = single[:], []
    width, held, bits, last = 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = single[:], 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("bad LZW code")
            entry = table[code]
        else:
            if code > len(table):
                raise TiffError("bad LZW code")
            entry = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:  # no code is longer than twelve bits
                table.append(last + entry[:1])
        out.append(entry)
        left -= len(entry)
        if left <= 0:
            break
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, width, code = {}, 9, -1
    put(256, 9)
    for byte in data:
        if code < 0:
            code = byte
            continue
        known = table.get((code, byte))
        if known is not None:
            code = known
            continue
        put(code, width)
        table[code, byte] = len(table) + 258
        code = byte
        if len(table) + 258 >= 4094:
            put(256, width)
            table, width = {}, 9
        elif len(table) + 258 >= 1 << width:
            width += 1
    if code >= 0:
        put(code, width)
        if len(table) + 259 >= 1 << width and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


#: Bytes of one page's samples at most; a larger page gives an error row.
MAX_PAGE = 1 << 30


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    layout: str
    pixels: np.ndarray  # height x width x samples


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("not a TIFF file")
    kind = struct.unpack_from(order + "H", data, 2)[0]
    if kind not in (42, 43):
        raise TiffError("not a TIFF file")
    big = kind == 43
    head, entry, pointer = ("Q", 20, "Q") if big else ("H", 12, "I")
    at, seen = struct.unpack_from(order + pointer, data, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + head, data, at)[0]
        at += struct.calcsize(head)
        tags: dict[int, tuple] = {}
        for k in range(n):
            base = at + k * entry
            tag, form = struct.unpack_from(order + "HH", data, base)
            count = struct.unpack_from(order + pointer, data, base + 4)[0]
            if form not in TYPE_CODE:
                continue
            place = base + 4 + struct.calcsize(pointer)
            if count * TYPE_SIZE[form] > struct.calcsize(pointer):
                place = struct.unpack_from(order + pointer, data, place)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{TYPE_CODE[form]}", data, place)
        yield order, tags
        at = struct.unpack_from(order + pointer, data, at + n * entry)[0]


def _unpacked(data: bytes, compression: int, need: int) -> bytes:
    """The bytes of a strip or tile; decoding stops at the ``need`` bytes of its size."""
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_decode(data, need)
    if compression == LZW:
        return lzw_decode(data, need)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, need)
    raise TiffError(f"compression {compression} is not supported")


def _row_bytes(columns: int, samples: int, bits: int) -> int:
    return (columns * samples * bits + 7) // 8


def _block(raw: bytes, rows: int, columns: int, samples: int, bits: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    need = rows * _row_bytes(columns, samples, bits)
    if len(raw) < need:
        raise TiffError("a strip or tile is too short")
    if bits < 8:  # rows begin at a byte; the first sample has the highest bits
        if predictor != 1:
            raise TiffError(f"predictor {predictor} is not supported with {bits} bits")
        ones = np.unpackbits(np.frombuffer(raw[:need], np.uint8).reshape(rows, -1), axis=1)[:, : columns * samples * bits].reshape(rows, columns, samples, bits)
        return (ones << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    if predictor == 3:
        # bytes of a row's numbers are apart by significance, and differences of bytes
        planes = np.cumsum(np.frombuffer(raw[:need], np.uint8).reshape(rows, columns * dtype.itemsize, samples) if samples > 1 else np.frombuffer(raw[:need], np.uint8).reshape(rows, columns * dtype.itemsize, 1), axis=1, dtype=np.uint8)
        parts = planes.reshape(rows, -1).reshape(rows, dtype.itemsize, columns * samples)
        return np.ascontiguousarray(parts.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(rows, columns, samples).astype(dtype.newbyteorder("="))
    out = np.frombuffer(raw[:need], dtype).reshape(rows, columns, samples)
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=dtype.newbyteorder("="))
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return out.astype(dtype.newbyteorder("="), copy=False)


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of their directories, one at a time."""
    for number, (order, tags) in enumerate(_directories(data)):
        one = lambda tag, default=None: tags.get(tag, (default,))[0]  # noqa: B023, E731
        width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if not width or not height or len(set(tags.get(BITS, (1,)))) > 1:
            raise TiffError("a page lacks its size, or its samples differ in size")
        form = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1), "u")
        if bits not in (1, 2, 4, 8, 16, 32, 64) or form == "f" and bits < 16 or bits < 8 and form != "u":
            raise TiffError(f"{bits} bits a sample are not supported")
        if not all(isinstance(n, int) and 0 < n for n in (width, height, samples)) or width * height * samples * max(8, bits) > MAX_PAGE * 8:
            raise TiffError(f"a page has no size, or one above {MAX_PAGE} bytes")
        dtype = np.dtype(f"{order}{form}{max(8, bits) // 8}")
        planar = one(PLANAR, 1) == 2 and samples > 1
        planes, depth = (samples, 1) if planar else (1, samples)
        tiled = TILE_OFFSETS in tags
        tall, wide = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
        if not all(isinstance(n, int) and 0 < n for n in (tall, wide)) or tall * wide * depth * max(8, bits) > MAX_PAGE * 8:
            raise TiffError("a page lacks the size of its strips or tiles, or it is too large")
        offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
        across, down = -(-width // wide), -(-height // tall)
        if min(len(offsets), len(counts)) < planes * across * down:
            raise TiffError("a page lacks strips or tiles")
        pixels = np.empty((height, width, samples), dtype.newbyteorder("="))
        for k in range(planes * across * down):
            plane, (y, x) = k // (across * down), divmod(k % (across * down), across)
            rows = tall if tiled else min(tall, height - y * tall)
            need = rows * _row_bytes(wide, depth, bits)
            got = _block(_unpacked(data[offsets[k] : offsets[k] + counts[k]], compression, need), rows, wide, depth, bits, dtype, predictor)
            y0, x0 = y * tall, x * wide
            h, w = min(rows, height - y0), min(wide, width - x0)
            if planar:
                pixels[y0 : y0 + h, x0 : x0 + w, plane] = got[:h, :w, 0]
            else:
                pixels[y0 : y0 + h, x0 : x0 + w] = got[:h, :w]
        yield Page(number, width, height, samples, bits, NAMES.get(compression, str(compression)), predictor, "tiles" if tiled else "strips", pixels)


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1])).astype(block.dtype)
    data = block.tobytes()
    return {NONE: lambda d: d, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[compression](data)


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int | None = None, strip_rows: int = 256, order: str = "<") -> bytes:
    """A file of 8- or 16-bit pages (height x width [x samples])."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    link = 4
    for pixels in pages:
        pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
        pixels = pixels.astype(pixels.dtype.newbyteorder(order))
        height, width, samples = pixels.shape
        offsets, counts = [], []
        tall, wide = (tile, tile) if tile else (strip_rows, width)
        for y in range(0, height, tall):
            for x in range(0, width, wide):
                block = pixels[y : y + tall, x : x + wide]
                if tile:
                    block = np.pad(block, ((0, tall - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                data = _packed(block, compression, predictor)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        shape = [(TILE_WIDTH, 4, [wide]), (TILE_LENGTH, 4, [tall]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [tall]), (STRIP_COUNTS, 4, counts)]
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [pixels.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor]), *shape]
        body = []
        for tag, form, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{TYPE_CODE[form]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, place = struct.pack(order + "I", len(out)), data
                out += place
            body.append(struct.pack(order + "HHI", tag, form, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(body)) + b"".join(body)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression string, predictor int, layout string, pixels binary, error string"


def pages(media: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row for each page of each file: (id_col, page, width, height,
    samples, bits, compression, predictor, layout, pixels, error).

    ``pixels`` are the samples in row order, little-endian. Defined results: a
    null file gives no row; a file that is empty or damaged gives one row with
    its ``error`` after the pages that could be read, and so does one with a page
    above ``MAX_PAGE`` bytes; samples of 1, 2 and 4 bits come one a byte; null ids and repeated
    rows stay; other columns are ignored.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in PAGE_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tiff")
        for batch in batches:
            for k in range(batch.num_rows):
                own, data, n = batch.column(0).slice(k, 1), batch.column(1)[k].as_py(), 0
                if data is None:
                    continue
                try:
                    for p in read_pages(data):
                        n = p.number + 1
                        little = p.pixels.astype(p.pixels.dtype.newbyteorder("<"), copy=False).tobytes()
                        yield _row(own, [p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.layout, little, None])
                except (TiffError, struct.error, zlib.error, LookupError, ValueError, TypeError, ArithmeticError, MemoryError) as e:
                    yield _row(own, [n, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"])

    types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string()]

    def _row(own: pa.Array, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([own, *(pa.array([v], t) for v, t in zip(values, types))], names=names)

    return media.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("m")).mapInArrow(run, f"id {kind}, {PAGE_SCHEMA}").withColumnRenamed("id", id_col)


#: Samples in a row of a stored text, and rows of a page.
ROW, PAGE_ROWS = 64, 16384


#: How payloads are stored, by the remainder of their CRC32: compression, predictor, tile size (None: strips). Most take
#: the first form; each other one takes one payload of ``SHARE``, as LZW and PackBits are written byte by byte here.
SHARE = 32
FORMS = [(DEFLATE, 2, None), (LZW, 1, None), (PACKBITS, 2, None), (DEFLATE, 1, ROW), (LZW, 2, ROW), (NONE, 1, None), (PACKBITS, 1, ROW)]


def stored(payload: bytes) -> bytes:
    """A payload (a multiple of 64 bytes) as 8-bit samples: rows of 64, pages of
    16,384 rows. A hash of the payload chooses among the codecs, predictors and
    layouts of ``FORMS``, so that equal texts are stored alike and a table takes
    every way through the reader."""
    compression, predictor, tile = dict(enumerate(FORMS)).get(zlib.crc32(payload) % SHARE, FORMS[0])
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return write_tiff([rows[at : at + PAGE_ROWS] for at in range(0, len(rows), PAGE_ROWS)], compression, predictor, tile)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each whole text as a TIFF file, read its pages back and describe
    them: (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature[, media]).

    The payload is the text in UTF-8 with zero bytes up to a positive multiple
    of 64. All but ``n_bytes`` and the media columns come from the decoded
    samples. ``feature`` is the number of pages and rows, and how often each
    high half of a sample occurs. A narrow map: pages are looked at one at a
    time.

    Defined results: null counts as empty, whose payload is 64 zero bytes;
    equal texts give equal values; null ids and repeated rows stay; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tiff")
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                n = len(data)
                media = stored(data.ljust(max(1, -(-n // ROW)) * ROW, b"\0"))
                sha, size, tail, high, count, tall = hashlib.sha256(), 0, b"", np.zeros(16, np.int64), 0, 0
                for page in read_pages(media):
                    part = page.pixels.tobytes()
                    sha.update(part)
                    size, tail, count, tall = size + len(part), part[-64:], count + 1, tall + page.height
                    high += np.bincount(page.pixels.ravel() >> 4, minlength=16)
                rows.append((n, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"{count}p{tall}r:" + "-".join(map(str, high.tolist())), *([media] if keep_media else [])))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*rows)) if rows else [[]] * (7 + keep_media)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
