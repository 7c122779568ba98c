"""Files as tables: discovery, decoding, parsing into blocks, and evaluation sets."""

from __future__ import annotations

import html.parser
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that are read, and encodings in the order they are tried.
SUFFIXES = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html", "docx": "docx", "pdf": "pdf"}
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "latin-1")

BLOCKS = "path string, title string, position int, kind string, level int, heading string, text string, error string"


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_type, size, hash, content) of the files below ``root`` that
    have a known suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return files.withColumn("file_type", kinds[suffix]).filter("file_type IS NOT NULL").select("path", "file_type", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), "content")


def decoded(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


Block = tuple[str, int, str, str]  # kind, level, heading, text


def markdown_blocks(text: str) -> tuple[str, list[Block]]:
    """ATX headings and paragraphs parted by blank lines; the first heading is the title."""
    out: list[Block] = []
    title, held = "", []

    def close():
        if held:
            out.append(("paragraph", 0, "", "\n".join(held).strip()))
            held.clear()

    for line in text.replace("\r\n", "\n").split("\n"):
        m = re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            close()
            title = title or m[2]
            out.append(("heading", len(m[1]), m[2], ""))
        elif line.strip():
            held.append(line)
        else:
            close()
    close()
    return title, out


def text_blocks(text: str) -> tuple[str, list[Block]]:
    parts = re.split(r"\n\s*\n+", text.replace("\r\n", "\n").replace("\r", "\n"))
    return "", [("paragraph", 0, "", p.strip()) for p in parts if p.strip()]


class _Html(html.parser.HTMLParser):
    """Text of a page with its headings; script and style are left out unless asked for."""

    BREAKS = {"p", "br", "div", "section", "article", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self, keep_script: bool):
        super().__init__(convert_charrefs=True)
        self.keep, self.skip, self.title, self.in_title = keep_script, 0, "", False
        self.out: list[Block] = []
        self.held: list[str] = []
        self.level = 0

    def _close(self):
        text = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if text:
            self.out.append(("heading", self.level, text, "") if self.level else ("paragraph", 0, "", text))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style") and not self.keep:
            self.skip += 1
        if tag == "title":
            self.in_title = True
        if tag in self.BREAKS:
            self._close()
            self.level = int(tag[1]) if re.fullmatch(r"h[1-6]", tag) else 0

    def handle_endtag(self, tag):
        if tag in ("script", "style") and not self.keep:
            self.skip = max(0, self.skip - 1)
        if tag == "title":
            self.in_title = False
        if tag in self.BREAKS:
            self._close()
            self.level = 0

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.held.append(data)


def html_blocks(text: str, keep_script: bool = False, closed: bool = False) -> tuple[str, list[Block]]:
    """``closed`` takes only references that end with a semicolon, so a cut one stays as it is."""
    if closed:
        text = re.sub(r"&(?=#?[0-9A-Za-z]+(?![0-9A-Za-z;]))", "&amp;", text)
    parser = _Html(keep_script)
    parser.feed(text)
    parser.close()
    parser._close()
    return parser.title.strip(), parser.out


def docx_blocks(content: bytes) -> tuple[str, list[Block]]:
    """Paragraphs of a word-processing file; the first is the title."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    parts = ["".join(t.text or "" for t in p.iter(name + "t")).strip() for p in root.iter(name + "p")]
    parts = [p for p in parts if p]
    return (parts[0][:120] if parts else ""), [("paragraph", 0, "", p) for p in parts]


Parser = Callable[[bytes], tuple[str, list[Block]]]

PARSERS: dict[str, Parser] = {
    "markdown": lambda c: markdown_blocks(decoded(c)),
    "text": lambda c: text_blocks(decoded(c)),
    "html": lambda c: html_blocks(decoded(c)),
    "docx": docx_blocks,
}


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Blocks of files (path, file_type, content), one row each.

    A file that cannot be parsed, or whose type has no parser, gives one row
    with its ``error``; the others go on. ``parsers`` adds or replaces parsers.
    """
    known = PARSERS | (parsers or {})
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                try:
                    if kind not in known:
                        raise ValueError(f"no parser for {kind}")
                    title, blocks = known[kind](content.as_py() or b"")
                    stem = re.sub(r"\.[^.]*$", "", (path or "").rsplit("/", 1)[-1])
                    rows += [(path, title or stem, k, b[0], b[1], b[2], b[3], None) for k, b in enumerate(blocks)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the run
                    rows.append((path, "", 0, "error", 0, "", "", f"{type(e).__name__}: {e}"))
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return files.select("path", "file_type", F.col("content").cast("binary").alias("content")).mapInArrow(run, BLOCKS)


def evaluation_set(spark: SparkSession, path: str) -> DataFrame:
    """Queries of a JSON file: a list, or an object with ``queries``."""
    rows = spark.read.option("multiLine", "true").json(path)
    if "queries" in rows.columns:
        rows = rows.select(F.explode("queries").alias("q")).select("q.*")
    for name in ("expected_doc_ids", "expected_keywords", "expected_node_keywords"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.array().cast("array<string>"))
    return rows.select("query", F.coalesce(F.col("intent") if "intent" in rows.columns else F.lit(None).cast("string"), F.lit("")).alias("intent"), "expected_doc_ids", F.concat("expected_keywords", "expected_node_keywords").alias("expected_keywords"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_documents(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write ``df``, partitioned by ``key``, in place of the partitions it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def without(df: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """``df`` without the rows of documents that are gone."""
    return df.join(gone.select(key), key, "left_anti")


def with_columns(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Adds columns that an older table lacks: name -> (type, default)."""
    missing = {c: F.lit(v).cast(t) for c, (t, v) in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df
