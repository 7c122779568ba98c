"""Text functions on columns. All are built of Spark's own expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions import config as C


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def text_of(c) -> Column:
    """A column as a string, null as empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_spellings(words: Column, limit: int | None = None) -> Column:
    """Words that differ without regard to case, each as first spelled."""

    def pick(pair):
        different = F.array_distinct(pair["low"])
        some = F.slice(different, 1, limit) if limit else different
        return F.transform(some, lambda w: F.get(pair["word"], F.array_position(pair["low"], w).cast("int") - 1))

    return let(F.struct(words.alias("word"), F.transform(words, F.lower).alias("low")), pick)


#: White space of Unicode but the plain space, and runs of white space that are not one plain space already.
BLANK = r"\t-\r\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
RUNS = rf"[{BLANK}][ {BLANK}]*| [ {BLANK}]+"


def compact(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(c, RUNS, " "))


def plain(c: Column) -> Column:
    """Whether single plain spaces and line feeds are all white space of a text:
    its lines need no compacting but at their ends."""
    return ~any_term(c, ["  ", *(b for b in map(chr, range(0x3001)) if b not in " \n" and re.fullmatch(f"[{BLANK}]", b))])


def needed(pattern: str) -> list[str] | None:
    """Words of which each match of a pattern holds one, if it ends in a group of
    plain words and has neither choices, groups nor escapes before that."""
    end = re.fullmatch(r"[^|()\\]*\(\?:([\w|]+)\)", pattern)
    return end[1].split("|") if end and "" not in end[1].split("|") else None


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern; texts without the words it needs are not searched."""
    found, words = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), needed(pattern)
    return F.when(any_term(c, words), found).otherwise(F.array().cast("array<string>")) if words else found


def first_words(c: Column, limit: int = 48) -> Column:
    words = F.filter(F.split(compact(c), " "), lambda w: w != "")
    return F.when(F.size(words) <= limit, F.array_join(words, " ")).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit(" ...")))


def paragraphs(c: Column) -> Column:
    """Paragraphs are parted by blank lines; each is trimmed, empty ones go."""
    unix = F.regexp_replace(F.regexp_replace(c, "\r\n", "\n"), "\r", "\n")
    parts = F.transform(F.split(unix, r"\n(?U:\s*)\n+"), strip)
    return F.filter(parts, lambda p: p != "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def chunks(c: Column, size: int = 1800) -> Column:
    """Paragraphs packed into chunks of up to ``size`` characters.

    Separators do not count; a paragraph above the size closes the chunk before
    it and is cut every ``size`` characters.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def step(acc, p):
        long = F.length(p) > size
        full = (F.size(acc["open"]) > 0) & (acc["n"] + F.length(p) > size)
        closed = F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n\n")))
        done = F.when(full, closed).otherwise(acc["done"])
        still = F.when(full, none).otherwise(acc["open"])
        n = F.when(full, F.lit(0)).otherwise(acc["n"])
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")), lambda k: strip(F.substring(p, k * size + 1, F.lit(size))))
        return F.struct(
            F.when(long, F.concat(done, F.filter(cuts, lambda x: x != ""))).otherwise(done).alias("done"),
            F.when(long, still).otherwise(F.concat(still, F.array(p))).alias("open"),
            F.when(long, n).otherwise(n + F.length(p)).alias("n"),
        )

    def finish(acc):
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n\n")))).otherwise(acc["done"])

    return F.aggregate(paragraphs(c), start, step, finish)


def excerpt(c: Column, limit: int, suffix: str = "...", trim_end: bool = True) -> Column:
    whole = compact(c)
    cut = F.substring(whole, 1, limit)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(cut) if trim_end else cut, F.lit(suffix)))


def normalize_key(c: Column) -> Column:
    """Lower case, punctuation off both ends, no white space."""
    lowered = F.lower(compact(c))
    ends = F.regexp_replace(lowered, r"^[ \t\r\n.,;:!?，。；：！？…]+|[ \t\r\n.,;:!?，。；：！？…]+$", "")
    return F.regexp_replace(F.regexp_replace(ends, r"^(?:\.\.\.|…)+", ""), r"(?U)\s+", "")


def fact_key(c: Column, limit: int = 120) -> Column:
    """Lower-case letters and digits, at most ``limit``."""
    return F.substring(F.regexp_replace(F.lower(compact(c)), r"[^\p{L}\p{N}]", ""), 1, limit)


def clamp01(c: Column, default: float, digits: int = 3) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(default)))), digits)


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """``prefix_`` and the first hex digits of a SHA-256 over the parts; a null
    part counts as the word None."""
    joined = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, length))


def content_hash(c: Column) -> Column:
    return F.sha2(compact(c), 256)


def any_term(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in terms], F.lit(False))


def count_terms(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(t)).cast("int") for t in terms], F.lit(0))


def _grams(t: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))


def terms(c: Column, *, cjk_min: int | None = 5, sizes: tuple[int, ...] = (2,), phrases: list[str] | None = None, stop: list[str] | None = None, limit: int | None = None, lower: bool = False, pattern: str = C.TERM, distinct: bool = True, ascii_lower: bool = False) -> Column:
    """Search terms of a text.

    Words and runs of ideographs; a run of ``cjk_min`` or more adds its n-grams
    after itself. ``phrases`` that the text contains come first. Stop terms and
    repeats go, the first ``limit`` stay. ``ascii_lower`` compares ASCII terms
    without regard to case but keeps the first spelling.
    """
    source = F.lower(c) if lower else c
    found = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    if cjk_min is not None:

        def spread(t):
            grams = [_grams(t, n) for n in sizes]
            return F.when(F.regexp_like(t, F.lit(f"^{C.CJK}{{{cjk_min},}}$")), F.concat(F.array(t), *grams)).otherwise(F.array(t))

        found = F.flatten(F.transform(found, spread))
    if phrases:
        found = F.concat(F.filter(lit_array(phrases), lambda p: F.contains(source, p)), found)
    if stop:
        found = F.filter(found, lambda t: ~F.array_contains(lit_array(stop), F.lower(t) if ascii_lower else t))
    if distinct and not ascii_lower:
        found = F.array_distinct(found)
    if distinct and ascii_lower:
        return let(found, lambda v: first_spellings(v, limit))
    return F.slice(found, 1, limit) if limit else found


def or_whole(found: Column, c: Column) -> Column:
    """The text itself where it has no terms."""
    return let(found, lambda v: F.when(F.size(v) > 0, v).otherwise(F.array(c)))


def fts_tokens(c: Column, limit: int = 16) -> Column:
    """Tokens of a full-text query: Unicode words, runs of 3 or more ideographs
    also as pairs, the first ``limit`` different ones."""
    return terms(c, cjk_min=3, pattern=r"(?U)[\w\u4e00-\u9fff]+", limit=limit)


def fts_query(c: Column) -> Column:
    found = fts_tokens(c)
    return F.when(F.size(found) > 0, F.array_join(found, " OR ")).otherwise(F.lit('""'))


def fallback_terms(c: Column) -> Column:
    return or_whole(terms(c, cjk_min=5, phrases=C.SEARCH_PHRASES, stop=C.SEARCH_STOP, limit=10), c)


def routing_terms(c: Column) -> Column:
    """Fallback terms and all words, lower-cased."""
    return F.array_distinct(F.transform(F.concat(fallback_terms(c), terms(c, cjk_min=3, distinct=False)), lambda t: F.lower(F.trim(t))))


def focus_terms(c: Column, extra: list[str] | None = None) -> Column:
    found = terms(c, cjk_min=5, phrases=C.FOCUS_PHRASES, distinct=False)
    both = F.concat(found, lit_array(extra or []))
    kept = F.filter(both, lambda t: (t != "") & ~F.array_contains(lit_array(C.FOCUS_STOP), F.lower(t)))
    return or_whole(let(kept, lambda v: first_spellings(v, 14)), compact(c))


def fact_terms(c: Column) -> Column:
    return or_whole(terms(c, cjk_min=5, limit=12), c)


def frame_terms(c: Column) -> Column:
    return or_whole(terms(c, cjk_min=4, limit=16), c)


def keywords(c: Column, limit: int = 10) -> Column:
    """The first different words of a text, stop words aside, as first spelled."""
    return terms(c, cjk_min=None, stop=C.KEYWORD_STOP, limit=limit, ascii_lower=True)


def embedding_tokens(c: Column, limit: int = 1000) -> Column:
    return terms(compact(c), cjk_min=3, sizes=(2, 3), pattern=C.EMBEDDING_TOKEN, lower=True, distinct=False, limit=limit)


def matching_terms(c: Column, found: Column, limit: int = 6) -> Column:
    return F.slice(F.filter(found, lambda t: (t != "") & F.contains(F.lower(c), t)), 1, limit)


def term_hits(found: Column, c: Column) -> Column:
    """How many terms a text contains, spaces and case aside."""
    flat = F.regexp_replace(F.lower(c), " ", "")
    return F.size(F.filter(F.transform(found, lambda t: F.regexp_replace(F.lower(t), " ", "")), lambda t: (t != "") & F.contains(flat, t)))


def front_matter(c: Column) -> Column:
    return any_term(F.regexp_replace(c, " ", ""), C.FRONT_MATTER) | F.regexp_like(c, F.lit(r"\.{4,}|…{2,}"))


def research_signal(c: Column) -> Column:
    return any_term(F.lower(compact(c)), C.RESEARCH_SIGNALS)


def path_fragment(c: Column) -> Column:
    return let(compact(c), _path_fragment)


def _path_fragment(flat: Column) -> Column:
    marks = F.length(flat) - F.length(F.translate(flat, ">/", ""))
    return (marks >= 2) & ~any_term(F.lower(flat), C.RESEARCH_SIGNALS)


def reference_entry(c: Column) -> Column:
    return let(compact(c), _reference_entry)


def _reference_entry(flat: Column) -> Column:
    cited = F.regexp_like(F.lower(flat), F.lit(r"\b(doi|vol\.|no\.|pp\.|journal|proceedings)\b"))
    return F.regexp_like(flat, F.lit(r"^\[\d+\]")) | (cited & ~any_term(F.lower(flat), C.RESEARCH_SIGNALS))


def repeated_caption(c: Column) -> Column:
    return _repeated_caption(compact(c))


def _repeated_caption(flat: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.lower(flat), F.lit(r"(图\s*\d+|表\s*\d+|fig(?:ure)?\.?\s*\d+|table\s*\d+)"), F.lit(1)), lambda x: F.regexp_replace(x, " ", ""))
    return let(found, lambda f: (F.size(f) >= 2) & (F.size(F.array_distinct(f)) < F.size(f)))


def noise_reasons(c: Column, *, heading: Column | None = None, page: Column | None = None, source: Column | None = None) -> Column:
    """Why a text is noise, of six reasons; an empty text has none."""
    heading, source = heading if heading is not None else F.lit(""), source if source is not None else F.lit("")
    early = F.lit(True) if page is None else page.isNull() | page.isin(0, 1, 2)

    def of(flat: Column) -> Column:
        lowered = F.lower(F.concat(heading, F.lit(" "), source, F.lit(" "), flat))
        front = let(count_terms(lowered, C.NOISE_MARKERS), lambda marks: (marks >= 1) & (early | (F.length(flat) < 300) | (marks >= 2)))
        reasons = F.array_compact(
            F.array(
                F.when(front, "front_matter"),
                F.when(F.regexp_like(lowered, F.lit(r"第\s*\d+\s*页|page\s+\d+")), "page_marker"),
                F.when(F.regexp_like(flat, F.lit(r"^(题目|作者|引用格式|基金项目|收稿日期|网络首发|分类号|学号|中图分类号)[:：]")), "metadata_prefix"),
                F.when(_repeated_caption(flat), "repeated_caption"),
                F.when(_path_fragment(flat), "path_fragment"),
                F.when(_reference_entry(flat) & ~F.contains(source, F.lit("citation")), "reference_entry"),
            )
        )
        return F.when(flat == "", F.array().cast("array<string>")).otherwise(reasons)

    return let(compact(text_of(c)), of)  # white space is compacted once


def clean_research_text(c: Column) -> Column:
    """Pieces between full stops and semicolons, without noise and repeats; line
    ends are white space.

    A caption that repeats at once is cut first, three times over, which undoes
    eight copies in a row.
    """
    cut = compact(text_of(c))
    for _ in range(3):
        cut = F.regexp_replace(cut, r"((?:图|表)\s*\d+[\s\S]{2,80}?)(?:\s+\1)+", "$1")
    pieces = F.transform(F.split(cut, r"[。；;]+"), compact)
    kept = F.filter(pieces, lambda p: (p != "") & (F.size(noise_reasons(p)) == 0))
    return compact(F.array_join(F.array_distinct(kept), " "))


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")).cast("int")


def doi(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1), F.lit(""))


def split_list(c: Column, pattern: str = r"[,;，；、/]", limit: int = 20) -> Column:
    return F.slice(F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != ""), 1, limit)


def citation_numbers(c: Column) -> Column:
    """Numbers of citation markers such as [1], [2-3] and [1,4], in order."""
    marks = F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*[-–,，]\s*\d+)*)\]"), F.lit(1))

    def spread(part):
        ends = F.split(part, r"\s*[-–]\s*")
        low, high = F.get(ends, F.lit(0)).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when((high >= low) & (high - low <= 50), F.sequence(low, F.greatest(low, F.least(high, low + 50)))).otherwise(F.array(low))

    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.flatten(F.transform(F.split(m, r"\s*[,，]\s*"), spread)))))
