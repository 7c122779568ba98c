"""Line normalisation against a fold over the lines, for any cut."""

import random
import re

import pytest

from lexforge.operators import outline

BLOCKS = "doc_id long, position long, kind string, level int, heading string, text string"
LINES = ["Abstract: we plan", "摘 要", "Keywords plan, act", "References", "参考文献:", "[1] A. Work 1999", "2) Other work", "1.2 Methods", "3 Ends with a stop。", "第一章 绪论", "一、方法", "Conclusion", "Table 1 results", "表 2 结果", "Figure 3 shape", "图1 形", "ours | 1 | 2", "a 1 2", "plain words here", "so it goes", "x" * 200 + " 1 2", "word 9", "", "  \t "]


def compact(s):
    return re.sub(r"\s+", " ", s).strip()


def head(line):
    m = re.match(r"^(摘\s*要|Abstract)\s*[:：]?\s*(.*)$", line, re.I)
    if m and (m[2] or m[1] in ("摘要", "摘 要", "Abstract")):
        return "摘要", 1, "abstract", m[2]
    if m := re.match(r"^(关键词|关键字|Keywords?)\s*[:：]?\s*(.*)$", line, re.I):
        return "关键词", 1, "keywords", m[2]
    if re.match(r"^(参考文献|References|Bibliography)\s*[:：]?$", line, re.I):
        return "参考文献", 1, "", ""
    if len(line) > 96:
        return None
    ok = lambda t: t and len(t) <= 72 and not re.search("[。！？!?；;]$", t)
    if re.match("^第[一二三四]章", line) or re.match(r"^Conclusion\s*[:：]?$", line, re.I):
        return line, 1, "", ""
    if (m := re.match(r"^(\d+(?:\.\d+){0,3})[\s、.．]+(.{1,80})$", line)) and ok(compact(m[2])):
        return line, min(m[1].count(".") + 1, 4), "", ""
    if re.match(r"^[一二三四]+[、.．]\s*.{1,80}$", line) and ok(line):
        return line, 2, "", ""


def fold(blocks):
    """A state machine over the lines of one document."""
    out, listed, context = [], False, ""
    named = {"摘要": "abstract", "abstract": "abstract", "关键词": "keywords", "keywords": "keywords", "参考文献": "reference", "references": "reference"}

    def enter(title):
        return bool(re.match(r"^(参考文献|References|Bibliography)\s*[:：]?$", title, re.I)), named.get(re.sub(r"\s+", "", title).lower(), "")

    for kind, level, heading, text in blocks:
        if kind == "heading":
            title = compact(heading or text or "")
            if title:
                out.append(("heading", level or (head(title) or (0, 1))[1], title, ""))
                listed, context = enter(title)
            continue
        if kind in outline.WHOLE:
            out.append((kind, level, "", text or ""))
            listed = kind == "reference" or listed
            context = kind if kind in ("abstract", "keywords", "reference") else context
            continue
        run = []

        def flush(run=run):
            if run:
                what = run[0][0]
                out.append(("table" if what == "rows" else context if context in ("abstract", "keywords") else "paragraph", 0, "", ("\n" if what == "rows" else " ").join(x for _, x in run)))
                run.clear()

        for line in filter(None, map(compact, (text or "").split("\n"))):
            h = head(line)
            cells = [c for c in map(compact, line.split("|" if "|" in line else " ")) if c]
            row = len(line) <= 180 and (len(cells) > 2 or len(cells) == 2 and any(re.search(r"\d", c) for c in cells))
            if h:
                flush()
                out.append(("heading", h[1], h[0], ""))
                if h[3]:
                    out.append((h[2], 0, "", h[3]))
                listed, context = enter(h[0])
            elif re.match(r"^(图\s*\d+|Figure\s+\d+)", line, re.I):
                flush()
                out.append(("figure", 0, "", line))
            elif re.match(r"^(表\s*\d+|Table\s+\d+)", line, re.I):
                flush()
                out.append(("table", 0, "", line))
                context = "table"
            elif listed or re.match(r"^(\[\d+\]|\d+[.)、]\s+).+", line):
                flush()
                out.append(("reference", 0, "", line))
            else:
                what = "rows" if context == "table" and row else "text"
                if run and run[0][0] != what:
                    flush()
                run.append((what, line))
        flush()
    return out


def corpus(seed):
    rng, rows = random.Random(seed), []
    for d in range(8):
        for p in range(rng.randint(0, 9)):
            kind = rng.choice(["paragraph"] * 5 + ["heading", "abstract", "reference", "table", "keywords"])
            text = "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 14)))
            rows.append((d, p * 2, kind, rng.choice([0, 2, None]), rng.choice(["", "1.1 Heads", "References", "Abstract", None]) if kind == "heading" else None, rng.choice(LINES) if kind != "paragraph" else rng.choice([text, text.replace("\n", "\r\n"), None])))
    return rows


@pytest.mark.parametrize("chunk", [4096, 3])
def test_blocks_equal_a_fold_for_any_cut(spark, monkeypatch, chunk):
    monkeypatch.setattr(outline, "CHUNK", chunk)
    rows = corpus(chunk)
    got = {}
    for r in outline.normalized(spark.createDataFrame(rows, BLOCKS).repartition(3)).orderBy("doc_id", "position", "part").collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["level"], r["heading"], r["text"]))
    want = {d: fold([(k, lv or 0, h, t) for x, _, k, lv, h, t in rows if x == d]) for d in range(8)}
    assert got == {d: w for d, w in want.items() if w}


def test_markdown_restores_the_text(spark):
    blocks = spark.createDataFrame([(1, 0, "heading", 2, "Intro", ""), (1, 1, "paragraph", 0, "", "one line\nReferences\n[1] A"), (2, 0, "heading", 1, "Title", "")], BLOCKS)
    titles = spark.createDataFrame([(1, "Title"), (2, "Title")], "doc_id long, title string")
    got = {r["doc_id"]: r["markdown"] for r in outline.markdown(outline.normalized(blocks), titles).collect()}
    assert got == {1: "# Title\n\n## Intro\n\none line\n\n# 参考文献\n\n[1] A\n", 2: "# Title\n"}
    assert outline.normalized(blocks.limit(0)).collect() == []
