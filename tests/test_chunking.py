"""Chunks of blocks against hand-made cases and against a walk over lines, one after the other."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vocabulary as V
from tessera.operators import chunking

EXTRA = ", part int, lines string, zone string"  # names used inside


def frame(spark, texts, **fixed):
    base = {"page_number": 1, "block_type": "text", "section_title": None, "extraction_method": "text", "quality_score": 0.9, "selected_extractor": None, "source_parser": None, "source_chunker": None, "headers": None, "values": None, "row_number": None} | fixed
    rows = [(d, k, base["page_number"], base["block_type"], base["section_title"], t, *[base[c] for c in ("extraction_method", "quality_score", "selected_extractor", "source_parser", "source_chunker", "headers", "values", "row_number")], 1, "x", "y") for d, ts in texts.items() for k, t in enumerate(ts)]
    return spark.createDataFrame(rows, chunking.BLOCK + EXTRA)


def chunks(spark, *texts, **fixed):
    return sorted(chunking.chunk_blocks(frame(spark, {1: texts}, **fixed)).collect(), key=lambda r: r["chunk_index"])


def test_references_of_html(spark):
    r = random.Random(2)
    cases = ["&amp;lt;", "a & b &&amp; &", "&#39;&#x27 &#0;&#128;&#x81;&#xD800;&#1114112;&#99999999999;", "&#11;&#13;&#65534;&notit;&notin;&ampx&copy2&fjlig;&#;&#x;", "&Aacutex;&nbsp;&frac12 &frac123;", "", "plain"]
    cases += ["".join(r.choice(["&", "#", "x", "1", "0", "f", ";", " ", "amp", "lt", "copy", "é", *r.sample(sorted(html.entities.html5), 3)]) for _ in range(9)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.unescape(F.col("t")).alias("u")).collect()
    assert all(x["u"] == html.unescape(x["t"]) for x in got)


def test_sections_tables_and_sentences(spark):
    text = """Release Notes
Dock 7
Document ID
DOC-9
Vendor:
Acme 4
Release Date: 2024-01-02

# 1. Overview
This page lists docks of one kind.

## Compatibility Requirements
The dock requires firmware 1.2.3 or later. It is quiet. It is small. It is not supported with hubs. Ask us.

| Component | Minimum Version |
|---|---|
| BIOS | 2.10.1 |
| Dock | |
| | |
| Hub | 3.1 | more |

| Panel | 4.0.1 |
|---|---|
| Lamp | 5.0.2 |

| only | one |
|---|---|
Known Issues:
First part of it is long enough.

Second part &amp;amp; more of it.
"""
    got = [(c["chunk_type"], c["section_title"], c["semantic_zone"], c["text"], c["row_number"]) for c in chunks(spark, text)]
    title = "Compatibility Requirements"
    assert got == [
        ("document_metadata", "Release Notes Dock 7", "document_metadata", "Document ID: DOC-9\nVendor: Acme 4\nRelease Date: 2024-01-02", None),
        ("prose", None, "body", "Release Notes\nDock 7", None),
        ("overview", "1. Overview", "overview", "This page lists docks of one kind.", None),
        ("minimum_version_requirement", title, "compatibility_requirements", "The dock requires firmware 1.2.3 or later. It is quiet. It is small.", None),
        ("unsupported_configuration", title, "unsupported_configurations", "It is not supported with hubs.", None),
        ("compatibility_requirements", title, "compatibility_requirements", "Ask us.", None),
        ("component_table_row", title, "compatibility_requirements", "Component: BIOS | Minimum Version: 2.10.1", 1),
        ("component_table_row", title, "compatibility_requirements", "Component: Dock | Minimum Version:", 2),
        ("component_table_row", title, "compatibility_requirements", "Component: Hub | Minimum Version: 3.1", 3),
        ("component_table_row", title, "compatibility_requirements", "Component: Panel | Minimum Version: 4.0.1", 1),
        ("component_table_row", title, "compatibility_requirements", "Component: Lamp | Minimum Version: 5.0.2", 2),
        ("compatibility_requirements", title, "compatibility_requirements", "| only | one |\n|---|---|", None),
        ("known_issues", "Known Issues:", "known_issues", "First part of it is long enough.", None),
        ("known_issues", "Known Issues:", "known_issues", "Second part & more of it.", None),
    ]
    assert [c["chunk_index"] for c in chunks(spark, text)] == list(range(len(got)))


def test_single_cases(spark):
    assert [c["text"] for c in chunks(spark, None, "", " \n ", "1.2.3", "Label only")] == []
    kept = chunking.chunk_blocks(frame(spark, {1: ["1.2.3"]}), keep_rejected=True).collect()
    assert [(c["chunk_type"], c["llm_usage"]) for c in kept] == [("rejected", "ignore")]
    row = chunks(spark, "x | y", block_type="table_row", headers=["A", "B", "A"], values=["1", "2.0.1", "3"], row_number=7, section_title="T")
    assert [(c["text"], c["table_row"], c["row_number"], c["source_chunker"]) for c in row] == [("A: 1 | B: 2.0.1 | A: 3", {"A": "3", "B": "2.0.1"}, 7, "semantic_chunker")]
    uneven = chunks(spark, "raw text of a row.", block_type="table_row", headers=["A"], values=[], extraction_method="docling")
    assert [(c["text"], c["source_chunker"], c["source_parser"]) for c in uneven] == [("raw text of a row.", "docling_hybrid_chunker", "docling")]
    long = chunks(spark, "The driver must match the firmware here. " * 9000)
    assert [(c["chunk_type"], c["character_count"]) for c in long] == [("compatibility_requirement", 41 * 9000 - 1)]
    assert chunking.chunk_blocks(frame(spark, {})).count() == 0


def test_fold_prefers_selected_then_order_of_extractors_then_quality(spark):
    cases = [
        ([("csv", 0.9, None), ("docling", 0.1, None)], ("docling", 0.1, "csv")),
        ([("docling", 0.1, None), ("csv", 0.9, None)], ("csv", 0.9, "docling")),
        ([("text", 0.5, "text"), ("docling", 0.9, None)], ("text", 0.5, "docling")),
        ([("docling", 0.9, None), ("text", 0.5, "text"), ("pymupdf", 1.0, None)], ("text", 0.5, "pymupdf")),
        ([("text", None, None), ("other", 0.2, None)], ("text", None, "other")),
    ]
    rows = [(d, k, 1, "text", None, "The same text stands here.", m, q, sel, None, None, None, None, None) for d, (copies, _) in enumerate(cases) for k, (m, q, sel) in enumerate(copies)]
    got = {c["doc_id"]: (c["extraction_method"], c["quality_score"], c["deduplicated_from"]) for c in chunking.chunk_blocks(spark.createDataFrame(rows, chunking.BLOCK)).collect()}
    assert got == {d: want for d, (_, want) in enumerate(cases)}


# --- a walk over lines, one state after the other


def known(line):
    return line.lower().rstrip(":") in V.METADATA_LABELS


def label(line):
    s = line.strip().strip(":")
    return s.lower() in V.METADATA_LABELS or (not re.search(r"[.!?]", s) and len(s.split()) <= 4 and not re.search(r"\d", s))


def heading(line):
    s = line.strip()
    return bool(s) and (s[0] == "#" or bool(re.match(r"\d+(\.\d+)*\.\s+\S", s)) or bool(re.match(r"version\s+v?\d", s, re.I)) or s.lower().rstrip(":") in V.SECTION_TITLES)


def cleaned(text):
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", html.unescape(text)))
    todo, out = [x.strip() for x in text.split("\n")][::-1], []
    while todo:
        line = todo.pop()
        if known(line) and todo and todo[-1] and not label(todo[-1]):
            line = f"{line.rstrip(':')}: {todo.pop()}"
        out.append(line)
    return "\n".join(out).strip()


def tables(body):
    """(kind, text) of tables' rows and of texts between them."""
    cells = lambda x: [c.strip() for c in re.sub(r"^\||\|$", "", x.strip()).split("|")]
    is_row = lambda x: x.startswith("|") and x.count("|") > 1
    dashes = lambda x: all(re.fullmatch(":?-{3,}:?", c) for c in cells(x) if c)
    todo, text, last = body.split("\n")[::-1], [], None

    def flush():
        if "\n".join(text).strip():
            yield "text", "\n".join(text).strip()
        text.clear()

    while todo:
        line = todo.pop()
        if not (is_row(line) and todo and dashes(todo[-1])):
            text.append(line)
            continue
        yield from flush()
        rows = [line]
        while todo and is_row(todo[-1]):
            rows.append(todo.pop())
        if len(rows) < 3:
            yield "text", "\n".join(rows)
            continue
        head, data = cells(rows[0]), [r for r in rows[2:] if not dashes(r)]
        if last and len(last) == len(head) and not {c.lower() for c in head} & set(V.HEADER_WORDS) and any(re.search(r"\bv?\d+(\.\d+)+(\.x)?\b", c, re.I) for c in head):
            head, data = last, [rows[0], *data]
        last = head
        for r in data:
            if any(cells(r)):
                values = (cells(r) + [""] * len(head))[: len(head)]
                yield "row", " | ".join(f"{h}: {v}" if h else v for h, v in zip(head, values, strict=True) if h or v)
    yield from flush()


def walk(text):
    """Chunk candidates (kind, text) of a block, before thin ones go: metadata, table rows and texts of sections."""
    text = cleaned(text)
    todo = [x.strip("# ").strip() for x in text.split("\n") if x.strip()][::-1]
    meta = []
    while todo:
        line = todo.pop()
        if known(line):
            meta.append(f"{line.rstrip(':')}: {todo.pop() if todo and not label(todo[-1]) else ''}".strip())
        elif ":" in line and line.split(":")[0].strip().lower() in V.METADATA_LABELS:
            meta.append(line)
    if meta:
        yield "metadata", "\n".join(meta)
        kept, skip = [], False
        for line in text.split("\n"):
            bare = line.strip("# ").strip()
            if skip:
                skip = False
            elif known(bare):
                skip = True
            elif not (":" in bare and bare.split(":")[0].strip().lower() in V.METADATA_LABELS):
                kept.append(line)
        text = "\n".join(kept)
    body = []
    for line in [*text.split("\n"), "# end"]:
        if heading(line):
            whole = cleaned("\n".join(body))
            if whole:
                yield from tables(whole)
            body = []
        else:
            body.append(line)


@pytest.mark.parametrize("seed", range(2))
def test_random_lines_equal_the_walk(spark, seed):
    r = random.Random(seed)
    kinds = ["Vendor", "Version:", "Platform: x1", "# Version", "## Overview", "Known issues", "2. Part", "version 3", "", "", "| a | b |", "|---|---|", "| x 1.2.3 | y |", "| 1.0.1 |", "|:--|", "---", "||", "| | |", "plain words 7", "Acme", "A b. C d.", " | late | row |", "x &lt; y", "&#10;- z", "applies to", "Component | Version", "| Version | b |"]
    texts = {i: ["\n".join(r.choice(kinds) for _ in range(r.randrange(1, 16)))] for i in range(150)}
    ready = frame(spark, texts).select("doc_id", F.lit(False).alias("is_row"), "section_title", chunking.clean(F.col("text")).alias("text")).where("text <> ''").withColumn("meta", chunking.metadata(F.col("text")))
    ready = ready.withColumn("rest", F.when(F.col("meta.text").isNotNull(), chunking.without_metadata(F.col("text"))).otherwise(F.col("text")))
    units = chunking._units(chunking._seeds(ready).where("seed = 'section'"))
    rows = units.where("effective is not null").select("doc_id", "section_no", "unit_no", F.lit("row").alias("kind"), F.posexplode(F.transform(chunking._table_rows(F.col("unit_lines"), F.col("effective"), F.col("carried")), lambda x: x["text"])).alias("k", "t"))
    plain = units.where("effective is null").select("doc_id", "section_no", "unit_no", F.lit("text").alias("kind"), F.lit(0).alias("k"), X.strip(F.array_join("unit_lines", "\n")).alias("t")).where("t <> ''")
    meta = ready.where("meta.text is not null").select("doc_id", F.lit(-1).alias("section_no"), F.lit(0).alias("unit_no"), F.lit("metadata").alias("kind"), F.lit(0).alias("k"), F.col("meta.text").alias("t"))
    got = {i: [] for i in texts}
    for x in sorted(rows.unionByName(plain).unionByName(meta).collect(), key=lambda x: (x["section_no"], x["unit_no"], x["k"])):
        got[x["doc_id"]].append((x["kind"], x["t"]))
    for i, (text,) in texts.items():
        assert got[i] == list(walk(text)), text
