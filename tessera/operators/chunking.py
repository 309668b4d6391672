"""Blocks of a document as its numbered chunks: metadata, sections, table rows, rule-aware units, deduplication.

A block stays one row until its parts are known. Its lines are an array beside a string with
one letter for the kind of each line, and the automata that walk lines (labels that swallow the next line,
tables, sentence buffers) are regular expressions on that string or tests of neighbouring letters. So a
block of any length takes time in proportion, and lines are never shuffled. Parts are then exploded,
judged as columns, and one shuffle by document folds duplicates and numbers what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vocabulary as V
from tessera.operators.chunks import SQL_LEVEL, SQL_SCORE, preferred
from tessera.plans.registry import query, table
from tessera.plans.stages import once

#: Columns of blocks. All but doc_id, block_no and text may be null.
BLOCK = (
    "doc_id long, block_no int, page_number int, block_type string, section_title string, text string, extraction_method string, quality_score double, "
    "selected_extractor string, source_parser string, source_chunker string, headers array<string>, values array<string>, row_number int"
)
ROW = "struct<text: string, row_number: int, headers: array<string>, values: array<string>>"
#: Extractors in order of preference, the best first.
PREFERENCE = ("docling", "pymupdf", "chandra_ocr", "text", "csv")


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end behind the last line makes no line more."""
    return X.let(text, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, rf"(?:{X.LINE_END})\z", ""), X.LINE_END)))


def _bare(line: Column) -> Column:
    return F.lower(F.rtrim(line, F.lit(":")))


def _is_label_name(line: Column) -> Column:
    return _bare(line).isin(*V.METADATA_LABELS)


def _has_label(line: Column) -> Column:
    """A line like ``Vendor: name``."""
    return F.contains(line, F.lit(":")) & F.lower(X.strip(F.split(line, ":", 2)[0])).isin(*V.METADATA_LABELS)


def _neighbours(lines: Column) -> Column:
    """Each line with the one before and the one behind it."""
    none = F.array(F.lit(None).cast("string"))

    def zipped(x: Column) -> Column:
        each = F.arrays_zip(x.alias("line"), F.concat(none, x).alias("before"), F.slice(x, 2, 2**30).alias("behind"))
        return F.slice(each, F.lit(1), F.size(x))

    return X.let(lines, zipped)


def _takes(line: Column, behind: Column) -> Column:
    """Whether a label takes the line behind it as its value. That line is no label, so it takes none itself."""
    return F.coalesce(_is_label_name(line) & (behind != "") & ~X.is_label(behind), F.lit(False))


def join_labels(text: Column) -> Column:
    """Lines stripped, each label joined with the value behind it as ``label: value``."""
    lines = F.transform(split_lines(text), lambda x: X.strip(x))

    def joined(n: Column) -> Column:
        return F.when(_takes(n["line"], n["behind"]), F.concat(F.rtrim(n["line"], F.lit(":")), F.lit(": "), n["behind"])).when(_takes(n["before"], n["line"]), None).otherwise(n["line"])

    return F.array_join(F.array_compact(F.transform(_neighbours(lines), joined)), "\n")


def clean(text: Column) -> Column:
    """References resolved, bullets and dashes as ``-``, runs of blanks as one, three or more line ends as two, labels joined, stripped."""
    whole = F.coalesce(text, F.lit(""))
    t = F.translate(X.unescape(whole), "•–—", "---")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    # a single line without any of these stays as it is
    return F.when(whole.rlike(rf"[&•–—\t]|  |{X.LINE_END}|\A{X.BLANK}|{X.BLANK}\z"), X.strip(join_labels(t))).otherwise(whole)


def _hashless(line: Column) -> Column:
    return X.strip(F.btrim(line, F.lit("# ")))


def metadata(text: Column) -> Column:
    """Struct (title, text) of the labelled lines of a cleaned text; text is null if it has none.

    The title is made of the first two lines before them that are no headings.
    """
    lines = F.transform(F.filter(split_lines(text), lambda x: X.strip(x) != ""), _hashless)

    def told(n: Column) -> Column:
        pair = F.concat(F.rtrim(n["line"], F.lit(":")), F.lit(": "), F.when(_takes(n["line"], n["behind"]), n["behind"]).otherwise(""))
        own = F.when(_takes(n["before"], n["line"]), None).when(_is_label_name(n["line"]), X.strip(pair)).when(_has_label(n["line"]), n["line"])
        return F.struct(n["line"].alias("line"), own.alias("told"))

    def made(each: Column) -> Column:
        first = F.array_min(F.array_compact(F.transform(each, lambda e, i: F.when(e["told"].isNotNull(), i))))
        found = F.array_compact(F.transform(each, lambda e: e["told"]))
        head = F.filter(F.transform(F.slice(each, F.lit(1), F.coalesce(first, F.lit(0))), lambda e: e["line"]), lambda x: ~X.is_heading(x))
        return F.struct(X.strip(F.array_join(F.slice(head, 1, 2), " ")).alias("title"), F.when(F.size(found) > 0, F.array_join(found, "\n")).alias("text"))

    return X.let(F.transform(_neighbours(lines), told), made)


def without_metadata(text: Column) -> Column:
    """A cleaned text without labelled lines; a lone label takes the next line with it, whatever it is, unless a label took the label."""

    def made(lines: Column) -> Column:
        kinds = F.transform(lines, lambda x: X.let(_hashless(x), lambda s: F.when(_is_label_name(s), "k").when(_has_label(s), "c").otherwise("n")))
        fate = F.split(F.regexp_replace(F.array_join(kinds, ""), "k.?", "xx"), "")
        kept = F.filter(F.arrays_zip(lines.alias("line"), fate.alias("kind")), lambda z: z["line"].isNotNull() & (z["kind"] == "n"))
        return F.array_join(F.transform(kept, lambda z: z["line"]), "\n")

    return X.let(split_lines(text), made)


def _starts(kinds: Column, letters: str) -> Column:
    """Places of the letters that begin a part; the first always does."""
    return F.array_compact(F.transform(F.split(kinds, ""), lambda c, i: F.when(c.isin(*letters) | (i == 0), i)))


def _parts(starts: Column, count: Column) -> Column:
    """Structs (first, count) of the stretches between starts."""
    return X.let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, 2**30), F.array(count)), lambda a, b: F.struct(a.alias("first"), (b - a).alias("count"))))


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(X.strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: X.strip(c))


def _is_row(line: Column) -> Column:
    return X.strip(line).rlike(r"^\|[^|]*\|")


def _is_rule(line: Column) -> Column:
    """A line of dashes between bars, or an empty one."""
    return ~line.rlike(rf"[^-|:{X.BLANK[1:-1]}]") & F.forall(_cells(line), lambda c: (c == "") | c.rlike(r"^:?-{3,}:?$"))


def _is_data(cells: Column) -> Column:
    """Whether what stands for a header looks like a row: a version among the cells and no known header."""
    known = F.exists(cells, lambda c: F.lower(c).isin(*V.HEADER_WORDS))
    return ~known & F.exists(cells, lambda c: F.lower(c).rlike(V.VERSION))


def _seeds(blocks: DataFrame) -> DataFrame:
    """A row for each part of a block that is judged apart: seed (row, metadata, section or whole), section_no, title, body, zone."""
    lined = once(blocks, lines=split_lines(F.col("rest")))
    # a heading's letter begins a part that holds it and its body
    kinds = F.array_join(F.transform("lines", lambda x: F.when(X.is_heading(X.strip(x)), "h").otherwise("n")), "")
    parted = once(once(lined, kinds=kinds), parts=_parts(_starts(F.col("kinds"), "h"), F.size("lines")))

    def section(p: Column, k: Column) -> Column:
        headed = F.substring("kinds", p["first"] + 1, F.lit(1)) == "h"
        title = F.when(headed, X.strip(F.ltrim(X.strip(F.col("lines")[p["first"]]), F.lit("#"))))
        body = F.slice("lines", p["first"] + 1 + headed.cast("int"), p["count"] - headed.cast("int"))
        return F.struct(F.lit("section").alias("seed"), k.cast("int").alias("section_no"), title.alias("title"), F.array_join(body, "\n").alias("body"))

    def single(seed: str, title: Column, body: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(seed).alias("seed"), F.lit(-1).alias("section_no"), title.alias("title"), body.alias("body")))

    is_row, labelled = F.col("is_row"), F.col("meta.text").isNotNull()
    named = F.coalesce(F.nullif("meta.title", F.lit("")), F.nullif("section_title", F.lit("")), F.lit("Document Metadata"))
    # a text with a line of nine words that is no heading leaves a piece that isn't thin; only others may need themselves as a chunk
    rich = F.exists("lines", lambda x: (X.word_count(x) >= 9) & ~X.is_heading(x) & ~x.rlike(r"^\W*[0-9]|^\s*\|"))
    singles = F.array_compact(F.array(single("row", F.col("section_title"), F.col("text"), is_row), single("metadata", named, F.col("meta.text"), ~is_row & labelled), single("whole", F.col("section_title"), F.col("rest"), ~is_row & ~labelled & ~rich & (F.col("rest") != ""))))
    seeds = F.concat(singles, F.when(is_row, F.slice(singles, 1, 0)).otherwise(F.transform("parts", section)))
    rows = parted.select(*[c for c in blocks.columns if c not in ("text", "rest", "meta", "is_row", "section_title")], F.explode_outer(seeds).alias("s"))
    made = once(rows.where("s is not null").select("*", "s.*").drop("s"), body=F.when(F.col("seed") == "section", clean(F.col("body"))).otherwise(F.col("body"))).where("body <> ''")
    titled = F.when(F.coalesce("title", F.lit("")) == "", "body").otherwise(X.zone_of_title(F.col("title")))
    return once(made, zone=F.when(F.col("seed") == "row", "compatibility_requirements").when(F.col("seed") == "metadata", "document_metadata").otherwise(titled))


def _units(sections: DataFrame) -> DataFrame:
    """A row for each table and each text between tables: unit_no, unit_lines, effective (a table's headers, null for texts), carried."""
    lined = once(sections, lines=F.when(F.col("seed") == "section", split_lines(F.col("body"))).otherwise(F.array("body")))
    # r: row, s: row of dashes, b: dashes or nothing without bars, t: other
    letter = F.transform("lines", lambda x: F.when(_is_row(x), F.when(_is_rule(x), "s").otherwise("r")).otherwise(F.when(_is_rule(x), "b").otherwise("t")))
    # a row before dashes opens a table (O), which runs on while rows follow; what follows it begins a text (X)
    letters = F.when(F.col("seed") == "section", F.array_join(letter, "")).otherwise("t")
    opened = F.regexp_replace(F.regexp_replace(letters, "[rs](?=[sb])([rs]*)", "O$1"), "(O[rs]*)[^rsO]", "$1X")
    parted = once(once(lined, kinds=opened), parts=_parts(_starts(F.col("kinds"), "OX"), F.size("lines")))
    heads = F.transform("parts", lambda p: F.when((F.substring("kinds", p["first"] + 1, F.lit(1)) == "O") & (p["count"] >= 3), _cells(F.col("lines")[p["first"]])))
    judged = once(parted, heads=F.transform(heads, lambda h: F.struct(h.alias("cells"), F.coalesce(_is_data(h), F.lit(False)).alias("data"))))
    none = F.lit(None).cast("array<string>")
    begin = F.struct(none.alias("last"), F.array().cast("array<struct<effective: array<string>, carried: boolean>>").alias("all"))

    def step(acc: Column, h: Column) -> Column:
        def made(carried: Column) -> Column:
            mine = F.when(carried, acc["last"]).otherwise(h["cells"])
            return F.struct(F.coalesce(mine, acc["last"]).alias("last"), F.concat(acc["all"], F.array(F.struct(mine.alias("effective"), carried.alias("carried")))).alias("all"))

        return X.let(F.coalesce(h["data"] & (F.size(acc["last"]) == F.size(h["cells"])), F.lit(False)), made)

    folded = once(judged, tables=F.aggregate("heads", begin, step, lambda acc: acc["all"]))
    rows = folded.select("*", F.posexplode_outer(F.arrays_zip("parts", "tables")).alias("unit_no", "u"))
    lines = F.slice("lines", F.col("u.parts.first") + 1, F.col("u.parts.count"))
    return rows.select(*[c for c in sections.columns if c != "body"], "unit_no", lines.alias("unit_lines"), F.col("u.tables.effective").alias("effective"), F.col("u.tables.carried").alias("carried"))


def _as_text(headers: Column, values: Column) -> Column:
    pairs = F.zip_with(headers, values, lambda h, v: F.when(h != "", F.concat(h, F.lit(": "), v)).when(v != "", v))
    return F.array_join(F.array_compact(pairs), " | ")


def _table_rows(lines: Column, headers: Column, carried: Column) -> Column:
    """Rows of a table under its headers; a header that is data is the first of them."""
    data = F.filter(F.slice(lines, 3, 2**30), lambda x: ~_is_rule(x))
    data = F.when(carried, F.concat(F.slice(lines, 1, 1), data)).otherwise(data)

    def row(line: Column, i: Column) -> Column:
        def made(own: Column) -> Column:
            cells = F.transform(headers, lambda _, k: F.coalesce(F.get(own, k), F.lit("")))
            return F.when(F.exists(own, lambda c: c != ""), F.struct(_as_text(headers, cells).alias("text"), (i + 1).cast("int").alias("row_number"), headers.alias("headers"), cells.alias("values")))

        return X.let(_cells(line), made)

    return F.array_compact(F.transform(data, row))


def _text_pieces(text: Column, zone: Column) -> Column:
    """Paragraphs, or the sentences of a single one: rules alone, others joined up to the next rule."""
    paragraphs = F.filter(F.transform(F.split(text, rf"\n{X.BLANK}*\n+"), lambda p: X.strip(p)), lambda p: p != "")
    # of type compound_requirement or unsupported_configuration, in any zone
    alone = lambda low: X.contains_any(low, V.UNSUPPORTED_WORDS) | (F.contains(low, F.lit("with ")) & X.contains_any(low, V.REQUIRE_WORDS))
    marked = F.transform(X.sentences(text), lambda s: F.struct(s.alias("line"), X.let(F.lower(s), alone).alias("alone")))
    whole = F.array(text)

    def joined(m: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<line: string, alone: boolean>")), m)
        each = F.slice(F.arrays_zip(m.alias("a"), before.alias("b")), F.lit(1), F.size(m))
        starts = F.array_compact(F.transform(each, lambda z, i: F.when((i == 0) | z["a"]["alone"] | z["b"]["alone"], i)))
        parts = F.transform(_parts(starts, F.size(m)), lambda p: F.array_join(F.transform(F.slice(m, p["first"] + 1, p["count"]), lambda x: x["line"]), " "))
        return F.when(F.size(m) <= 1, whole).otherwise(parts)

    quiet = (zone == "overview") & ~X.contains_any(F.lower(text), V.RULE_KEYWORDS)
    return X.let(paragraphs, lambda p: F.when(quiet, whole).when(F.size(p) > 1, p).otherwise(X.let(marked, joined)))


def _pieces(units: DataFrame) -> DataFrame:
    """A row for each piece of each unit: piece_no, piece (text, row_number, headers, values)."""
    text = X.strip(F.array_join("unit_lines", "\n"))
    with_text = once(units, unit_text=F.when(F.col("effective").isNull(), text).otherwise("")).where("effective is not null or unit_text <> ''")
    none, in_section = F.lit(None), F.col("seed") == "section"
    pieces = F.when(in_section, _text_pieces(F.col("unit_text"), F.col("zone"))).otherwise(F.array("unit_text"))
    texts = F.transform(pieces, lambda t: F.struct(t.alias("text"), none.cast("int").alias("row_number"), none.cast("array<string>").alias("headers"), none.cast("array<string>").alias("values")))
    rows = _table_rows(F.col("unit_lines"), F.col("effective"), F.col("carried"))
    found = with_text.select(*[c for c in units.columns if c not in ("unit_lines", "effective", "carried")], F.posexplode_outer(F.when(F.col("effective").isNull(), texts).otherwise(rows).cast(f"array<{ROW}>")).alias("piece_no", "piece")).where("piece is not null")
    in_table = F.col("piece.row_number").isNotNull()
    typed = X.chunk_type(F.col("piece.text"), F.col("zone"))
    kind = F.when(in_table | (F.col("seed") == "row"), "component_table_row").when(in_section, typed).when(F.col("seed") == "metadata", "document_metadata").otherwise("prose")
    strategy = F.when(in_table, "markdown_table_row_with_headers").when(in_section, "section_rule_aware").when(F.col("seed") == "row", "table_row_with_headers").when(F.col("seed") == "metadata", "metadata_grouping").otherwise("single_block")
    own = [F.when(F.col("seed") == "row", F.col(c)).otherwise(F.col(f"piece.{c}")).alias(c) for c in ("headers", "values", "row_number")]
    kept = [c for c in found.columns if c not in ("headers", "values", "row_number", "piece", "piece_no", "seed", "section_no", "unit_no")]
    ordinal = F.array((F.col("seed") != "metadata").cast("int") + (F.col("seed") == "whole").cast("int"), "section_no", "unit_no", "piece_no")
    parts = found.select(*found.columns, strategy.alias("strategy"), ordinal.alias("ordinal"))
    return once(parts, chunk_type=kind, text=clean(F.col("piece.text"))).select(*kept, "ordinal", "chunk_type", "text", "strategy", *own)


def _judged(pieces: DataFrame, keep_rejected: bool, send_medium: bool) -> DataFrame:
    """What a piece is worth: chunk columns of those that aren't too thin, or of all as rejected ones. Columns that nobody reads aren't worked out."""
    thin = X.is_suspicious(F.col("text"), F.col("chunk_type"))
    if keep_rejected:
        kept = pieces.withColumn("chunk_type", F.when(thin, "rejected").otherwise(F.col("chunk_type")))
    else:
        kept = pieces.where(~thin)
    zoned = once(kept, chunk_type=F.col("chunk_type"), low=F.lower("text"), semantic_zone=X.zone_override(F.col("zone"), F.col("chunk_type"), F.col("text")))
    score, signals = X.score_and_signals(F.col("low"), F.col("semantic_zone"), F.col("chunk_type"))
    used = once(zoned, score=score).withColumn("likelihood", X.likelihood(F.col("score")))
    used = used.withColumn("llm_usage", X.llm_usage(F.col("chunk_type"), F.col("semantic_zone"), F.col("likelihood"), send_medium))
    names = F.array_distinct("headers")
    last = F.transform(names, lambda n: F.get(F.col("values"), F.size("headers") - F.array_position(F.reverse("headers"), n).cast("int")))
    return used.select(
        "doc_id", "block_no", "ordinal", "page_number", "chunk_type", F.col("title").alias("section_title"), "text", X.excerpt(F.col("text")).alias("source_excerpt"), "extraction_method", "quality_score", "selected_extractor",
        F.col("likelihood").alias("rule_likelihood"), (F.col("llm_usage") == "rule_extraction").alias("send_to_llm"),
        F.coalesce(F.nullif("source_parser", F.lit("")), "extraction_method").alias("source_parser"),
        F.coalesce(F.nullif("source_chunker", F.lit("")), F.when(F.col("extraction_method") == "docling", "docling_hybrid_chunker").otherwise("semantic_chunker")).alias("source_chunker"),
        F.when(F.coalesce("title", F.lit("")) != "", F.array("title")).otherwise(F.array().cast("array<string>")).alias("section_path"),
        "semantic_zone", X.zone_confidence(F.col("semantic_zone"), F.col("score")).alias("semantic_zone_confidence"), X.classification_signals(F.col("semantic_zone"), F.col("text")).alias("classification_signals"),
        "llm_usage", F.col("score").alias("rule_signal_score"), signals.alias("rule_signals"), X.hits(F.col("low"), V.RULE_KEYWORDS).alias("keywords"),
        F.col("headers").alias("table_headers"), F.when(F.size("headers") > 0, F.map_from_arrays(names, last)).alias("table_row"), "row_number", "strategy", X.token_estimate(F.col("text")).alias("token_estimate"), F.length("text").alias("character_count"),
    )


def _numbered(found: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Equal texts of a document folded into one, in the first one's place, and all numbered from 0; ``columns`` are all that is asked for, if not null."""
    if columns is not None:
        needed = {"doc_id", "block_no", "ordinal", "text", "selected_extractor", "extraction_method", "quality_score", *columns}
        found = found.select(*[c for c in found.columns if c in needed])
    item = F.struct("block_no", "ordinal", *[c for c in found.columns if c not in ("doc_id", "block_no", "ordinal")])
    # a chunk whose text is gone under the key has no place; rows are dealt by document already
    keyed = once(found, k=F.sha2(X.dedupe_key(F.col("text")), 256))
    groups = keyed.where(F.col("k") != hashlib.sha256(b"").hexdigest()).groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when((a["block_no"] < b["block_no"]) | ((a["block_no"] == b["block_no"]) & (a["ordinal"] < b["ordinal"])), -1).otherwise(1)).alias("g"))
    rank = lambda c: -F.array_position(F.array(*map(F.lit, reversed(PREFERENCE))), F.coalesce(c["extraction_method"], F.lit("")))
    chosen = lambda c: F.coalesce(c["selected_extractor"] == c["extraction_method"], F.lit(False))
    better = lambda a, b: F.coalesce(preferred(chosen(a), chosen(b), rank(a), rank(b), a["quality_score"], b["quality_score"]), F.lit(False))

    def step(acc: Column, b: Column) -> Column:
        wins = better(acc["kept"], b)
        return F.struct(F.when(wins, b).otherwise(acc["kept"]).alias("kept"), F.when(wins, acc["kept"]["extraction_method"]).otherwise(b["extraction_method"]).alias("lost"))

    begin = F.struct(F.col("g")[0].alias("kept"), F.lit(None).cast("string").alias("lost"))
    folded = groups.select("doc_id", F.col("g")[0]["block_no"].alias("first_block"), F.col("g")[0]["ordinal"].alias("first_ordinal"), F.size("g").alias("copies"), F.aggregate(F.slice("g", 2, 2**30), begin, step).alias("f"))
    place = Window.partitionBy("doc_id").orderBy("first_block", "first_ordinal")
    numbered = folded.select(
        "doc_id",
        (F.row_number().over(place) - 1).alias("chunk_index"),
        F.col("f.kept.*"),
        F.when(F.col("copies") > 1, "kept_after_duplicate").otherwise("kept").alias("deduplication_status"),
        F.col("f.lost").alias("deduplicated_from"),
    ).drop("ordinal", "selected_extractor")
    return numbered if columns is None else numbered.select(*columns)


def chunk_blocks(blocks: DataFrame, keep_rejected: bool = False, send_medium: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """The chunks of ``blocks`` (columns as in ``BLOCK``), numbered in each document in order of block_no; ``columns`` of them, or all.

    Row blocks (``table_row``) are one chunk. Others are cleaned; labelled lines become a metadata chunk and leave the text; then
    each section gives its table rows, under the headers of the table before where a table has none of its own, and
    its paragraphs or rule-aware sentences. Pieces that are too thin go, or stay as ``rejected``. A block that
    leaves nothing else is one chunk of prose.

    * Null or empty text: no chunk. Null methods, qualities or titles stay null; a null quality wins over none.
    * Repeated rows are repeated blocks, whose equal chunks are folded; blocks with equal numbers follow each other in any order of theirs.
    * Texts of any length are read whole; an empty table gives no chunks; further columns aren't read.
    """
    own = [c.split()[0] for c in BLOCK.split(", ")]
    # few bytes are much work, so they are dealt to as many tasks as shuffles have, which are not merged by their size
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.select(*own).repartition(tasks, "doc_id", "block_no")
    ready = once(dealt, text=clean(F.col("text"))).where("text <> ''")
    is_row = F.coalesce(F.col("block_type") == "table_row", F.lit(False))
    even = (F.size("headers") > 0) & (F.size("headers") == F.size("values"))
    told = F.array_join(F.zip_with("headers", "values", lambda h, v: F.concat(h, F.lit(": "), v)), " | ")
    marked = once(ready, is_row=is_row, text=F.when(is_row & even, told).otherwise(F.col("text")))
    marked = once(marked, meta=F.when(~F.col("is_row"), metadata(F.col("text"))))
    rest = F.when(F.col("is_row"), "").when(F.col("meta.text").isNotNull(), without_metadata(F.col("text"))).otherwise(F.col("text"))
    judged = _judged(_pieces(_units(_seeds(once(marked, rest=rest).drop("block_type")))), keep_rejected, send_medium)
    others = F.count_if(F.col("strategy") != "single_block").over(Window.partitionBy("doc_id", "block_no"))
    settled = judged.repartition("doc_id").withColumn("others", others).where("strategy <> 'single_block' or others = 0").drop("others")
    return _numbered(settled, columns)


#: Texts about customers' orders as technical documents have them: labels, headings, tables with and without headers of their own, rules.
_NOTES = """Notes for
{name}
Document ID
DOC-{key}
Release Date: {date}

# 1. Overview
This page lists orders of one customer.

## Compatibility Requirements
Order {first} requires firmware 2.{key} or later. It is quiet. Order {last} is not supported with hub 7. Ask desk 9 for help.

| Component | Minimum Version |
|---|---|
{rows}

| order {first} | 1.{key}.0 |
|:---|---:|
| order {last} | 2.{key}.0 |
Known Issues
Hub {key} fixed an issue of old docks.

More &amp; more docks follow {key}."""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """A block for each customer with orders."""
    line = F.concat(F.lit("| order "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.date_format("o_orderdate", "yyyy.M.d"), F.lit(" |"))
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("o"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("date"))
    found = table(spark, sf, "customer").join(orders, "c_custkey")
    values = {"name": F.col("c_name"), "key": F.col("c_custkey").cast("string"), "date": F.col("date"), "first": F.col("o")[0]["o_orderkey"].cast("string"), "last": F.element_at("o", -1)["o_orderkey"].cast("string"), "rows": F.array_join(F.col("o.line"), "\n")}
    text = F.lit(_NOTES)
    for name, value in values.items():
        text = F.replace(text, F.lit("{%s}" % name), value)
    null = lambda kind: F.lit(None).cast(kind)
    return found.select(
        F.col("c_custkey").cast("long").alias("doc_id"), F.lit(0).alias("block_no"), F.lit(1).alias("page_number"), F.lit("text").alias("block_type"), null("string").alias("section_title"), text.alias("text"), F.lit("text").alias("extraction_method"), F.lit(0.9).alias("quality_score"),
        null("string").alias("selected_extractor"), null("string").alias("source_parser"), null("string").alias("source_chunker"), null("array<string>").alias("headers"), null("array<string>").alias("values"), null("int").alias("row_number"),
    )


#: What the chunks of a customer's notes must be, from the orders themselves: place, type, zone, title and text.
_SQL_NOTES = f"""
WITH o AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS keys, list(strftime(o_orderdate, '%Y.%-m.%-d') ORDER BY o_orderkey) AS dates, strftime(max(o_orderdate), '%Y-%m-%d') AS date FROM orders GROUP BY 1),
c AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, c_name, keys, dates, date, len(keys) AS n FROM customer JOIN o ON k = c_custkey),
req AS (SELECT 'Compatibility Requirements' AS title, 'compatibility_requirements' AS zone),
p AS (
 SELECT doc_id, 0 AS place, 'document_metadata' AS chunk_type, 'document_metadata' AS semantic_zone, 'Notes for ' || c_name AS section_title, 'Document ID: DOC-' || doc_id || chr(10) || 'Release Date: ' || date AS text, NULL AS row_number FROM c
 UNION ALL SELECT doc_id, 1, 'prose', 'body', NULL, 'Notes for' || chr(10) || c_name, NULL FROM c
 UNION ALL SELECT doc_id, 2, 'overview', 'overview', '1. Overview', 'This page lists orders of one customer.', NULL FROM c
 UNION ALL SELECT doc_id, 3, 'minimum_version_requirement', zone, title, 'Order ' || keys[1] || ' requires firmware 2.' || doc_id || ' or later. It is quiet.', NULL FROM c, req
 UNION ALL SELECT doc_id, 4, 'unsupported_configuration', 'unsupported_configurations', title, 'Order ' || keys[n] || ' is not supported with hub 7.', NULL FROM c, req
 UNION ALL SELECT doc_id, 5, zone, zone, title, 'Ask desk 9 for help.', NULL FROM c, req
 UNION ALL SELECT doc_id, 5 + i, 'component_table_row', zone, title, 'Component: order ' || keys[i] || ' | Minimum Version: ' || dates[i], CAST(i AS INTEGER) FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c), req
 UNION ALL SELECT doc_id, 6 + n, 'component_table_row', zone, title, 'Component: order ' || keys[1] || ' | Minimum Version: 1.' || doc_id || '.0', 1 FROM c, req
 UNION ALL SELECT doc_id, 7 + n, 'component_table_row', zone, title, 'Component: order ' || keys[n] || ' | Minimum Version: 2.' || doc_id || '.0', 2 FROM c, req
 UNION ALL SELECT doc_id, 8 + n, 'fixed_issue', 'fixed_issues', 'Known Issues', 'Hub ' || doc_id || ' fixed an issue of old docks.', NULL FROM c
 UNION ALL SELECT doc_id, 9 + n, 'known_issues', 'known_issues', 'Known Issues', 'More & more docks follow ' || doc_id || '.', NULL FROM c)"""


@query("chunk_blocks", f"""{_SQL_NOTES},
s AS (SELECT doc_id, CAST(place AS INTEGER) AS chunk_index, chunk_type, semantic_zone, section_title, text, row_number, {SQL_SCORE} - CASE WHEN chunk_type = 'document_metadata' THEN 3 WHEN chunk_type = 'overview' THEN 2 ELSE 0 END AS score FROM (SELECT *, lower(text) AS low FROM p))
SELECT * EXCLUDE (score), score AS rule_signal_score, CASE WHEN chunk_type = 'document_metadata' THEN 'global_context' WHEN chunk_type = 'overview' THEN 'background_context' WHEN chunk_type IN ('minimum_version_requirement', 'unsupported_configuration', 'component_table_row', 'fixed_issue')
 THEN CASE WHEN {SQL_LEVEL} IN ('high', 'medium') THEN 'rule_extraction' ELSE 'evidence_only' END WHEN {SQL_LEVEL} = 'high' THEN 'rule_extraction' WHEN {SQL_LEVEL} = 'low' THEN 'evidence_only' ELSE 'ignore' END AS llm_usage FROM s""")
def chunks_of_notes(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_blocks(notes(spark, sf), columns=("doc_id", "chunk_index", "chunk_type", "semantic_zone", "section_title", "text", "row_number", "rule_signal_score", "llm_usage"))


@query("chunked_tables", f"""{_SQL_NOTES} SELECT doc_id, count(*) AS rows, count(*) FILTER (row_number = 1) AS tables, max(text) AS last FROM p WHERE chunk_type = 'component_table_row' GROUP BY doc_id""")
def chunked_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tables, of which the second has the first one's headers."""
    found = chunk_blocks(notes(spark, sf), columns=("doc_id", "chunk_type", "text", "row_number")).where("chunk_type = 'component_table_row'")
    return found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("row_number") == 1).alias("tables"), F.max("text").alias("last"))


@query("markdown_tables", f"""{_SQL_NOTES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS row_no, text AS row FROM p WHERE chunk_type = 'component_table_row'""")
def markdown_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of Markdown tables in order, as ``header: value | header: value``."""
    rows = chunk_blocks(notes(spark, sf), columns=("doc_id", "chunk_index", "chunk_type", "text")).where("chunk_type = 'component_table_row'")
    place = Window.partitionBy("doc_id").orderBy("chunk_index")  # the chunks of one document
    return rows.select("doc_id", F.row_number().over(place).cast("long").alias("row_no"), F.col("text").alias("row"))


@query("metadata_pairs", f"""{_SQL_NOTES} SELECT doc_id, section_title AS title, l[1] AS label, l[2] AS value FROM (SELECT doc_id, section_title, string_split(unnest(string_split(text, chr(10))), ': ') AS l FROM p WHERE chunk_type = 'document_metadata')""")
def metadata_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with the values that stand beside them or on the line behind."""
    cleaned = once(notes(spark, sf).select("doc_id", "text"), text=clean(F.col("text")))
    found = once(cleaned, meta=metadata(F.col("text"))).where("meta.text is not null")
    pairs = found.select("doc_id", F.col("meta.title").alias("title"), F.explode(split_lines(F.col("meta.text"))).alias("line")).withColumn("pair", F.split("line", ": ", 2))
    return pairs.select("doc_id", "title", F.col("pair")[0].alias("label"), F.col("pair")[1].alias("value"))


@query("chunk_documents")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents, each as one block."""
    null = lambda kind: F.lit(None).cast(kind)
    docs = table(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("block_no"), F.lit(1).alias("page_number"), F.lit("text").alias("block_type"), null("string").alias("section_title"), "text", F.lit("text").alias("extraction_method"), F.lit(0.9).alias("quality_score"),
        null("string").alias("selected_extractor"), null("string").alias("source_parser"), null("string").alias("source_chunker"), null("array<string>").alias("headers"), null("array<string>").alias("values"), null("int").alias("row_number"),
    )
    return chunk_blocks(docs, columns=("doc_id", "chunk_index", "chunk_type", "semantic_zone", "text", "llm_usage", "deduplication_status"))
