"""Chunk operators over texts: scores, zones, usage, lanes, sections, sentences, tables and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vocabulary as V
from tessera.plans.catalogue import small
from tessera.plans.registry import query, table
from tessera.plans.stages import once


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join("contains(%s, '%s')" % (text, w.replace("'", "''")) for w in words) + ")"


def sql_hits(text: str, words) -> str:
    return "list_filter([" + ", ".join("CASE WHEN contains(%s, '%s') THEN '%s' END" % (text, w, w) for w in words) + "], lambda x: x IS NOT NULL)"


SQL_COMPACT = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


def sql_words(text: str) -> str:
    c = SQL_COMPACT.format(text)
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


SQL_SCORE = f"""
(CASE WHEN {sql_any('low', V.REQUIRE_WORDS)} THEN 3 ELSE 0 END + CASE WHEN {sql_any('low', V.UNSUPPORTED_WORDS)} THEN 3 ELSE 0 END
 + CASE WHEN {sql_any('low', V.MINIMUM_WORDS)} THEN 2 ELSE 0 END + CASE WHEN {sql_any('low', V.FIX_WORDS)} THEN 2 ELSE 0 END
 + CASE WHEN {sql_any('low', V.COMPONENT_WORDS)} THEN 1 ELSE 0 END + CASE WHEN regexp_matches(low, '{V.VERSION}') THEN 1 ELSE 0 END)"""
SQL_LEVEL = "CASE WHEN score >= 5 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END"
SQL_LINES = "SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)"
SQL_HEADING = r"(trim(line) <> '' AND (starts_with(trim(line), '#') OR regexp_matches(trim(line), '^[0-9]+(\.[0-9]+)*\.\s+\S+') OR regexp_matches(trim(line), '(?i)^version\s+v?[0-9]+(\.[0-9]+)*') OR regexp_replace(lower(trim(line)), ':+$', '') IN (%s)))" % ", ".join(f"'{t}'" for t in V.SECTION_TITLES)


def scored(docs: DataFrame, zone: Column | str = "body", kind: Column | str = "prose") -> DataFrame:
    """``docs`` (text) with score, signals and likelihood."""
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return docs.withColumn("s", X.signal_score(F.col("text"), lit(zone), lit(kind))).select(*docs.columns, "s.score", "s.signals", "s.likelihood")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line), lines counted from 0; a null text has none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def sections(docs: DataFrame) -> DataFrame:
    """Lines with section_no (headings so far), is_heading and the title of the last heading."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines(docs).withColumn("is_heading", X.is_heading(F.col("line")))
    return marked.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(order)).withColumn("title", F.last(F.when(F.col("is_heading"), F.trim("line")), ignorenulls=True).over(order))


def preferred(kept_selected: Column, new_selected: Column, kept_priority: Column, new_priority: Column, kept_quality: Column, new_quality: Column) -> Column:
    """Whether a new copy takes the place of the one kept: selected first, then by smaller priority number, or else by quality."""
    return F.when(kept_selected != new_selected, new_selected).when(kept_selected, False).when(new_priority < kept_priority, True).otherwise(new_quality > kept_quality)


def deduplicate(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, text, selected, priority, quality) with kept and duplicate_of.

    Within a document equal texts are folded in order of chunk_index: the kept chunk is replaced by a later one
    that is selected while it isn't, or, both alike, has a smaller priority number, or else a higher quality.
    The fold isn't a total order, so it is an aggregation over each key's ordered group, which a document bounds.
    """
    keyed = chunks.withColumn("k", X.dedupe_key(F.col("text")))
    item = F.struct("chunk_index", "selected", "priority", "quality")

    def better(kept: Column, new: Column) -> Column:
        return preferred(kept["selected"], new["selected"], kept["priority"], new["priority"], kept["quality"], new["quality"])

    groups = keyed.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(item)).alias("g"))
    kept = F.aggregate(F.slice("g", F.lit(2), F.greatest(F.size("g") - 1, F.lit(0))), F.col("g")[0], lambda a, b: F.when(better(a, b), b).otherwise(a))
    winners = groups.select("doc_id", "k", kept["chunk_index"].alias("winner"), F.size("g").alias("copies"))
    return keyed.join(winners, ["doc_id", "k"]).select("doc_id", "chunk_index", (F.col("chunk_index") == F.col("winner")).alias("kept"), "winner", "copies")


@query("rule_likelihood_by_source", f"""
WITH s AS (SELECT source, {SQL_SCORE} AS score FROM (SELECT source, lower(text) AS low FROM documents))
SELECT source, {SQL_LEVEL} AS likelihood, count(*) AS documents, sum(score) AS total_score FROM s GROUP BY ALL""")
def rule_likelihood_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return scored(table(spark, sf, "documents")).groupBy("source", "likelihood").agg(F.count("*").alias("documents"), F.sum("score").alias("total_score"))


@query("rule_signal_score", f"""
WITH s AS (SELECT doc_id, low, {SQL_SCORE} AS score FROM (SELECT doc_id, lower(text) AS low FROM documents))
SELECT doc_id, score, {SQL_LEVEL} AS likelihood, array_to_string({sql_hits('low', V.COMPONENT_WORDS)}, ',') AS component_hits FROM s""")
def rule_signal_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return scored(docs).select("doc_id", "score", "likelihood", F.array_join(X.hits(F.lower("text"), V.COMPONENT_WORDS), ",").alias("component_hits"))


@query("rule_signal_score_custom", """
SELECT doc_id, CASE WHEN contains(low, 'the') THEN 3 ELSE 0 END + CASE WHEN contains(low, 'and') THEN 2 ELSE 0 END + CASE WHEN contains(low, 'der ') THEN -2 ELSE 0 END AS score
FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
def rule_signal_score_custom(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    w = lambda words, n: F.when(X.contains_any(low, words), n).otherwise(0)
    return table(spark, sf, "documents").select("doc_id", (w(["the"], 3) + w(["and"], 2) + w(["der "], -2)).alias("score"))


@query("keyword_hits", f"SELECT doc_id, array_to_string({sql_hits('lower(text)', V.RULE_KEYWORDS)}, ',') AS keywords FROM documents")
def keyword_hits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.hits(F.lower("text"), V.RULE_KEYWORDS), ",").alias("keywords"))


_SQL_TYPE = f"""CASE WHEN {sql_any('low', V.UNSUPPORTED_WORDS)} THEN 'unsupported_configuration'
 WHEN contains(low, 'with ') AND {sql_any('low', V.REQUIRE_WORDS)} THEN 'compound_requirement' WHEN {sql_any('low', V.MINIMUM_WORDS)} THEN 'minimum_version_requirement'
 WHEN {sql_any('low', V.REQUIRE_WORDS)} THEN 'compatibility_requirement' WHEN {sql_any('low', V.FIX_PHRASES)} THEN 'fixed_issue' ELSE 'prose' END"""


@query("zone_and_usage", f"""
WITH t AS (SELECT doc_id, low, {_SQL_TYPE} AS chunk_type, {SQL_SCORE} AS score FROM (SELECT doc_id, lower(text) AS low FROM documents)),
z AS (SELECT *, CASE WHEN chunk_type = 'unsupported_configuration' THEN 'unsupported_configurations' WHEN chunk_type IN ('minimum_version_requirement', 'compatibility_requirement', 'compound_requirement') THEN 'compatibility_requirements'
 WHEN chunk_type = 'fixed_issue' THEN 'fixed_issues' WHEN contains(low, 'before upgrading') OR contains(low, 'after upgrading') THEN 'upgrade_requirements' ELSE 'body' END AS zone, {SQL_LEVEL} AS likelihood FROM t)
SELECT doc_id, chunk_type, zone, likelihood, CASE WHEN chunk_type <> 'prose' THEN CASE WHEN likelihood IN ('high', 'medium') THEN 'rule_extraction' ELSE 'evidence_only' END
 WHEN likelihood = 'high' THEN 'rule_extraction' WHEN likelihood = 'low' THEN 'evidence_only' ELSE 'ignore' END AS usage, round(least(0.95, 0.55 + greatest(score, 0) * 0.06), 6) AS confidence FROM z""")
def zone_and_usage(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("chunk_type", X.chunk_type(F.col("text"), F.lit("body")))
    docs = scored(docs.withColumn("zone", X.zone_override(F.lit("body"), F.col("chunk_type"), F.col("text"))), F.col("zone"), F.col("chunk_type"))
    usage = X.llm_usage(F.col("chunk_type"), F.col("zone"), F.col("likelihood"))
    return docs.select("doc_id", "chunk_type", "zone", "likelihood", usage.alias("usage"), F.round(X.zone_confidence(F.col("zone"), F.col("score")), 6).alias("confidence"))


@query("classification_signals", f"""SELECT doc_id, array_to_string(list_concat(['classified as body'], list_transform({sql_hits('lower(text)', V.BODY_SIGNALS)}, lambda x: 'body contains ' || x)), ';') AS signals FROM documents""")
def classification_signals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.classification_signals(F.lit("body"), F.col("text")), ";").alias("signals"))


@query("token_estimate", f"SELECT doc_id, greatest(1, CAST(floor({sql_words('text')} * 4 / 3) AS INTEGER)) AS tokens, length(text) AS characters FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.length("text").alias("characters"))


@query("source_excerpt", f"SELECT doc_id, substring({SQL_COMPACT.format('text')}, 1, 500) AS excerpt FROM documents")
def source_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"))


#: The references that the pages have; the query resolves all of HTML 5, which unit tests compare.
_SQL_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query("text_clean", rf"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(translate({_SQL_UNESCAPE.format('html')}, '•–— ', '--- '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))) AS cleaned_md5 FROM pages""")
def text_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(X.clean(F.col("html"))).alias("cleaned_md5"))


@query("table_hint", rf"""SELECT doc_id, round(least(1.0, CASE WHEN {sql_any('lower(text)', V.TABLE_WORDS)} THEN 0.5 ELSE 0 END
 + CASE WHEN length(text) - length(replace(text, '|', '')) >= 4 OR length(text) - length(replace(text, chr(9), '')) >= 4 THEN 0.4 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(text, chr(10)), lambda l: {sql_words('l')} >= 4)) >= 3 THEN 0.2 ELSE 0 END), 6) AS hint FROM documents""")
def table_hint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(X.table_hint(F.col("text")), 6).alias("hint"))


@query("line_units", f"SELECT doc_id, count(*) AS lines, sum(CASE WHEN {SQL_HEADING} THEN 1 ELSE 0 END) AS headings, max(length(line)) AS longest FROM ({SQL_LINES}) GROUP BY doc_id")
def line_units(spark: SparkSession, sf: str) -> DataFrame:
    found = lines(table(spark, sf, "documents"))
    return found.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(X.is_heading(F.col("line")).cast("int")).alias("headings"), F.max(F.length("line")).alias("longest"))


@query("section_assignment", f"""
WITH l AS (SELECT doc_id, line_no, line, {SQL_HEADING} AS h FROM ({SQL_LINES})),
s AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM l)
SELECT doc_id, section_no, max(CASE WHEN h THEN trim(line) END) AS title, count(*) AS lines, min(line_no) AS first_line FROM s GROUP BY doc_id, section_no""")
def section_assignment(spark: SparkSession, sf: str) -> DataFrame:
    found = sections(table(spark, sf, "documents"))
    return found.groupBy("doc_id", "section_no").agg(F.max("title").alias("title"), F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


@query("sentence_units", r"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '([.!?]) ([A-Z0-9])', '\1' || chr(31) || '\2', 'g'), '([.!?]) ([A-Z0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)) AS a FROM documents)
SELECT doc_id, len(a) AS sentences, max(length(x)) AS longest FROM (SELECT doc_id, a, unnest(a) AS x FROM s) GROUP BY doc_id, len(a)""")
def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", X.sentences(F.col("text")).alias("a"))
    return found.select("doc_id", F.size("a").alias("sentences"), F.array_max(F.transform("a", lambda x: F.length(x))).alias("longest"))


@query("suspicious_lines", rf"""
WITH l AS (SELECT doc_id, line, trim(line) AS s, regexp_replace(trim(line), '^:+|:+$', '', 'g') AS lab FROM ({SQL_LINES}))
SELECT doc_id, count(*) AS lines, count(*) FILTER (line = '' OR regexp_matches(s, '(?i)^v?[0-9]+(\.[0-9]+)+(\.x)?$') OR regexp_matches(s, '^[0-9]{{1,2}}\s+[A-Za-z]+\s+[0-9]{{4}}$') OR regexp_matches(s, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR regexp_matches(s, '^[0-9]+$')
 OR lower(lab) IN ({", ".join(f"'{x}'" for x in V.METADATA_LABELS)}) OR (NOT regexp_matches(lab, '[.!?]') AND {sql_words('lab')} <= 4 AND NOT regexp_matches(lab, '[0-9]')) OR {SQL_HEADING}
 OR ({sql_words('line')} <= 2 AND NOT {sql_any('lower(line)', V.RULE_KEYWORDS)} AND NOT regexp_matches(line, '[.!?]'))) AS suspicious FROM l GROUP BY doc_id""")
def suspicious_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = lines(table(spark, sf, "documents"))
    return found.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(X.is_suspicious(F.col("line"), F.lit("prose")), 1)).alias("suspicious"))


_SQL_LANE_LOW = "lower(text)"


@query("processing_lanes", rf"""
WITH b AS (SELECT doc_id, source, lower(text) AS low, {SQL_COMPACT.format('lower(text)')} AS c, lower(array_to_string(regexp_extract_all(text, '{V.TABLE_HEADER}', 1), ' ')) AS h FROM documents)
SELECT doc_id, CASE WHEN c = '' OR c IN ('copyright', 'table of contents') OR regexp_matches(c, '^[0-9]{{1,4}}$') THEN 'ignore'
 WHEN contains(low, 'switch model') AND contains(low, 'introductory release') THEN 'deterministic_support_matrix' WHEN contains(low, 'network module') AND contains(low, 'introductory release') THEN 'deterministic_support_matrix'
 WHEN contains(low, 'not supported') AND (contains(h, 'feature') OR starts_with(low, 'feature:')) THEN 'deterministic_table_rule' WHEN contains(h, 'rommon') AND contains(h, 'version') THEN 'deterministic_support_matrix'
 WHEN {sql_any('low', V.RULE_LANGUAGE)} THEN 'llm_prose_rule' ELSE 'evidence_only' END AS lane, h AS headers FROM b""")
def processing_lanes(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", X.lane(F.col("text"), F.lit("body")).alias("d"))
    return found.select("doc_id", "d.lane", F.lower(F.array_join("d.headers", " ")).alias("headers"))


def _chunks(docs: DataFrame) -> DataFrame:
    """Paragraph lines as chunks of two made-up extractors, for fold tests on real text."""
    cell = lines(docs).where(F.trim("line") != "")
    return cell.select(
        "doc_id", F.col("line_no").alias("chunk_index"), F.col("line").alias("text"), (F.pmod("line_no", F.lit(5)) == 3).alias("selected"),
        F.pmod("line_no", F.lit(3)).alias("priority"), (F.pmod(F.col("line_no") * 7, F.lit(10)) / 10).alias("quality"),
    )


@query("chunk_dedupe", f"""
WITH k AS (SELECT doc_id, CAST(line_no AS INTEGER) AS i, lower({SQL_COMPACT.format('line')}) AS k, line_no % 5 = 3 AS s, line_no % 3 AS p, line_no * 7 % 10 AS q FROM ({SQL_LINES}) WHERE trim(line) <> ''),
g AS (SELECT doc_id, k, list({{'i': i, 's': s, 'p': p, 'q': q}} ORDER BY i) AS g, CAST(count(*) AS INTEGER) AS copies FROM k GROUP BY ALL),
w AS (SELECT doc_id, k, copies, list_reduce(g, lambda a, b: CASE WHEN CASE WHEN a.s <> b.s THEN b.s WHEN a.s THEN false WHEN b.p < a.p THEN true ELSE b.q > a.q END THEN b ELSE a END).i AS winner FROM g)
SELECT doc_id, i AS chunk_index, i = winner AS kept, winner, copies FROM k JOIN w USING (doc_id, k)""")
def chunk_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicate(_chunks(table(spark, sf, "documents")))


@query("exact_duplicate_texts", """
SELECT doc_id, k AS text_md5, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS copy_no FROM (SELECT doc_id, md5(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) AS k FROM documents)""".replace("\\\\", "\\"))
def exact_duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "documents").select("doc_id", F.md5(F.lower(X.compact(F.col("text")))).alias("text_md5"))
    return keyed.withColumn("copy_no", F.row_number().over(Window.partitionBy("text_md5").orderBy("doc_id")))


@query("grounding_contains", """
SELECT b.item_id, count(d.doc_id) AS documents, min(d.doc_id) AS first_doc FROM (SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM benchmark) b
LEFT JOIN (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents) d ON contains(d.t, b.t) GROUP BY b.item_id""")
def grounding_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that quote each passage, as a part of their text.

    A passage's first and last word may be parts of a document's words, those between are words. So both sides
    meet on up to eight words from the second one on, and containment is then exact. Only runs that some passage begins with leave a document's row. Passages of one or two
    words have none between; each of them is looked for in each text.
    """
    form = lambda t: F.lower(X.compact(F.col(t)))
    items = once(table(spark, sf, "benchmark"), t=form("text")).select("item_id", "t", F.split("t", " ").alias("w")).withColumn("inner", F.least(F.size("w") - 2, F.lit(8)))
    docs = once(table(spark, sf, "documents"), dt=form("text")).select("doc_id", "dt")
    keyed = items.where("inner > 0").select("item_id", F.col("inner"), F.xxhash64(F.array_join(F.slice("w", F.lit(2), F.col("inner")), " ")).alias("k"))
    sizes = [r[0] for r in keyed.select("inner").distinct().collect()]  # eight at most
    found = items.where("inner <= 0 and t <> ''").join(docs, F.contains("dt", F.col("t"))).select("item_id", "doc_id")
    if sizes:
        worded = once(docs, w=F.split("dt", " "))

        def runs(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " ")))

        each = worded.select("doc_id", F.explode(F.array_distinct(F.concat(*map(runs, sizes)))).alias("k"))
        hits = each.join(small(keyed.select("item_id", "k")), "k").select("doc_id", "item_id").distinct()
        exact = hits.join(docs, "doc_id").join(small(items.select("item_id", "t")), "item_id").where(F.contains("dt", F.col("t")))
        found = found.unionByName(exact.select("item_id", "doc_id"))
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(counts, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), "first_doc")
