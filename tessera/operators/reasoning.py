"""Questions, evidence, root causes, guardrails and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.functions.text import contains_any, hits
from tessera.operators.chunks import sql_any, sql_hits
from tessera.plans.registry import query, table
from tessera.plans.stages import once

_first = lambda pattern, text: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def entities(question: Column) -> Column:
    """Struct of what a question names: device, component types, versions, rule, document, vendor, risk."""
    named = lambda words: question.rlike(r"(?i)\b(" + "|".join(sorted(words, key=len, reverse=True)) + r")\b")
    versions = F.array_distinct(F.regexp_extract_all(question, F.lit(r"(?i)(?<![A-Za-z0-9])v?([0-9]+(?:\.[0-9A-Za-z_-]+)+)"), 1))
    risk = reduce(lambda c, r: c.when(question.rlike(rf"(?i)\b{r}\b"), r), V.RISKS[1:], F.when(question.rlike(rf"(?i)\b{V.RISKS[0]}\b"), V.RISKS[0]))
    return F.struct(
        _first(r"(?i)\b((?:Laptop|Device|Endpoint|Workstation|Server)[-_]?[A-Za-z0-9]+)\b", question).alias("device"),
        F.array_compact(F.array(*[F.when(named(words), F.lit(c)) for c, words in V.QUESTION_COMPONENTS])).alias("component_types"),
        versions.alias("versions"),
        F.upper(_first(r"(?i)\b((?:CRULE|RULE)-[A-Za-z0-9-]+)\b", question)).alias("rule"),
        F.upper(_first(r"(?i)\b(DOC-[A-Za-z0-9-]+)\b", question)).alias("document"),
        _first(r"\bvendor\s+([A-Z][A-Za-z0-9&.-]+)", question).alias("vendor"),
        risk.alias("risk"),
    )


def rank_intents(questions: DataFrame, signals: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, intent, score, confidence, rank) of questions (question_id, text) by ``signals`` (intent, signal, weight, priority).

    A signal of several words counts as a substring, of one word as a word; a negative weight takes away. Intents of 45 per
    cent of the best score and 1 at least stay, three at most, ties by name. The signals are a catalogue and are held as
    one array of each row, so questions aren't paired with them.
    """
    rows = sorted(signals.collect(), key=lambda r: (r["intent"], r["signal"]))  # a catalogue
    low = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["intent"], []).append(r)
    match = lambda s: F.contains(low, F.lit(s)) if " " in s else low.rlike(rf"\b{s}\b")
    scores = []
    for intent, own in by.items():
        score = reduce(lambda a, b: a + b, [F.when(match(r["signal"]), F.lit(float(r["weight"]))).otherwise(0.0) for r in own])
        found = reduce(lambda a, b: a + b, [F.when(match(r["signal"]) & F.lit(r["weight"] > 0), 1).otherwise(0) for r in own])
        scores.append(F.struct(F.lit(intent).alias("intent"), F.when((found > 0) & (score > 0), score + own[0]["priority"] / 100).alias("score"), found.alias("hits")))
    each = questions.select("question_id", F.explode(F.array(*scores)).alias("s")).select("question_id", "s.*").where("score IS NOT NULL")
    w = Window.partitionBy("question_id")
    kept = each.withColumn("top", F.max("score").over(w)).where(F.col("score") >= F.greatest(F.lit(1.0), 0.45 * F.col("top")))
    ranked = kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "intent"))).where(F.col("rank") <= most)
    return ranked.select("question_id", "intent", "score", F.least(F.lit(0.99), 0.56 + 0.11 * F.col("score") + 0.02 * F.col("hits")).alias("confidence"), "rank")


def scope(question: Column) -> Column:
    """Struct (allowed, is_injection, confidence, in_hits, out_hits): injection, then words in scope, then words out of it, else allowed."""
    q = F.lower(F.trim(question))
    bad = reduce(lambda a, b: a | b, [q.rlike(p) for p in V.INJECTIONS])
    inside, outside = F.size(hits(q, V.IN_SCOPE)), F.size(hits(q, V.OUT_OF_SCOPE))
    sure = F.when(bad, 1.0).when(inside > 0, F.least(F.lit(0.99), 0.6 + 0.08 * inside)).when(outside > 0, F.least(F.lit(0.99), 0.7 + 0.1 * outside)).otherwise(0.5)
    return F.struct((~bad & ((inside > 0) | (outside == 0))).alias("allowed"), bad.alias("is_injection"), sure.alias("confidence"), inside.alias("in_hits"), outside.alias("out_hits"))


def rank_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence (report_id, ord, evidence_type, confidence) with score and rank: base of its type times a half plus half its confidence, ties in order."""
    base = reduce(lambda c, p: c.when(F.col("evidence_type") == p[0], F.lit(p[1])), V.EVIDENCE_BASE[1:], F.when(F.col("evidence_type") == V.EVIDENCE_BASE[0][0], F.lit(V.EVIDENCE_BASE[0][1]))).otherwise(50)
    scored = evidence.withColumn("score", base * (0.5 + 0.5 * F.col("confidence")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("score"), "ord")))


def evidence_graph(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (report_id, label, node_id, kind), the first row of a label counting, and edges (report_id, source, target, relationship, weight)."""
    node_id = lambda c: F.concat(F.lit("N-"), F.substring(F.sha2(F.lower(c), 256), 1, 12))
    labels = evidence.select("report_id", "ord", F.col("entity").alias("label"), F.lit("entity").alias("kind")).union(evidence.where("target IS NOT NULL").select("report_id", "ord", "target", F.lit("target")))
    first = F.row_number().over(Window.partitionBy("report_id", F.lower("label")).orderBy("ord", "kind"))
    nodes = labels.withColumn("r", first).where("r = 1").select("report_id", "label", node_id(F.col("label")).alias("node_id"), "kind")
    ends = evidence.where("target IS NOT NULL").select("report_id", "ord", node_id(F.col("entity")).alias("source"), node_id(F.col("target")).alias("target"), "relationship", F.col("confidence").alias("weight"))
    earliest = F.row_number().over(Window.partitionBy("report_id", "source", "target", "relationship").orderBy("ord"))
    return nodes, ends.withColumn("r", earliest).where("r = 1").drop("r", "ord")


def pick_severity(text: Column, default: Column) -> Column:
    """The level of the first severity word that a text has as a word, in the order of the table; else the default."""
    return F.coalesce(*(F.when(text.rlike(rf"(?i)\b{word}\b"), F.lit(level)) for word, level in V.SEVERITY_WORDS), default)


def detect_violations(reports: DataFrame, patterns=V.VIOLATION_PATTERNS) -> DataFrame:
    """(report_id, root_cause, violation, risk, pattern_no) of reports (report_id, text): keywords as substrings, one row for each cause and violation, by the first pattern.

    Where the text has a severity word, its level is every risk. All is done within a report's row.
    """
    low = once(reports.select("report_id", F.lower("text").alias("low")), low=F.col("low"), said=pick_severity(F.col("low"), F.lit(None).cast("string")))
    hits = [F.when(F.contains("low", F.lit(k)), F.struct(F.lit(c).alias("root_cause"), F.lit(v).alias("violation"), F.coalesce("said", F.lit(r)).alias("risk"), F.lit(i).alias("pattern_no"))) for i, (k, c, v, r) in enumerate(patterns)]
    # patterns of one cause and violation stand in order: the first of them that is found counts
    kinds = dict.fromkeys((c, v) for _, c, v, _ in patterns)
    firsts = [F.coalesce(*(h for h, (_, c, v, _) in zip(hits, patterns, strict=True) if (c, v) == kind)) for kind in kinds]
    return low.select("report_id", F.explode(F.array_compact(F.array(*firsts))).alias("d")).select("report_id", "d.*")


def detect_with_evidence(packages: DataFrame, patterns=V.VIOLATION_PATTERNS) -> DataFrame:
    """Detections of packages (report_id, question, evidence), evidence an array of (evidence_type, entity, target, confidence, source_excerpt, description, rule_type, relationship).

    (report_id, detection_no, root_cause, violation, component, risk, confidence, label): first those that violation and risk evidence
    makes by its type, of its entity or else target, then those of keywords in the question and all evidence, of the first
    entity that names one. Of detections with one cause, violation and component the first counts.

    * Null fields are empty; a null confidence is 0.8; null evidence has none. Types other than the two make none by themselves.
    * Repeated packages have their detections each. An empty table gives none.
    """
    text = lambda e, *names: F.concat_ws(" ", *(F.coalesce(e[n], F.lit("")) for n in names))
    every = F.coalesce("evidence", F.array().cast(V.EVIDENCE_ROWS))
    named = F.filter(F.transform(every, lambda e: F.coalesce(e["entity"], F.lit(""))), lambda x: ~F.lower(x).isin("", "device", "unknown"))
    corpus = F.lower(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.transform(every, lambda e: text(e, "source_excerpt", "description", "rule_type", "entity", "relationship"))))
    base = once(packages.select("report_id", "question", "evidence"), low=corpus, all_=every, entity=F.coalesce(F.get(named, F.lit(0)), F.lit("device")))
    ready = once(base, said=pick_severity(F.col("low"), F.lit(None).cast("string")))

    def found(cause: str, violation: str, component: Column, risk: Column, confidence: Column, label: str) -> Column:
        return F.struct(F.lit(cause).alias("root_cause"), F.lit(violation).alias("violation"), component.alias("component"), risk.alias("risk"), confidence.alias("confidence"), F.lit(label).alias("label"))

    def typed(e: Column) -> Column:
        component = F.coalesce(F.nullif(e["entity"], F.lit("")), F.nullif(e["target"], F.lit("")), F.lit("unknown"))
        confidence = F.coalesce(e["confidence"], F.lit(0.8))
        content = text(e, "source_excerpt", "description", "rule_type")
        violation = found("RC-VERSION-MISMATCH", "VIOL-VERSION", component, pick_severity(content, F.lit("High")), confidence, "ViolationEvidence")
        return F.when(e["evidence_type"] == "ViolationEvidence", violation).when(e["evidence_type"] == "RiskEvidence", found("RC-UNKNOWN-STATE", "VIOL-COMPLIANCE", component, F.lit("High"), confidence, "RiskEvidence"))

    by_word = [F.when(F.contains("low", F.lit(k)), found(c, v, F.col("entity"), F.coalesce("said", F.lit(r)), F.lit(0.75), V.VIOLATION_LABELS[i])) for i, (k, c, v, r) in enumerate(patterns)]
    told = once(ready, d=F.concat(F.array_compact(F.transform("all_", typed)), F.array_compact(F.array(*by_word))))
    same = lambda a, b: (a["root_cause"] == b["root_cause"]) & (a["violation"] == b["violation"]) & (a["component"] == b["component"])
    # detections of one package: evidence and some dozens of keywords
    first = F.filter("d", lambda x, i: ~F.exists(F.slice("d", F.lit(1), i), lambda y: same(x, y)))
    return told.select("report_id", F.posexplode(first).alias("detection_no", "x")).select("report_id", "detection_no", "x.*")


def assess_risk(detections: DataFrame, devices: int = 1) -> DataFrame:
    """Detections (report_id, component, risk, confidence) with level 0 to 4 adjusted: a step down below 0.6, a step up where a component has over two, fleets to the top from High."""
    level = F.array_position(F.array(*[F.lit(r) for r in V.RISKS]), F.col("risk")) - 1
    low = F.when(F.col("confidence") < 0.6, F.greatest(level - 1, F.lit(0))).otherwise(level)
    many = F.count("*").over(Window.partitionBy("report_id", "component")) > 2
    up = F.when(many, F.least(low + 1, F.lit(4))).otherwise(low)
    out = F.when((F.lit(devices) > 5) & (up >= 3), 4).otherwise(up)
    return detections.withColumn("level", out.cast("int")).withColumn("severity_score", F.col("level") * 25)


def hallucination(answer: Column, recommendation: Column, expected: Column, sources: Column, compatibility: Column, evidence: Column) -> Column:
    """Struct (score, issues): missing and unknown citations, unsupported recommendation and compatibility claims, unknown identifiers."""
    ident = F.lit(r"(?i)(\b(?:Laptop|Device|Server|Rule|CR-)[-_]?[A-Za-z0-9.-]+\b|\bv?\d+\.\d+(?:\.\d+)?\b)")
    none = lambda text, keys: ~F.exists(keys, lambda k: F.contains(text, k))
    cases = [
        (none(answer, expected) & (F.size(F.array_intersect(expected, sources)) == 0), "missing citations", 0.30),
        (F.size(F.array_except(sources, expected)) > 0, "unknown evidence references", 0.20),
        ((F.coalesce(recommendation, F.lit("")) != "") & none(recommendation, expected), "recommendation unsupported", 0.25),
        (contains_any(F.lower(answer), ("compatible", "incompatible", "requires", "required version", "dependency")) & none(answer, compatibility), "compatibility claim unsupported", 0.20),
        (F.size(F.array_except(F.regexp_extract_all(answer, ident, 1), F.regexp_extract_all(evidence, ident, 1))) > 0, "unknown entities introduced", 0.15),
    ]
    score = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, _, w in cases])
    return F.struct(F.least(F.lit(1.0), score).alias("score"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n, _ in cases])).alias("issues"))


def evaluation_confidence(mean_evidence: Column, count: Column, valid: Column, hallucinated: Column, reasoning: Column) -> Column:
    return 0.25 * mean_evidence + 0.15 * F.least(F.lit(1.0), count / 3.0) + 0.25 * valid + 0.20 * (1 - hallucinated) + 0.15 * reasoning


# -- queries over the driver's tables ---------------------------------------------------------------------------------

SQL_QUESTIONS = """(SELECT conv_id * 100 + turn AS question_id, CASE turn % 4 WHEN 0 THEN 'Why is Laptop-' || conv_id || ' bios 1.' || turn || '.3 failing? ' WHEN 1 THEN 'Is the Windows driver ok under RULE-' || conv_id || ' critical ' WHEN 2 THEN 'weather and joke ' ELSE '' END || text AS text FROM conversations WHERE role = 'user')"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").where("role = 'user'")
    k, conv, turn = F.col("turn") % 4, F.col("conv_id").cast("string"), F.col("turn").cast("string")
    lead = (
        F.when(k == 0, F.concat(F.lit("Why is Laptop-"), conv, F.lit(" bios 1."), turn, F.lit(".3 failing? ")))
        .when(k == 1, F.concat(F.lit("Is the Windows driver ok under RULE-"), conv, F.lit(" critical ")))
        .when(k == 2, "weather and joke ")
        .otherwise("")
    )
    return t.select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.concat(lead, "text").alias("text"))


@query("entity_extract", rf"""SELECT question_id, nullif(regexp_extract(text, '(?i)\b((Laptop|Device|Endpoint|Workstation|Server)[-_]?[A-Za-z0-9]+)\b', 1), '') AS device, upper(nullif(regexp_extract(text, '(?i)\b((CRULE|RULE)-[A-Za-z0-9-]+)\b', 1), '')) AS rule,
 array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, '(?i)" + chr(92) + "b(" + "|".join(sorted(w, key=len, reverse=True)) + ")" + chr(92) + f"b') THEN '{c}' END" for c, w in V.QUESTION_COMPONENTS)}], lambda x: x IS NOT NULL), ',') AS components, CASE WHEN regexp_matches(text, '(?i)\bcritical\b') THEN 'Critical' END AS risk FROM (SELECT question_id, regexp_replace(text, '[^ -~]', 'x', 'g') AS text FROM {SQL_QUESTIONS})""")
def entity_extract(spark: SparkSession, sf: str) -> DataFrame:
    # the engines' word borders differ beyond ASCII
    found = questions(spark, sf).select("question_id", entities(F.regexp_replace("text", "[^ -~]", "x")).alias("e"))
    return found.select("question_id", "e.device", "e.rule", F.array_join("e.component_types", ",").alias("components"), "e.risk")


@query("intent_rank", rf"""
WITH m AS (SELECT question_id, CAST(regexp_matches(low, '\bfailing\b') AS INT) AS f, CAST(contains(low, 'why is') AS INT) AS w, CAST(regexp_matches(low, '\bdriver\b') AS INT) AS d, CAST(regexp_matches(low, '\bjoke\b') AS INT) AS j, CAST(regexp_matches(low, '\bthe\b') AS INT) AS t
 FROM (SELECT question_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS low FROM {SQL_QUESTIONS})),
s AS (SELECT question_id, 'RootCause' AS intent, CASE WHEN f + w > 0 AND f * 2.0 + w - 1.5 * j > 0 THEN f * 2.0 + w - 1.5 * j + 0.05 END AS score, f + w AS hits FROM m
 UNION ALL SELECT question_id, 'Compatibility', CASE WHEN d > 0 THEN d * 1.0 + 0.02 END, d FROM m UNION ALL SELECT question_id, 'Concept', CASE WHEN t > 0 THEN t * 1.0 + 0.01 END, t FROM m),
k AS (SELECT *, max(score) OVER (PARTITION BY question_id) AS top FROM s WHERE score IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, intent) AS rank FROM k WHERE score >= greatest(1.0, 0.45 * top))
SELECT question_id, intent, round(score, 6) AS score, round(least(0.99, 0.56 + 0.11 * score + 0.02 * hits), 6) AS confidence, rank FROM r WHERE rank <= 3""")
def intent_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("RootCause", "failing", 2.0, 5), ("RootCause", "why is", 1.0, 5), ("RootCause", "joke", -1.5, 5), ("Compatibility", "driver", 1.0, 2), ("Concept", "the", 1.0, 1)]
    found = rank_intents(questions(spark, sf), spark.createDataFrame(rows, "intent string, signal string, weight double, priority int"))
    return found.select("question_id", "intent", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "rank")


@query("layer_route", rf"""SELECT question_id, concat_ws(',', CASE WHEN contains(low, ' driver') THEN 'Layer1' END, CASE WHEN regexp_matches(low, '\blaptop-') THEN 'Layer2' END, CASE WHEN contains(low, 'rule-') THEN 'Layer3' END) AS layers FROM (SELECT question_id, lower(text) AS low FROM {SQL_QUESTIONS})""")
def layer_route(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    layers = F.array(F.when(F.contains(low, F.lit(" driver")), "Layer1"), F.when(low.rlike(r"\blaptop-"), "Layer2"), F.when(F.contains(low, F.lit("rule-")), "Layer3"))
    return questions(spark, sf).select("question_id", F.concat_ws(",", F.array_compact(layers)).alias("layers"))


@query("scope_guardrail", f"""
WITH q AS (SELECT question_id, lower(trim(text)) AS q FROM {SQL_QUESTIONS}), h AS (SELECT question_id, len({sql_hits('q', V.IN_SCOPE)}) AS i, len({sql_hits('q', V.OUT_OF_SCOPE)}) AS o FROM q)
SELECT question_id, i > 0 OR o = 0 AS allowed, i AS in_hits, o AS out_hits, round(CASE WHEN i > 0 THEN least(0.99, 0.6 + 0.08 * i) WHEN o > 0 THEN least(0.99, 0.7 + 0.1 * o) ELSE 0.5 END, 6) AS confidence FROM h""")
def scope_guardrail(spark: SparkSession, sf: str) -> DataFrame:
    found = questions(spark, sf).select("question_id", scope(F.col("text")).alias("s"))
    return found.select("question_id", "s.allowed", "s.in_hits", "s.out_hits", F.round("s.confidence", 6).alias("confidence"))


SQL_EVIDENCE = """(SELECT user_id AS report_id, event_id AS ord, CASE event_type WHEN 'error' THEN 'ViolationEvidence' WHEN 'purchase' THEN 'InventoryEvidence' WHEN 'click' THEN 'CompatibilityEvidence' WHEN 'signup' THEN 'LifecycleEvidence' ELSE 'OtherEvidence' END AS evidence_type,
 (event_id % 10) / 10.0 AS confidence, 'E' || event_id % 7 AS entity, CASE WHEN event_type <> 'view' THEN 'T' || event_id % 5 END AS target, event_type AS relationship FROM events)"""


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Events as evidence of the reports of their users."""
    t = F.col("event_type")
    kind = F.when(t == "error", "ViolationEvidence").when(t == "purchase", "InventoryEvidence").when(t == "click", "CompatibilityEvidence").when(t == "signup", "LifecycleEvidence").otherwise("OtherEvidence")
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("report_id"), e.alias("ord"), kind.alias("evidence_type"), ((e % 10) / 10).alias("confidence"), F.concat(F.lit("E"), e % 7).alias("entity"),
        F.when(t != "view", F.concat(F.lit("T"), e % 5)).alias("target"), t.alias("relationship"),
    )


@query("evidence_rank", f"""SELECT report_id, ord, round(score, 6) AS score, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, ord) AS rank FROM (SELECT *, CASE evidence_type WHEN 'ViolationEvidence' THEN 100 WHEN 'InventoryEvidence' THEN 85 WHEN 'CompatibilityEvidence' THEN 70 ELSE 50 END * (0.5 + 0.5 * CAST(confidence AS DOUBLE)) AS score FROM {SQL_EVIDENCE})""")
def evidence_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rank_evidence(evidence(spark, sf)).select("report_id", "ord", F.round("score", 6).alias("score"), "rank")


@query("evidence_graph_nodes", f"SELECT report_id, label, 'N-' || substring(sha256(lower(label)), 1, 12) AS node_id FROM (SELECT report_id, entity AS label FROM {SQL_EVIDENCE} UNION SELECT report_id, target FROM {SQL_EVIDENCE} WHERE target IS NOT NULL)")
def evidence_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_graph(evidence(spark, sf))[0].select("report_id", "label", "node_id")


@query("evidence_graph_edges", f"""SELECT report_id, relationship, count(*) AS edges, round(sum(confidence), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY report_id, entity, target, relationship ORDER BY ord) AS r FROM {SQL_EVIDENCE} WHERE target IS NOT NULL) WHERE r = 1 GROUP BY ALL""")
def evidence_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_graph(evidence(spark, sf))[1].groupBy("report_id", "relationship").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 6).alias("weight"))


@query("evidence_dedupe", f"SELECT report_id, entity, min(ord) AS ord FROM {SQL_EVIDENCE} GROUP BY ALL")
def evidence_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("report_id", "entity").orderBy("ord")
    return evidence(spark, sf).withColumn("r", F.row_number().over(w)).where("r = 1").select("report_id", "entity", "ord")


SQL_REPORTS = "(SELECT doc_id AS report_id, CASE doc_id % 5 WHEN 0 THEN 'boot failure after upgrade; ' WHEN 1 THEN 'policy drift is unknown; ' WHEN 2 THEN 'missing dependency, cve open; ' ELSE '' END || text AS text FROM documents)"
_SQL_PATTERNS = ", ".join(f"({i}, '{k}', '{c}', '{v}', '{r}')" for i, (k, c, v, r) in enumerate(V.VIOLATION_PATTERNS))
SQL_DETECT = f"""p(i, k, c, v, risk) AS (VALUES {_SQL_PATTERNS}), d AS (SELECT report_id, c, v, CASE WHEN regexp_matches(text, '(?i)\\bcritical\\b') THEN 'Critical' WHEN regexp_matches(text, '(?i)\\bwarning\\b') THEN 'High' WHEN regexp_matches(text, '(?i)\\binfo\\b') THEN 'Medium' WHEN regexp_matches(text, '(?i)\\binformational\\b') THEN 'Informational' ELSE risk END AS risk, i, row_number() OVER (PARTITION BY report_id, c, v ORDER BY i) AS r FROM {SQL_REPORTS} JOIN p ON contains(lower(text), k))"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as reports: what opens the text is what these operators look for, the whole text follows."""
    k = F.col("doc_id") % 5
    lead = F.when(k == 0, "boot failure after upgrade; ").when(k == 1, "policy drift is unknown; ").when(k == 2, "missing dependency, cve open; ").otherwise("")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("report_id"), F.concat(lead, "text").alias("text"))


@query("violation_detect", f"WITH {SQL_DETECT} SELECT report_id, c AS root_cause, v AS violation, risk, i AS pattern_no FROM d WHERE r = 1")
def violation_detect(spark: SparkSession, sf: str) -> DataFrame:
    return detect_violations(reports(spark, sf))


@query("violation_evidence", """
WITH e AS (SELECT user_id AS report_id, event_id, event_type, 'E' || event_id % 7 AS entity, CAST((event_id % 10) / 10.0 AS DOUBLE) AS conf FROM events),
f AS (SELECT report_id, arg_min(entity, event_id) AS component FROM e GROUP BY report_id),
x AS (SELECT report_id, 0 AS part, min(event_id) AS o, 'RC-VERSION-MISMATCH' AS root_cause, 'VIOL-VERSION' AS violation, entity AS component, 'High' AS risk, arg_min(conf, event_id) AS confidence, 'ViolationEvidence' AS label FROM e WHERE event_type = 'error' GROUP BY report_id, entity
 UNION ALL SELECT report_id, 1, 25, 'RC-VERSION-MISMATCH', 'VIOL-COMPATIBILITY', component, 'Critical', 0.75, 'VersionMismatch' FROM f WHERE report_id % 3 = 0 UNION ALL SELECT report_id, 1, 29, 'RC-UNSUPPORTED-CONFIGURATION', 'VIOL-CONFLICT', component, 'Critical', 0.75, 'BootFailure' FROM f WHERE report_id % 3 = 0
 UNION ALL SELECT report_id, 1, 6, 'RC-INVALID-UPGRADE-PATH', 'VIOL-UPGRADE', component, 'High', 0.75, 'UpgradePath' FROM f WHERE report_id % 3 = 1)
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY part, o) - 1 AS INTEGER) AS detection_no, root_cause, violation, component, risk, confidence, label FROM x""")
def violation_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as the evidence of a package, with a question."""
    row = F.struct(F.col("ord"), F.struct("evidence_type", "entity", "target", "confidence", F.lit("").alias("source_excerpt"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("rule_type"), "relationship").alias("e"))
    rows = F.array_sort(F.collect_list(row), lambda a, b: a["ord"].cast("int") - b["ord"].cast("int"))  # the evidence of one package
    packages = evidence(spark, sf).groupBy("report_id").agg(F.transform(rows, lambda x: x["e"]).cast(V.EVIDENCE_ROWS).alias("evidence"))
    question = F.when(F.col("report_id") % 3 == 0, "A critical boot failure").when(F.col("report_id") % 3 == 1, "Which upgrade order?")
    return detect_with_evidence(packages.withColumn("question", question))


@query("risk_assess", f"""
WITH {SQL_DETECT}, x AS (SELECT report_id, v AS component, c, CASE risk WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS lvl, (i % 10) / 10.0 AS conf, count(*) OVER (PARTITION BY report_id) AS n FROM d WHERE r = 1),
y AS (SELECT *, CASE WHEN conf < 0.6 THEN greatest(lvl - 1, 0) ELSE lvl END AS low FROM x)
SELECT report_id, c AS root_cause, component, CASE WHEN n > 2 THEN least(low + 1, 4) ELSE low END AS level FROM y""")
def risk_assess(spark: SparkSession, sf: str) -> DataFrame:
    found = detect_violations(reports(spark, sf)).withColumn("confidence", (F.col("pattern_no") % 10) / 10).withColumn("component", F.lit("all"))
    return assess_risk(found).select("report_id", "root_cause", F.col("violation").alias("component"), "level")


@query("rca_findings", f"""
WITH {SQL_DETECT}, f AS (SELECT report_id, c, v, CASE risk WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END * 25 AS sev, i FROM d WHERE r = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY sev DESC, i) AS n, count(*) OVER (PARTITION BY report_id) AS findings FROM f)
SELECT r.report_id, coalesce(t.c, 'RC-NONE') AS top_cause, coalesce(t.sev, 0) AS severity_score, coalesce(t.findings, 0) AS findings FROM {SQL_REPORTS} r LEFT JOIN t ON r.report_id = t.report_id AND t.n = 1""")
def rca_findings(spark: SparkSession, sf: str) -> DataFrame:
    base = reports(spark, sf)
    level = F.array_position(F.array(*[F.lit(r) for r in V.RISKS]), F.col("risk")) - 1
    found = detect_violations(base).withColumn("severity_score", level * 25)
    w = Window.partitionBy("report_id")
    top = found.withColumn("n", F.row_number().over(w.orderBy(F.desc("severity_score"), "pattern_no"))).withColumn("findings", F.count("*").over(w)).where("n = 1")
    out = base.select("report_id").join(top, "report_id", "left")
    return out.select("report_id", F.coalesce("root_cause", F.lit("RC-NONE")).alias("top_cause"), F.coalesce("severity_score", F.lit(0)).alias("severity_score"), F.coalesce("findings", F.lit(0)).alias("findings"))


@query("recommendation_enrich", f"""
WITH {SQL_DETECT}, a(v, action, pos) AS (VALUES ('VIOL-CONFLICT', 'Rollback', 1), ('VIOL-UPGRADE', 'Upgrade', 1), ('VIOL-UPGRADE', 'Patch', 2), ('VIOL-SECURITY', 'Patch', 1), ('VIOL-DEPENDENCY', 'Install', 1))
SELECT report_id, action, min(pos) AS pos, max(CASE WHEN risk = 'Critical' THEN 'P1' WHEN risk = 'High' THEN 'P2' ELSE 'P3' END) AS priority FROM d JOIN a USING (v) WHERE r = 1 GROUP BY ALL""")
def recommendation_enrich(spark: SparkSession, sf: str) -> DataFrame:
    actions = spark.createDataFrame([("VIOL-CONFLICT", ["Rollback"]), ("VIOL-UPGRADE", ["Upgrade", "Patch"]), ("VIOL-SECURITY", ["Patch"]), ("VIOL-DEPENDENCY", ["Install"])], "violation string, actions array<string>")
    each = actions.select("violation", F.posexplode("actions").alias("pos", "action"))
    priority = F.when(F.col("risk") == "Critical", "P1").when(F.col("risk") == "High", "P2").otherwise("P3")
    return detect_violations(reports(spark, sf)).join(F.broadcast(each), "violation").groupBy("report_id", "action").agg((F.min("pos") + 1).alias("pos"), F.max(priority).alias("priority"))


@query("failure_histogram", "SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN value < 10 THEN 'low value' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL)) AS issue FROM events) GROUP BY issue")
def failure_histogram(spark: SparkSession, sf: str) -> DataFrame:
    issues = F.array_compact(F.array(F.when(F.col("value") < 10, "low value"), F.when(F.col("event_type") == "error", "error")))
    return table(spark, sf, "events").select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("benchmark_by_category", """
WITH b(benchmark, lang) AS (VALUES ('A', 'en'), ('A', 'fr'), ('B', 'de'), ('C', 'xx'))
SELECT benchmark, count(l.doc_id) AS cases, coalesce(round(avg(l.quality), 3), 0) AS pass_rate, coalesce(round(avg(length(d.text)), 3), 0) AS mean_length FROM b LEFT JOIN documents d ON b.lang = d.lang LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY benchmark""")
def benchmark_by_category(spark: SparkSession, sf: str) -> DataFrame:
    b = spark.createDataFrame([("A", "en"), ("A", "fr"), ("B", "de"), ("C", "xx")], "benchmark string, lang string")
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    both = docs.join(table(spark, sf, "labels").withColumnRenamed("doc_id", "labelled"), F.col("doc_id") == F.col("labelled"), "left").join(F.broadcast(b), "lang")
    per = both.groupBy("benchmark").agg(F.count("labelled").alias("cases"), F.round(F.avg("quality"), 3).alias("pass_rate"), F.round(F.avg("n"), 3).alias("mean_length"))
    return b.select("benchmark").distinct().join(per, "benchmark", "left").na.fill(0)


@query("evaluation_metrics", """
SELECT count(*) AS cases, sum(quality) AS passed, round(avg(quality), 6) AS accuracy, round(avg(toxic), 6) AS hallucination_rate, avg(quality) > 0.85 AS confidence_ok, avg(toxic) < 0.05 AS hallucination_ok FROM labels""")
def evaluation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.avg("quality"), F.avg("toxic")
    return table(spark, sf, "labels").agg(F.count("*").alias("cases"), F.sum("quality").alias("passed"), F.round(q, 6).alias("accuracy"), F.round(t, 6).alias("hallucination_rate"), (q > 0.85).alias("confidence_ok"), (t < 0.05).alias("hallucination_ok"))


@query("hallucination_score", r"""
WITH a AS (SELECT conv_id, turn, text, '[Doc] ' || conv_id AS cite, turn % 3 AS k FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN k = 0 THEN text || ' ' || cite ELSE text END AS ans, CASE WHEN k = 1 THEN 'do it ' || cite WHEN k = 2 THEN 'just do it' ELSE '' END AS rec, cite, k FROM a)
SELECT conv_id, turn, round(CASE WHEN NOT contains(ans, cite) AND k <> 2 THEN 0.3 ELSE 0 END + CASE WHEN k = 1 THEN 0.2 ELSE 0 END + CASE WHEN rec <> '' AND NOT contains(rec, cite) THEN 0.25 ELSE 0 END
 + CASE WHEN regexp_matches(lower(ans), 'compatible|requires|required version|dependency') AND NOT contains(ans, cite) THEN 0.2 ELSE 0 END, 6) AS score FROM b""")
def hallucination_score(spark: SparkSession, sf: str) -> DataFrame:
    cite, k = F.concat(F.lit("[Doc] "), F.col("conv_id").cast("string")), F.col("turn") % 3
    answer = F.when(k == 0, F.concat("text", F.lit(" "), cite)).otherwise(F.col("text"))
    rec = F.when(k == 1, F.concat(F.lit("do it "), cite)).when(k == 2, "just do it").otherwise("")
    sources = F.when(k == 1, F.array(F.lit("[Doc] 999999"))).when(k == 2, F.array(cite)).otherwise(F.array().cast("array<string>"))
    found = hallucination(answer, rec, F.array(cite), sources, F.array(cite), answer)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.round(found["score"], 6).alias("score"))


@query("confidence_eval", """SELECT user_id, round(0.25 * avg(value / 1000) + 0.15 * least(1.0, count(*) / 3.0) + 0.25 * max(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END) + 0.2 * (1 - avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END)) + 0.15 * avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END), 6) AS confidence FROM events GROUP BY user_id""")
def confidence_eval(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda t: F.avg(F.when(F.col("event_type") == t, 1.0).otherwise(0.0))
    valid = F.max(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0))
    value = evaluation_confidence(F.avg(F.col("value") / 1000), F.count("*"), valid, share("error"), share("click"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(value, 6).alias("confidence"))


@query("citation_sets", """SELECT conv_id, len(list_intersect(u, ['user', 'assistant'])) AS used, len(list_filter(u, lambda x: NOT list_contains(['user', 'assistant'], x))) AS unknown FROM (SELECT conv_id, list(DISTINCT role) AS u FROM conversations GROUP BY conv_id)""")
def citation_sets(spark: SparkSession, sf: str) -> DataFrame:
    expected = F.array(F.lit("user"), F.lit("assistant"))
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("u"))
    return per.select("conv_id", F.size(F.array_intersect("u", expected)).alias("used"), F.size(F.array_except("u", expected)).alias("unknown"))


@query("coverage_share", f"SELECT role, round(avg(CASE WHEN trim(text) <> '' AND NOT {sql_any('lower(text)', ('insufficient evidence',))} THEN 1.0 ELSE 0 END), 6) AS coverage FROM conversations GROUP BY role")
def coverage_share(spark: SparkSession, sf: str) -> DataFrame:
    ok = (F.trim("text") != "") & ~F.contains(F.lower("text"), F.lit("insufficient evidence"))
    return table(spark, sf, "conversations").groupBy("role").agg(F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("coverage"))


@query("keyword_query_clean", r"""SELECT question_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.-]+'), lambda x: x NOT IN ('the', 'and', 'of', 'is'))[1:10], ' ') AS keywords FROM """ + SQL_QUESTIONS)
def keyword_query_clean(spark: SparkSession, sf: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9][a-z0-9.-]+)"), 1), lambda x: ~x.isin("the", "and", "of", "is"))
    return questions(spark, sf).select("question_id", F.array_join(F.slice(words, 1, 10), " ").alias("keywords"))
