"""Profiles, gates, citations, answers and generators: the smaller decisions of the document and answer pipelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import candidates as C
from tessera.functions import text as X
from tessera.functions import versions as VS
from tessera.functions import vocabulary as V
from tessera.operators.candidates import candidates
from tessera.operators.chunks import sql_any
from tessera.operators.reasoning import SQL_EVIDENCE, evidence
from tessera.plans.registry import query, table

REVIEW_STATUSES = ("pending_review", "approved", "rejected", "needs_clarification", "needs_human_review")
#: Weights of the compliance intelligence score.
SCORE_WEIGHTS = (0.2, 0.2, 0.15, 0.15, 0.15, 0.15)


def pdf_extractor(length: Column, images: Column, hint: Column, scanned: Column, layout: Column, docling: bool = False, ocr: bool = False, preferred: str = "pymupdf") -> Column:
    """Struct (extractor, confidence, page_type) by an ordered list of signals."""
    choose = lambda e, c, t: F.struct(F.lit(e).alias("extractor"), F.lit(c).alias("confidence"), F.lit(t).alias("page_type"))
    complex_ = (hint >= 0.5) | (layout >= 0.7)
    return (
        F.when(scanned >= 0.7, choose("chandra_ocr", 0.75, "scanned_pdf") if ocr else choose("chandra_ocr_disabled", 0.35, "scanned_pdf"))
        .when(F.lit(docling and preferred == "docling"), choose("docling", 0.78, "structured_pdf"))
        .when(complex_, choose("docling", 0.7, "structured_pdf") if docling else choose("pymupdf", 0.65, "text_pdf"))
        .when(length >= 50, choose("pymupdf", 0.85, "text_pdf"))
        .otherwise(choose("pymupdf", 0.45, "pdf"))
    )


def rejection_reason(text: Column, kind: Column) -> Column:
    s = F.trim(text)
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "empty").when(kind == "document_metadata", F.lit(None)).when(s.rlike(r"(?i)^v?[0-9]+(\.[0-9]+)+(\.x)?$"), "version_only")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | s.rlike(r"^[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}$"), "date_only").when(s.rlike("^[0-9]+$"), "page_number_only").when(X.word_count(s) < 3, "too_short")
    )


def best_metric(metrics: Column) -> Column:
    """The metric with the highest score of an array of structs with score; the first on ties."""
    scored = F.transform(metrics, lambda m, i: F.struct(m["score"].alias("s"), (-i).alias("i"), m.alias("m")))
    return F.array_max(F.filter(scored, lambda x: x["s"].isNotNull()))["m"]


def citation(kind: Column, ident: Column) -> Column:
    label = F.when(kind == "CompatibilityEvidence", "Compatibility Rule").when(kind == "InventoryEvidence", "Inventory").when(kind == "ViolationEvidence", "Violation").otherwise("Knowledge")
    return F.concat(F.lit("["), label, F.lit("] "), ident)


def canonical_citations(text: Column, ids: Column, cites: Column) -> Column:
    """``[id]`` replaced by the full citation, for each id known."""
    return F.aggregate(F.arrays_zip(ids.alias("i"), cites.alias("c")), text, lambda t, p: F.replace(t, F.concat(F.lit("["), p["i"], F.lit("]")), p["c"]))


def validate_answer(fields: list[Column], text: Column, expected: Column, confidence: Column) -> Column:
    """Struct (score, valid): completeness, citation share, grounding and evidence confidence at .35, .25, .20, .20; valid from .80 with all fields and a citation."""
    usable = lambda c: (F.coalesce(F.trim(c), F.lit("")) != "") & ~F.contains(F.lower(c), F.lit("insufficient evidence"))
    complete = reduce(lambda a, b: a + b, [F.when(usable(f), 1.0).otherwise(0.0) for f in fields]) / len(fields)
    used = F.size(F.filter(expected, lambda c: F.contains(text, c)))
    share = F.when(F.size(expected) > 0, used / F.size(expected)).otherwise(0.0)
    grounded = F.when(used > 0, 1.0).otherwise(0.0)
    score = 0.35 * complete + 0.25 * share + 0.20 * grounded + 0.20 * confidence
    return F.struct(score.alias("score"), ((complete == 1) & (used > 0) & (score >= 0.80)).alias("valid"))


def quality_gate(kind: Column, component: Column, version: Column, grounded: Column, confidence: Column) -> Column:
    """Struct (warnings, status): serious warnings send a candidate to a person."""
    serious = ("unknown_component", "missing_version", "ungrounded")
    w = F.array_compact(F.array(
        F.when(component == "unknown", "unknown_component"), F.when(version.isNull(), "missing_version"), F.when(~grounded, "ungrounded"), F.when(confidence < 0.5, "low_confidence"), F.when(kind.isNull(), "unknown_kind"),
    ))
    return F.struct(w.alias("warnings"), F.when(F.arrays_overlap(w, F.array(*map(F.lit, serious))), "needs_human_review").otherwise("normalized").alias("status"))


def deterministic_candidate(row: Column) -> Column:
    """Struct (rule_type, subject, release) from a support-matrix row: switch model, network module or unsupported feature."""
    model, module, feature = X.field(row, "Switch Model"), X.field(row, "Network Module"), X.field(row, "Feature")
    kind = F.when(model.isNotNull(), "model_support_min_version").when(module.isNotNull(), "network_module_support_min_version").when(feature.isNotNull() & F.contains(F.lower(row), F.lit("not supported")), "unsupported_feature")
    return F.struct(kind.alias("rule_type"), F.coalesce(model, module, feature).alias("subject"), VS.ios_xe_release(X.field(row, "Introductory Release"))["version"].alias("release"))


def mock_llm(prompt: Column) -> Column:
    """A deterministic stand-in for a language model: subject and first dotted number."""
    version = F.nullif(F.regexp_extract(prompt, r"([0-9]+(?:\.[0-9]+)+)", 1), F.lit(""))
    return F.to_json(F.struct(F.element_at(F.split(F.trim(prompt), " "), 1).alias("subject"), version.alias("version")))


def normalise_items(found: Column) -> Column:
    """An array of items struct(field, operator, value) with type, operator, version, scheme and ordinal id."""
    def one(x: Column, i: Column) -> Column:
        v = VS.normalise(VS.extract(x["value"]))
        return F.struct(F.concat(F.lit("COND-"), F.lpad((i + 1).cast("string"), 3, "0")).alias("id"), C.component_type(x["field"], x["value"], F.lit("")).alias("component_type"), C.operator(x["operator"]).alias("operator"), v["norm"].alias("version"), v["scheme"].alias("scheme"))

    return F.transform(found, one)


def classify_unresolved(value: Column, dispositions: dict[str, str]) -> Column:
    """What an unresolved reference is: a disposition by its form, else by words and endings, else external."""
    low = X.lookup_form(value)
    cases = [F.when(low == k, F.lit(v)) for k, v in dispositions.items()]
    rest = F.when(X.contains_any(low, ("cloud", "network")), "future_domain").when(X.contains_any(low, ("ieee", "iso ", "rfc")), "standard").when(F.endswith(low, F.lit("ing")), "process").otherwise("external")
    return F.coalesce(*cases, rest)


# -- queries ----------------------------------------------------------------------------------------------------------


@query("doc_profile", f"""
WITH p AS (SELECT doc_id, length(text) AS n, CASE WHEN {sql_any('lower(text)', V.TABLE_WORDS)} THEN 0.5 ELSE 0 END AS h, CASE WHEN length(text) < 300 THEN 0.8 ELSE 0.1 END AS s FROM documents)
SELECT doc_id, CASE WHEN s >= 0.7 THEN 'chandra_ocr_disabled' ELSE 'pymupdf' END AS extractor, CASE WHEN s >= 0.7 THEN 0.35 WHEN h >= 0.5 THEN 0.65 WHEN n >= 50 THEN 0.85 ELSE 0.45 END AS confidence FROM p""")
def doc_profile(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    hint = F.when(X.contains_any(F.lower(text), V.TABLE_WORDS), 0.5).otherwise(0.0)
    chosen = pdf_extractor(F.length(text), F.lit(0), hint, F.when(F.length(text) < 300, 0.8).otherwise(0.1), F.lit(0.0))
    return table(spark, sf, "documents").select("doc_id", chosen.alias("c")).select("doc_id", "c.extractor", "c.confidence")


@query("line_rejections", r"""
WITH l AS (SELECT trim(line) AS s FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)),
r AS (SELECT CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '(?i)^v?[0-9]+(\.[0-9]+)+(\.x)?$') THEN 'version_only' WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') OR regexp_matches(s, '^[0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4}$') THEN 'date_only'
 WHEN regexp_matches(s, '^[0-9]+$') THEN 'page_number_only' WHEN len(string_split(trim(regexp_replace(s, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ')) < 3 THEN 'too_short' END AS reason FROM l)
SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def line_rejections(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(rejection_reason(F.col("line"), F.lit("prose")).alias("reason")).agg(F.count("*").alias("n"))


@query("send_to_llm", f"SELECT source, count(*) FILTER ({sql_any('lower(text)', V.RULE_LANGUAGE)}) AS sent, count(*) AS chunks FROM documents GROUP BY source")
def send_to_llm(spark: SparkSession, sf: str) -> DataFrame:
    prose = X.contains_any(F.lower("text"), V.RULE_LANGUAGE)
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.when(prose, 1)).alias("sent"), F.count("*").alias("chunks"))


@query("question_gate", "SELECT conv_id, turn, NOT contains(lower(text), 'ß') AND (contains(lower(text), 'the') OR contains(lower(text), 'que')) AS allowed FROM conversations WHERE role = 'user'")
def question_gate(spark: SparkSession, sf: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", (~X.contains_any(low, ["ß"]) & X.contains_any(low, ["the", "que"])).alias("allowed"))


@query("review_status_gate", "SELECT o_orderstatus, count(*) AS n, o_orderstatus IN ('F', 'O') AS valid FROM orders GROUP BY 1")
def review_status_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("valid", F.col("o_orderstatus").isin("F", "O"))


@query("kind_filter", "SELECT coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'unknown') AS kind, count(*) AS n FROM documents WHERE coalesce(CASE WHEN lang = 'en' THEN NULL ELSE lang END, 'unknown') IN ('unknown', 'fr') GROUP BY 1")
def kind_filter(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.coalesce(F.when(F.col("lang") != "en", F.col("lang")), F.lit("unknown"))
    return table(spark, sf, "documents").withColumn("kind", kind).where(F.col("kind").isin("unknown", "fr")).groupBy("kind").agg(F.count("*").alias("n"))


@query("unresolved_classes", "SELECT CASE WHEN f = 'antique' THEN 'known' WHEN contains(f, 'cloud') OR contains(f, 'network') THEN 'future_domain' WHEN contains(f, 'ieee') OR contains(f, 'iso ') OR contains(f, 'rfc') THEN 'standard' WHEN ends_with(f, 'ing') THEN 'process' ELSE 'external' END AS class, count(*) AS n FROM (SELECT lower(split_part(p_name, ' ', 1)) AS f FROM part) GROUP BY 1")
def unresolved_classes(spark: SparkSession, sf: str) -> DataFrame:
    first = F.element_at(F.split("p_name", " "), 1)
    return table(spark, sf, "part").groupBy(classify_unresolved(first, {"antique": "known"}).alias("class")).agg(F.count("*").alias("n"))


@query("reference_overrides", "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'approved_external' WHEN o_orderstatus = 'P' THEN 'unresolved' ELSE 'resolved' END AS status, count(*) AS n FROM orders GROUP BY 1")
def reference_overrides(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "unresolved").otherwise("resolved").alias("status"))
    decided = refs.where("o_orderkey % 11 = 0").select("o_orderkey", F.lit("approved_external").alias("decision"))
    return refs.join(decided, "o_orderkey", "left").groupBy(F.coalesce("decision", "status").alias("status")).agg(F.count("*").alias("n"))


@query("layer_evidence", f"SELECT layer, count(*) AS n FROM (SELECT unnest(CASE WHEN evidence_type = 'InventoryEvidence' THEN ['Layer2'] WHEN evidence_type = 'CompatibilityEvidence' THEN ['Layer1', 'Layer3'] ELSE ['Layer1'] END) AS layer FROM {SQL_EVIDENCE}) GROUP BY layer")
def layer_evidence(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("evidence_type")
    layers = F.when(t == "InventoryEvidence", F.array(F.lit("Layer2"))).when(t == "CompatibilityEvidence", F.array(F.lit("Layer1"), F.lit("Layer3"))).otherwise(F.array(F.lit("Layer1")))
    return evidence(spark, sf).select(F.explode(layers).alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))


@query("citations", f"SELECT report_id, string_agg(c, ';' ORDER BY ord) AS citations FROM (SELECT report_id, ord, '[' || CASE evidence_type WHEN 'CompatibilityEvidence' THEN 'Compatibility Rule' WHEN 'InventoryEvidence' THEN 'Inventory' WHEN 'ViolationEvidence' THEN 'Violation' ELSE 'Knowledge' END || '] ' || entity AS c, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS n FROM {SQL_EVIDENCE}) WHERE n <= 5 GROUP BY report_id")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("report_id").orderBy("ord")
    some = evidence(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 5").withColumn("c", citation(F.col("evidence_type"), F.col("entity")))
    per = some.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("ord", "c"))).alias("a"))
    return per.select("report_id", F.array_join(F.transform("a", lambda x: x["c"]), ";").alias("citations"))


@query("answer_validation", "SELECT conv_id, turn, round(0.35 * (2 + CAST(turn % 2 = 0 AS INT)) / 3 + 0.25 * CAST(turn % 3 = 0 AS INT) + 0.2 * CAST(turn % 3 = 0 AS INT) + 0.2 * 0.9, 6) AS score, turn % 2 = 0 AND turn % 3 = 0 AS valid FROM conversations")
def answer_validation(spark: SparkSession, sf: str) -> DataFrame:
    turn, cite = F.col("turn"), F.concat(F.lit("[D] "), F.col("conv_id").cast("string"))
    third = F.when(turn % 2 == 0, "ok").otherwise("Insufficient evidence")
    text = F.when(turn % 3 == 0, F.concat(F.lit("see "), cite)).otherwise("nothing")
    got = validate_answer([F.lit("a"), F.lit("b"), third], text, F.array(cite), F.lit(0.9))
    return table(spark, sf, "conversations").select("conv_id", "turn", got.alias("v")).select("conv_id", "turn", F.round("v.score", 6).alias("score"), "v.valid")


@query("gate_warnings", "SELECT status, warnings, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN l_linenumber = 5 THEN 'ungrounded' END, CASE WHEN l_returnflag = 'R' AND l_linenumber <= 4 THEN 'unknown_kind' END) AS warnings, CASE WHEN l_linenumber = 5 THEN 'needs_human_review' ELSE 'normalized' END AS status FROM lineitem) GROUP BY ALL")
def gate_warnings(spark: SparkSession, sf: str) -> DataFrame:
    got = quality_gate(F.col("kind"), F.lit("bios"), F.col("version_raw"), F.col("l_linenumber") != 5, F.col("confidence"))
    found = candidates(spark, sf).select(got.alias("g"))
    return found.groupBy(F.col("g.status").alias("status"), F.array_join("g.warnings", ",").alias("warnings")).agg(F.count("*").alias("n"))


@query("deterministic_candidates", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'model_support_min_version' WHEN 1 THEN 'network_module_support_min_version' ELSE 'unsupported_feature' END AS rule_type, p_name AS subject, CASE WHEN p_size % 3 < 2 THEN '17.' || p_size || '.1' END AS release FROM part")
def deterministic_candidates(spark: SparkSession, sf: str) -> DataFrame:
    k, release = F.pmod("p_size", F.lit(3)), F.concat(F.lit("Introductory Release: Cisco IOS XE 17."), F.col("p_size").cast("string"), F.lit(".1"))
    row = F.when(k == 0, F.concat(F.lit("Switch Model: "), "p_name", F.lit(" | "), release)).when(k == 1, F.concat(F.lit("Network Module: "), "p_name", F.lit(" | "), release)).otherwise(F.concat(F.lit("Feature: "), "p_name", F.lit(" | Status: not supported")))
    return table(spark, sf, "part").select("p_partkey", deterministic_candidate(row).alias("c")).select("p_partkey", "c.*")


@query("normalise_items", "SELECT p_partkey, 'COND-001:bios:>=:' || p_size || '.' || p_partkey || ':semantic' AS first_item, 2 AS items FROM part")
def normalise_items_query(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda f, o, v: F.struct(F.lit(f).alias("field"), F.lit(o).alias("operator"), v.alias("value"))
    version = F.concat(F.lit("at version 0"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"))
    got = normalise_items(F.array(item("bios", "or later", version), item("os", "exists", F.col("p_name"))))
    found = table(spark, sf, "part").select("p_partkey", got.alias("i"))
    one = F.col("i")[0]
    return found.select("p_partkey", F.concat_ws(":", one["id"], one["component_type"], one["operator"], one["version"], one["scheme"]).alias("first_item"), F.size("i").alias("items"))


@query("mock_llm_answers", r"SELECT p_partkey, split_part(p_name, ' ', 1) AS subject, p_size || '.' || p_partkey AS version FROM part")
def mock_llm_answers(spark: SparkSession, sf: str) -> DataFrame:
    answer = mock_llm(F.concat("p_name", F.lit(" needs "), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", F.get_json_object(answer, "$.subject").alias("subject"), F.get_json_object(answer, "$.version").alias("version"))


@query("best_severity_metric", "SELECT user_id, max(value) AS score, min(event_id) FILTER (value = m) AS event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def best_severity_metric(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("value").alias("score")))).alias("m"))
    best = best_metric(F.col("m"))
    return per.select("user_id", best["score"].alias("score"), best["event_id"].alias("event_id"))


@query("intelligence_score", "SELECT round(sum(w * s), 6) AS score FROM (SELECT 0.2 AS w, avg(quality) AS s FROM labels UNION ALL SELECT 0.2, 1 - avg(toxic) FROM labels UNION ALL SELECT 0.15, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) FROM orders UNION ALL SELECT 0.15, 1 UNION ALL SELECT 0.15, 1 UNION ALL SELECT 0.15, 0.5)")
def intelligence_score(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "labels").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    b = table(spark, sf, "orders").agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("f"))
    parts = [F.col("q"), 1 - F.col("t"), F.col("f"), F.lit(1.0), F.lit(1.0), F.lit(0.5)]
    score = reduce(lambda x, y: x + y, [w * p for w, p in zip(SCORE_WEIGHTS, parts, strict=True)])
    return a.join(F.broadcast(b), F.lit(True)).select(F.round(score, 6).alias("score"))  # two single rows


@query("pending_export", "SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS payload FROM orders WHERE o_orderstatus = 'P'")
def pending_export(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", payload.alias("payload"))


@query("candidate_relationships", "SELECT p_partkey % 50 AS src, l_suppkey AS dst, min(l_orderkey) AS first_order, CASE WHEN p_partkey % 50 % 5 = l_suppkey % 5 THEN 'same_domain' ELSE 'cross_domain' END AS route FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def candidate_relationships(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey")
    first = pairs.groupBy("src", "dst").agg(F.min("l_orderkey").alias("first_order"))
    return first.withColumn("route", F.when(F.col("src") % 5 == F.col("dst") % 5, "same_domain").otherwise("cross_domain"))


@query("catalogue_reference_check", "SELECT 'nation' AS catalogue, count(*) AS dangling FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 7) UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)")
def catalogue_reference_check(spark: SparkSession, sf: str) -> DataFrame:
    def dangling(rows: str, key: str, of: DataFrame, ident: str, name: str) -> DataFrame:
        gone = table(spark, sf, rows).join(of, F.col(key) == F.col(ident), "left_anti")
        return gone.agg(F.count("*").alias("dangling")).select(F.lit(name).alias("catalogue"), "dangling")

    nations = table(spark, sf, "nation").where("n_nationkey <> 7")
    return dangling("customer", "c_nationkey", nations, "n_nationkey", "nation").union(dangling("lineitem", "l_partkey", table(spark, sf, "part"), "p_partkey", "part"))


@query("guarded_answer_mode", "SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'blocked' WHEN turn % 5 = 1 THEN 'concept' WHEN turn % 5 = 2 THEN 'capability_missing' WHEN length(text) < 200 THEN 'insufficient' ELSE 'answered' END AS mode FROM conversations")
def guarded_answer_mode(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn") % 5
    mode = F.when(k == 0, "blocked").when(k == 1, "concept").when(k == 2, "capability_missing").when(F.length("text") < 200, "insufficient").otherwise("answered")
    return table(spark, sf, "conversations").select("conv_id", "turn", mode.alias("mode"))
