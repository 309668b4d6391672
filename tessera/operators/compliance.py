"""Compliance: rules with AND/OR conditions over device components, violations, scores and rollout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.versions import key, satisfies_keyed
from tessera.plans.catalogue import small
from tessera.plans.registry import query, table

#: Points a violation costs, by severity: our own formula, as none is specified.
COST = {"blocker": 100, "critical": 42, "warning": 15, "info": 5}
MINUTES = 12


def scan(components: DataFrame, rules: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """A row for each device and rule that applies: device_id, rule_id, severity, outcome (pass, fail, unknown), met, unmet, unknown.

    ``components`` (device_id, component_type, version); ``rules`` (rule_id, severity, logic, conditions, requirements) with
    arrays of struct(component_type, operator, version). A rule applies to a device by its conditions, with AND or OR over
    them, none meaning everywhere; requirements must all hold; a component that is missing, or a version that can't be
    compared, is unknown and never passes. ``exceptions`` (device_id, rule_id) suppress. Items meet components by
    component_type, so rules and devices are never paired without one in common; only rules without any condition go to all.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("items")) for k in ("conditions", "requirements")])
    flat = rules.select("rule_id", F.explode(kinds).alias("k")).select("rule_id", "k.kind", F.posexplode("k.items").alias("pos", "i")).select("rule_id", "kind", "pos", "i.*")
    items = small(flat.withColumn("key", key(F.col("version"))))
    sizes = small(rules.select("rule_id", "severity", "logic", F.size("conditions").alias("n_c"), F.size("requirements").alias("n_r")))
    owned = components.withColumnRenamed("version", "c_version").withColumn("c_key", key(F.col("c_version")))
    ok = satisfies_keyed(F.col("c_version"), F.col("c_key"), F.col("operator"), F.col("version"), F.col("key")).cast("int")
    # one exchange, by device, serves all that follows
    met = owned.join(items, "component_type").select("device_id", "rule_id", "kind", "pos", ok.alias("ok")).repartition("device_id")
    each = met.groupBy("device_id", "rule_id", "kind", "pos").agg(F.max("ok").alias("ok"))
    n = lambda kind, value: F.count(F.when((F.col("kind") == kind) & (F.col("ok") == value), 1))
    state = each.groupBy("device_id", "rule_id").agg(n("conditions", 1).alias("c_met"), n("requirements", 1).alias("met"), n("requirements", 0).alias("unmet"))
    zero = F.lit(0).cast("long")
    everywhere = components.select("device_id").distinct().join(small(rules.where(F.size("conditions") == 0).select("rule_id")), F.lit(True)).select("device_id", "rule_id", zero.alias("c_met"), zero.alias("met"), zero.alias("unmet"))
    out = state.union(everywhere).groupBy("device_id", "rule_id").agg(*[F.sum(c).alias(c) for c in ("c_met", "met", "unmet")]).join(sizes, "rule_id")
    out = out.where((F.col("n_c") == 0) | F.when(F.col("logic") == "OR", F.col("c_met") > 0).otherwise(F.col("c_met") == F.col("n_c")))
    if exceptions is not None:
        out = out.join(exceptions, ["device_id", "rule_id"], "left_anti")
    out = out.withColumn("unknown", F.col("n_r") - F.col("met") - F.col("unmet"))
    outcome = F.when(F.col("unmet") > 0, "fail").when(F.col("unknown") > 0, "unknown").otherwise("pass")
    return out.select("device_id", "rule_id", "severity", outcome.alias("outcome"), "met", "unmet", "unknown")


def score(scanned: DataFrame) -> DataFrame:
    """Per device: score from 100 down, status by the worst failed severity, readiness of data and rollout recommendation."""
    fail = F.col("outcome") == "fail"
    n = lambda c: F.count(F.when(c, 1))
    points = reduce(lambda a, b: a + b, [F.when(fail & (F.col("severity") == s), c).otherwise(0) for s, c in COST.items()])
    worst = F.max(F.when(fail, F.when(F.col("severity") == "blocker", 4).when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)).otherwise(0))
    out = scanned.groupBy("device_id").agg(
        F.count("*").alias("applicable"), n(fail).alias("violations"), n(F.col("outcome") == "unknown").alias("missing_data"), F.greatest(F.lit(0), 100 - F.sum(points)).alias("score"), worst.alias("worst")
    )
    status = F.when(F.col("worst") == 4, "blocked").when(F.col("worst") == 3, "non_compliant").when(F.col("worst") > 0, "compliant_with_warnings").when(F.col("missing_data") > 0, "unknown").otherwise("compliant")
    advice = F.when(F.col("worst") == 4, "blocked").when(F.col("worst") == 3, "safe_after_remediation").when(F.col("missing_data") > 0, "needs_review").otherwise("safe_for_ring_1")
    return out.withColumn("status", status).withColumn("recommendation", advice).drop("worst")


def demo_rules(spark: SparkSession) -> DataFrame:
    """Rules over the parts' types, one for each way of evaluating."""
    item = "array<struct<component_type:string,operator:string,version:string>>"
    rows = [
        ("R1", "critical", "AND", [], [("ECONOMY", ">=", "10.2")]),
        ("R2", "warning", "AND", [("STANDARD", "installed", None)], [("STANDARD", ">=", "20"), ("PROMO", "<", "45.1")]),
        ("R3", "blocker", "OR", [("SMALL", ">=", "48"), ("LARGE", ">=", "49")], [("SMALL", "<", "49")]),
        ("R4", "info", "AND", [("MEDIUM", "installed", None), ("PROMO", "installed", None)], [("MEDIUM", "!=", "7.1.1")]),
    ]
    return spark.createDataFrame(rows, f"rule_id string, severity string, logic string, conditions {item}, requirements {item}")


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as devices, their parts as components."""
    both = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("l_orderkey").alias("device_id"), F.element_at(F.split("p_type", " "), 1).alias("component_type"), F.concat_ws(".", "p_size", "l_linenumber", F.col("l_quantity").cast("int")).alias("version"))


def exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("device_id"), F.lit("R1").alias("rule_id"))


SQL_SCAN = """
inv AS (SELECT l_orderkey AS device_id, split_part(p_type, ' ', 1) AS ct, [p_size, l_linenumber, CAST(l_quantity AS INTEGER)] AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT device_id, bool_or(ct = 'STANDARD') AS std, bool_or(ct = 'MEDIUM') AS med, bool_or(ct = 'PROMO') AS promo, bool_or(ct = 'SMALL') AS small,
 bool_or(ct = 'ECONOMY') AS eco, bool_or(v >= [10, 2, 0]) FILTER (ct = 'ECONOMY') AS eco_ok, bool_or(v >= [20, 0, 0]) FILTER (ct = 'STANDARD') AS std_ok, bool_or(v < [45, 1, 0]) FILTER (ct = 'PROMO') AS promo_ok,
 coalesce(bool_or(v >= [48, 0, 0]) FILTER (ct = 'SMALL'), false) AS s48, coalesce(bool_or(v >= [49, 0, 0]) FILTER (ct = 'LARGE'), false) AS l49, bool_or(v < [49, 0, 0]) FILTER (ct = 'SMALL') AS s_ok, bool_or(v <> [7, 1, 1]) FILTER (ct = 'MEDIUM') AS med_ok FROM inv GROUP BY device_id),
s AS (SELECT device_id, 'R1' AS rule_id, 'critical' AS severity, CAST(coalesce(eco_ok, false) AS INT) AS met, CAST(coalesce(NOT eco_ok, false) AS INT) AS unmet, 1 AS n FROM d WHERE device_id % 50 <> 0 OR device_id NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT device_id, 'R2', 'warning', CAST(coalesce(std_ok, false) AS INT) + CAST(coalesce(promo_ok, false) AS INT), CAST(coalesce(NOT std_ok, false) AS INT) + CAST(coalesce(NOT promo_ok, false) AS INT), 2 FROM d WHERE std
 UNION ALL SELECT device_id, 'R3', 'blocker', CAST(coalesce(s_ok, false) AS INT), CAST(coalesce(NOT s_ok, false) AS INT), 1 FROM d WHERE s48 OR l49
 UNION ALL SELECT device_id, 'R4', 'info', CAST(coalesce(med_ok, false) AS INT), CAST(coalesce(NOT med_ok, false) AS INT), 1 FROM d WHERE med AND promo),
scan AS (SELECT device_id, rule_id, severity, CASE WHEN unmet > 0 THEN 'fail' WHEN n - met - unmet > 0 THEN 'unknown' ELSE 'pass' END AS outcome, met, unmet, n - met - unmet AS unknown FROM s)"""
SQL_SCORE = """
score AS (SELECT device_id, count(*) AS applicable, count(*) FILTER (outcome = 'fail') AS violations, count(*) FILTER (outcome = 'unknown') AS missing_data,
 greatest(0, 100 - sum(CASE WHEN outcome <> 'fail' THEN 0 WHEN severity = 'blocker' THEN 100 WHEN severity = 'critical' THEN 42 WHEN severity = 'warning' THEN 15 ELSE 5 END)) AS score,
 max(CASE WHEN outcome <> 'fail' THEN 0 WHEN severity = 'blocker' THEN 4 WHEN severity = 'critical' THEN 3 WHEN severity = 'warning' THEN 2 ELSE 1 END) AS worst FROM scan GROUP BY device_id)"""


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan(inventory(spark, sf), demo_rules(spark), exceptions(spark, sf))


@query("compliance_scan", f"WITH {SQL_SCAN} SELECT * FROM scan")
def compliance_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf)


@query("compliance_score", f"""WITH {SQL_SCAN}, {SQL_SCORE} SELECT device_id, applicable, violations, missing_data, score,
 CASE WHEN worst = 4 THEN 'blocked' WHEN worst = 3 THEN 'non_compliant' WHEN worst > 0 THEN 'compliant_with_warnings' WHEN missing_data > 0 THEN 'unknown' ELSE 'compliant' END AS status,
 CASE WHEN worst = 4 THEN 'blocked' WHEN worst = 3 THEN 'safe_after_remediation' WHEN missing_data > 0 THEN 'needs_review' ELSE 'safe_for_ring_1' END AS recommendation FROM score""")
def compliance_score(spark: SparkSession, sf: str) -> DataFrame:
    return score(_scan(spark, sf))


@query("violations_by_rule", f"WITH {SQL_SCAN} SELECT rule_id, severity, outcome, count(*) AS devices FROM scan GROUP BY ALL")
def violations_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf).groupBy("rule_id", "severity", "outcome").agg(F.count("*").alias("devices"))


@query("remediation_estimate", f"WITH {SQL_SCAN} SELECT severity, count(*) AS violations, round(count(*) * 12 / 60, 1) AS hours FROM scan WHERE outcome = 'fail' GROUP BY severity")
def remediation_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _scan(spark, sf).where("outcome = 'fail'").groupBy("severity").agg(F.count("*").alias("violations"), F.round(F.count("*") * MINUTES / 60, 1).alias("hours"))


@query("fleet_summary", f"WITH {SQL_SCAN}, {SQL_SCORE} SELECT o_orderpriority AS ring, count(*) AS devices, round(avg(score), 6) AS mean_score, sum(violations) AS violations FROM score JOIN orders ON device_id = o_orderkey GROUP BY 1")
def fleet_summary(spark: SparkSession, sf: str) -> DataFrame:
    both = score(_scan(spark, sf)).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("device_id"), F.col("o_orderpriority").alias("ring")), "device_id")
    return both.groupBy("ring").agg(F.count("*").alias("devices"), F.round(F.avg("score"), 6).alias("mean_score"), F.sum("violations").alias("violations"))


@query("component_inventory", "SELECT l_orderkey AS device_id, count(*) AS components, count(DISTINCT split_part(p_type, ' ', 1)) AS component_types FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def component_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory(spark, sf).groupBy("device_id").agg(F.count("*").alias("components"), F.countDistinct("component_type").alias("component_types"))


@query("compliance_graph_edges", f"WITH {SQL_SCAN} SELECT type, count(*) AS edges FROM (SELECT 'APPLIES_TO' AS type FROM scan UNION ALL SELECT 'VIOLATES' FROM scan WHERE outcome = 'fail' UNION ALL SELECT 'HAS_COMPONENT' FROM inv) GROUP BY type")
def compliance_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph(_scan(spark, sf), inventory(spark, sf)).groupBy("type").agg(F.count("*").alias("edges"))


def graph(scanned: DataFrame, components: DataFrame) -> DataFrame:
    """Edges (source, target, type) of a scan for a property graph."""
    edge = lambda df, a, b, t: df.select(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(t).alias("type"))
    return edge(scanned, "rule_id", "device_id", "APPLIES_TO").union(edge(scanned.where("outcome = 'fail'"), "device_id", "rule_id", "VIOLATES")).union(edge(components, "device_id", "component_type", "HAS_COMPONENT"))


@query("scenario_inventory_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND contains(o_orderpriority, 'URGENT')")
def scenario_inventory_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & F.contains("o_orderpriority", F.lit("URGENT"))).select("o_orderkey")
