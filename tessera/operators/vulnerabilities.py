"""Items of vulnerability feeds as rows: texts, metrics of four versions, products nested at any depth, references.

Feeds are read as Variant. Configurations are trees of unknown depth, so products are gathered level by level to
a fixed point: each round explodes the nodes of one level, all items together, and ends when no node
has children. A product's place is the path of places that leads to it, so that order over levels is the
order in which a walk of the tree would meet them, a node's own before its children's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.graph import _cut
from tessera.plans.registry import query, table
from tessera.plans.stages import once

#: Where metrics stand and what they are called, the newest first; products and references that are shown.
METRICS = (("cvssMetricV40", "CVSS v4.0"), ("cvssMetricV31", "CVSS v3.1"), ("cvssMetricV30", "CVSS v3.0"), ("cvssMetricV2", "CVSS v2.0"))
PRODUCTS, REFERENCES = 8, 5
METRIC = "array<struct<cvssData: struct<baseScore: double, baseSeverity: string, vectorString: string>, baseSeverity: string>>"


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def metrics(cve: Column) -> Column:
    """All metrics as (source, score, severity, vector), in order of ``METRICS``."""
    none = F.array().cast("array<struct<source: string, score: double, severity: string, vector: string>>")

    def named(key: str, label: str) -> Column:
        found = F.filter(F.coalesce(F.try_variant_get(cve, f"$.metrics.{key}", METRIC), F.array().cast(METRIC)), lambda m: m.isNotNull())
        data = lambda m, f: m["cvssData"][f]
        return F.transform(found, lambda m: F.struct(F.lit(label).alias("source"), data(m, "baseScore").alias("score"), F.coalesce(F.nullif(data(m, "baseSeverity"), F.lit("")), m["baseSeverity"]).alias("severity"), data(m, "vectorString").alias("vector")))

    return reduce(lambda a, b: F.concat(a, b), [named(*m) for m in METRICS], none)


def best_metric(found: Column) -> Column:
    """The metric with the highest score, none counting as 0; the first of several."""
    return F.aggregate(found, F.lit(None).cast("struct<source: string, score: double, severity: string, vector: string>"), lambda best, m: F.when(best.isNull() | (F.coalesce(m["score"], F.lit(0.0)) > F.coalesce(best["score"], F.lit(0.0))), m).otherwise(best))


def products(items: DataFrame, most: int = PRODUCTS) -> DataFrame:
    """(item_no, affected_products) of ``items`` (item_no, cve): the first ``most`` different criteria in order of a walk."""
    none = F.array().cast("array<int>")
    configs = items.select("item_no", none.alias("at"), F.posexplode(_list(F.col("cve"), "$.configurations")).alias("p", "c"))
    nodes = configs.select("item_no", F.array("p").alias("at"), F.posexplode(_list(F.col("c"), "$.nodes")).alias("p", "node")).select("item_no", F.concat("at", F.array("p")).alias("at"), "node")
    found = None
    level = _cut(nodes)
    while True:
        own = level.select("item_no", "at", F.posexplode(_list(F.col("node"), "$.cpeMatch")).alias("m", "match")).select("item_no", F.concat("at", F.array(F.lit(-1), F.col("m"))).alias("at"), _text(F.col("match"), "$.criteria").alias("criteria")).where("criteria <> ''")
        found = own if found is None else found.unionByName(own)
        below = level.select("item_no", "at", F.posexplode(_list(F.col("node"), "$.nodes")).alias("p", "below")).select("item_no", F.concat("at", F.array("p")).alias("at"), F.col("below").alias("node"))
        level = _cut(below)
        if not level.take(1):
            break
    first = found.groupBy("item_no", "criteria").agg(F.min("at").alias("at"))
    shown = first.withColumn("n", F.row_number().over(Window.partitionBy("item_no").orderBy("at"))).where(F.col("n") <= most)  # the products of one item
    return shown.groupBy("item_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "criteria"))), lambda x: x["criteria"]).alias("affected_products"))


def map_vulnerabilities(feed: DataFrame) -> DataFrame:
    """Items of a feed (item_no, raw), raw being an item's JSON, as one row each.

    cve_id, description (the first English one), published, last_modified, metrics, best_score, severity, affected_products, references, kev, kev_added, kev_due_date and kev_required_action.

    * Null or broken JSON, and what an item lacks: cve_id UNKNOWN, empty description and lists, the rest null; kev is false.
    * Rows with one item_no share their products. Lists that are no lists, and nulls in lists, count as absent. An empty table gives none.
    """
    items = once(feed.select("item_no", "raw"), cve=F.try_variant_get(F.try_parse_json("raw"), "$.cve", "variant"))
    cve = F.col("cve")
    english = F.filter(F.coalesce(F.try_variant_get(cve, "$.descriptions", "array<struct<lang: string, value: string>>"), F.array().cast("array<struct<lang: string, value: string>>")), lambda d: d["lang"] == "en")
    links = F.coalesce(F.try_variant_get(cve, "$.references", "array<struct<url: string>>"), F.try_variant_get(cve, "$.references.referenceData", "array<struct<url: string>>"), F.array().cast("array<struct<url: string>>"))
    urls = F.slice(F.filter(F.transform(links, lambda x: x["url"]), lambda u: u.isNotNull() & (u != "")), 1, REFERENCES)
    told = once(items, metrics=metrics(cve), description=F.coalesce(F.get(english, F.lit(0))["value"], F.lit("")), references=urls)
    best = once(told, best=best_metric(F.col("metrics"))).join(products(items.select("item_no", "cve")), "item_no", "left")
    added = _text(cve, "$.cisaExploitAdd")
    return best.select(
        "item_no", F.coalesce(_text(cve, "$.id"), F.lit("UNKNOWN")).alias("cve_id"), "description", _text(cve, "$.published").alias("published"), _text(cve, "$.lastModified").alias("last_modified"), "metrics", F.col("best.score").alias("best_score"), F.col("best.severity").alias("severity"),
        F.coalesce("affected_products", F.array().cast("array<string>")).alias("affected_products"), "references", (F.coalesce(added, F.lit("")) != "").alias("kev"), added.alias("kev_added"), _text(cve, "$.cisaActionDue").alias("kev_due_date"), _text(cve, "$.cisaRequiredAction").alias("kev_required_action"),
    )


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as items of a feed, whose products stand up to thirteen levels deep."""
    k, depth = F.col("p_partkey"), F.pmod(F.col("p_partkey"), F.lit(13)).cast("int")
    leaf = F.concat(F.lit('{"cpeMatch": [{"criteria": "cpe:'), k.cast("string"), F.lit('"}, {"criteria": "cpe:1"}, {"criteria": null}]}'))
    tree = F.aggregate(F.sequence(F.lit(0), depth), leaf, lambda acc, i: F.when(i == 0, acc).otherwise(F.concat(F.lit('{"cpeMatch": [{"criteria": "cpe:'), i.cast("string"), F.lit('"}], "nodes": ['), acc, F.lit("]}"))))
    metric = lambda score, outer: F.concat(F.lit('[{"cvssData": {"baseScore": '), score, F.lit(', "vectorString": "V"'), F.lit("" if outer else ', "baseSeverity": "HIGH"'), F.lit('}, "baseSeverity": "LOW"}]'))
    raw = F.concat(
        F.lit('{"cve": {"id": "CVE-'), k.cast("string"), F.lit('", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "'), F.col("p_name"), F.lit('"}], "metrics": {"cvssMetricV2": '), metric(F.format_number(F.col("p_size") / 10, 1), True),
        F.when(k % 2 == 0, F.concat(F.lit(', "cvssMetricV31": '), metric(F.lit("2.5"), False))).otherwise(""), F.lit('}, "references": [{"url": "u1"}, {"url": ""}, {"url": "u2"}]'), F.when(k % 3 == 0, ', "cisaExploitAdd": "2024-01-01"').otherwise(""), F.lit(', "configurations": [{"nodes": ['), tree, F.lit("]}]}}"),
    )
    return table(spark, sf, "part").select(k.alias("item_no"), raw.alias("raw"))


@query("vulnerability_feed", """
SELECT p_partkey AS item_no, 'CVE-' || p_partkey AS cve_id, p_name AS description, CASE WHEN p_partkey % 2 = 0 AND p_size / 10.0 <= 2.5 THEN 2.5 ELSE CAST(p_size / 10.0 AS DOUBLE) END AS best_score, CASE WHEN p_partkey % 2 = 0 AND p_size / 10.0 <= 2.5 THEN 'HIGH' ELSE 'LOW' END AS severity, p_partkey % 3 = 0 AS kev, 'u1,u2' AS refs,
 array_to_string(list_transform((list_filter(list_concat(list_reverse(range(1, p_partkey % 13 + 1)), [p_partkey]), lambda x, i: i <= p_partkey % 13 OR p_partkey > p_partkey % 13 OR p_partkey = 0) || CASE WHEN p_partkey % 13 >= 1 OR p_partkey = 1 THEN [] ELSE [1] END)[:8], lambda x: 'cpe:' || x), ',') AS products FROM part""")
def vulnerability_feed(spark: SparkSession, sf: str) -> DataFrame:
    found = map_vulnerabilities(_feed(spark, sf))
    return found.select("item_no", "cve_id", "description", "best_score", "severity", "kev", F.array_join("references", ",").alias("refs"), F.array_join("affected_products", ",").alias("products"))
