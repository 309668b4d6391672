"""Feeds against a recursive walk."""

import json
import random

from tessera.operators import vulnerabilities as N


def tree(r, depth):
    node = {}
    if r.random() < 0.8:
        node["cpeMatch"] = [{"criteria": r.choice(["a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "", None])} for _ in range(r.randrange(4))]
    if depth and r.random() < 0.8:
        node["nodes"] = [tree(r, depth - 1) for _ in range(r.randrange(3))]
    return node


def walk(node):
    for m in node.get("cpeMatch") or []:
        if m.get("criteria"):
            yield m["criteria"]
    for n in node.get("nodes") or []:
        yield from walk(n)


def test_products_equal_a_walk(spark):
    r = random.Random(1)
    items = [[{"nodes": [tree(r, 6) for _ in range(r.randrange(3))]} for _ in range(r.randrange(3))] for _ in range(80)]
    deep = {"cpeMatch": [{"criteria": "bottom"}]}
    for i in range(20):
        deep = {"nodes": [deep], "cpeMatch": [{"criteria": "a" if i % 2 else "b"}]}
    items.append([{"nodes": [deep]}])
    feed = spark.createDataFrame([(i, json.dumps({"cve": {"configurations": c}}), 1) for i, c in enumerate(items)], "item_no long, raw string, cve int")
    got = {x["item_no"]: x["affected_products"] for x in N.map_vulnerabilities(feed).collect()}
    for i, c in enumerate(items):
        assert got[i] == list(dict.fromkeys(p for conf in c for n in conf.get("nodes") or [] for p in walk(n)))[:8], i


def test_fields(spark):
    metric = lambda score, severity=None, outer=None: {"cvssData": {"baseScore": score, "baseSeverity": severity, "vectorString": "V"}, "baseSeverity": outer}
    cve = {
        "id": "CVE-1", "descriptions": [{"lang": "fr", "value": "non"}, {"lang": "en", "value": "yes"}, {"lang": "en", "value": "later"}], "published": "p", "lastModified": "m", "cisaExploitAdd": "d", "cisaActionDue": "e", "cisaRequiredAction": "f",
        "metrics": {"cvssMetricV2": [metric(9.0, None, "LOW")], "cvssMetricV30": [metric(9.0, "HIGH")], "cvssMetricV40": [metric(None, "X")], "cvssMetricV31": []}, "references": {"referenceData": [{"url": f"u{i}"} for i in range(9)]},
    }
    raws = [json.dumps({"cve": cve}), None, "{broken", "{}", json.dumps({"cve": {"descriptions": 5, "metrics": None, "references": [{"url": None}, {"x": 1}], "configurations": {}}}), json.dumps({"cve": {"metrics": {"cvssMetricV2": [metric(0, "A"), metric(None, "B")]}}})]
    got = {x["item_no"]: x for x in N.map_vulnerabilities(spark.createDataFrame(list(enumerate(raws)), "item_no long, raw string")).collect()}
    first = got[0]
    assert [(m["source"], m["score"], m["severity"], m["vector"]) for m in first["metrics"]] == [("CVSS v4.0", None, "X", "V"), ("CVSS v3.0", 9.0, "HIGH", "V"), ("CVSS v2.0", 9.0, "LOW", "V")]
    assert tuple(first)[1:5] + tuple(first)[6:8] == ("CVE-1", "yes", "p", "m", 9.0, "HIGH") and first["references"] == ["u0", "u1", "u2", "u3", "u4"] and tuple(first)[10:] == (True, "d", "e", "f")
    for i in (1, 2, 3, 4):
        assert (got[i]["cve_id"], got[i]["description"], got[i]["metrics"], got[i]["affected_products"], got[i]["references"], got[i]["kev"], got[i]["best_score"]) == ("UNKNOWN", "", [], [], [], False, None)
    assert (got[5]["best_score"], got[5]["severity"]) == (0.0, "A")
    assert N.map_vulnerabilities(spark.createDataFrame([], "item_no long, raw string")).count() == 0
