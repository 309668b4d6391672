"""A failing rule for each check, with its path; rings of prerequisites by brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import rule_checks as R
from tessera.operators.graph import ring_chains, rings

VERSION = {"operator": ">=", "version_normalized": "1.2.0", "version_scheme": "semantic", "requirement_kind": "min_version"}
SIDE = {"component_name": "Dock", "knowledge_category": "Driver", "version_constraint": VERSION}
CONDITION = {"entity_id": "E3", "component_name": "Hub", "version_normalized": "1.2", "version_scheme": "semantic"}
EVIDENCE = {"evidence_id": "EVID-A1-1", "source_document_id": "DOC-A1", "source_type": "manual_review", "source_excerpt": "x", "confidence_score": 0.5, "verification_status": "source_verified"}
GOOD = {
    "rule_id": "CRULE-A-001", "rule_type": "min_version_constraint", "status": "candidate", "previous_status": None, "approval_status": "candidate", "severity": "warning", "predicate": "REQUIRES", "subject": {"entity_id": "E1", **SIDE}, "object": {"entity_id": "E2", **SIDE},
    "condition_logic": "AND", "conditions": [CONDITION, CONDITION], "dependencies": [{"entity_id": "E1"}], "conflicts": [{"entity_id": "E2"}], "remediations": [{"target_entity_id": "E1", "target_version": "2"}], "evidence": [EVIDENCE], "source_document": "DOC-A1", "confidence": 0.9,
    "approved_by": None, "approved_at": None, "sequence_step": None, "sequence_prerequisite_ref": None,
}
APPROVED = {"status": "approved", "previous_status": "validated", "approved_by": "a", "approved_at": "b"}
ORDER = {"rule_type": "update_order_constraint"}


def at(path, value, **more):
    """``GOOD`` with one field changed; ``conditions.1.entity_id`` is in the second element."""
    rule = json.loads(json.dumps(GOOD | more))
    *way, last = path.split(".")
    node = rule
    for w in way:
        node = node[int(w)] if w.isdigit() else node[w]
    node[last] = value
    return rule


CASES = [
    ("VR-001", "subject.entity_id", at("subject.entity_id", "E9")), ("VR-002", "object.entity_id", at("object.entity_id", None)), ("VR-003", "conditions[1].entity_id", at("conditions.1.entity_id", "E9")), ("VR-004", "dependencies[0].entity_id", at("dependencies.0.entity_id", "E9")),
    ("VR-005", "remediations[0].target_entity_id", at("remediations.0.target_entity_id", "E9")), ("VR-006", "conflicts[0].entity_id", at("conflicts.0.entity_id", "E9")), ("VR-007", "subject.entity_id", at("subject.entity_id", "E2")),
    ("VR-008", "subject.version_constraint.version_normalized", at("subject.version_constraint.version_normalized", "1")), ("VR-009", "object.version_constraint.version_normalized", at("object.version_constraint.version_normalized", "1.x")), ("VR-010", "conditions[0].version_normalized", at("conditions.0.version_normalized", "a.1")),
    ("VR-011", "remediations[0].target_version", at("remediations.0.target_version", "")), ("VR-012", "confidence", at("confidence", 1.5)), ("VR-012", "confidence", at("confidence", None)), ("VR-013", "confidence", at("confidence", 0.69)), ("VR-014", "evidence[0].evidence_id", at("evidence.0.evidence_id", "EVID-1")),
    ("VR-015", "evidence[0].source_document_id", at("evidence.0.source_document_id", "doc")), ("VR-016", "evidence[0].source_type", at("evidence.0.source_type", "rumour")), ("VR-017", "evidence[0].source_excerpt", at("evidence.0.source_excerpt", None)), ("VR-018", "evidence[0].confidence_score", at("evidence.0.confidence_score", -0.1)),
    ("VR-019", "evidence", at("evidence", [], **APPROVED)), ("VR-020", "predicate", at("predicate", "NEEDS")), ("VR-021", "status", at("status", "pending")), ("VR-021", "status", at("status", "approved", **APPROVED | {"previous_status": "rejected"})), ("VR-022", "status", at("status", "candidate", previous_status="archived")),
    ("VR-023", "approved_by", at("approved_by", None, **APPROVED)), ("VR-023", "approved_at", at("approved_at", None, **APPROVED)), ("VR-024", "rule_id", at("rule_id", None)), ("VR-025", "rule_type", at("rule_type", "other")), ("VR-026", "subject", at("subject", None)), ("VR-027", "object", at("object.knowledge_category", None)),
    ("VR-028", "evidence", at("evidence", None)), ("VR-029", "remediations", at("remediations", None)), ("VR-032", "severity", at("severity", "critical", rule_type="feature_support_added")), ("VR-033", "condition_logic", at("condition_logic", "BOTH")), ("VR-034", "source_document", at("source_document", "DOC-B2")),
    ("VR-035", "sequence_step", at("sequence_step", None, **ORDER)), ("VR-036", "sequence_prerequisite_ref", at("sequence_step", 2, **ORDER)), ("VR-038", "conditions", at("conditions", [CONDITION], rule_type="incompatible_combination")), ("VR-039", "source_document", at("source_document", None)), ("VR-040", "rule_id", at("rule_id", "CRULE-a-1")),
    ("SAFETY-001", "approval_status", at("approval_status", "approved")), ("SAFETY-002", "predicate", at("predicate", "RELATED_TO")), ("SCHEMA-PARTICIPANT", "object.component_name", at("object.component_name", None)), ("SCHEMA-VERSION", "subject.version_constraint.operator", at("subject.version_constraint.operator", "")),
    ("SCHEMA-CONDITION", "conditions[1].component_name", at("conditions.1.component_name", "")), ("EVIDENCE-UNVERIFIED", "evidence[0].verification_status", at("evidence.0.verification_status", "pending")),
]


def checked(spark, rules):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rules)], "n int, j string").select("n", F.from_json("j", R.RULE).alias("r")).select("n", "r.*")
    registry = spark.createDataFrame([("E1",), ("E2",), ("E3",), ("E3",)], "entity_id string")
    return {r["n"]: r for r in R.check_rules(rows, registry).collect()}


def test_each_check_fails_alone(spark):
    rules = []
    for i, (_, _, r) in enumerate(CASES):
        rules.append(r | ({"rule_id": f"CRULE-A-{i:03}"} if (r["rule_id"] or "").startswith("CRULE-A") else {}) | {"approved_by": r["approved_by"]})
    rules.append(GOOD | {"rule_id": "CRULE-A-900"})
    rules += [GOOD | APPROVED | {"rule_id": "CRULE-A-901"}, GOOD | APPROVED | {"rule_id": "CRULE-A-902"}]  # equal and approved
    rules += [GOOD | {"rule_id": "CRULE-A-903"}] * 2  # one id twice
    ring = [GOOD | ORDER | {"rule_id": f"CRULE-A-{910 + i}", "sequence_step": 1, "sequence_prerequisite_ref": f"CRULE-A-{910 + (i + 1) % 3}"} for i in range(3)]
    rules += [*ring, GOOD | ORDER | {"rule_id": "CRULE-A-920", "sequence_step": 2, "sequence_prerequisite_ref": "CRULE-A-910"}]
    got = checked(spark, rules)
    for i, (code, path, _) in enumerate(CASES):
        assert (code, path) in {(x["code"], x["path"]) for x in got[i]["issues"]}, (code, path, got[i]["issues"])
    n = len(CASES)
    assert got[n]["issues"] == [] and got[n]["status_of_checks"] == "PASSED"
    codes = {i: [x["code"] for x in got[i]["issues"]] for i in range(n, len(rules))}
    # the equal ones: as approval_status follows status in SAFETY-001 only for candidates, nothing else fails
    assert codes[n + 1] == [] or codes[n + 1] == ["VR-031"]
    first = min(got[i]["rule_id"] for i in range(len(rules)) if got[i]["status"] == "approved" and got[i]["conditions"] == got[n + 1]["conditions"] and got[i]["evidence"] is not None)
    assert codes[n + 2] == ["VR-031"] and got[n + 2]["equal_to"] == first and got[n + 2]["status_of_checks"] == "PASSED_WITH_WARNINGS"
    assert codes[n + 3] == codes[n + 4] == ["VR-030"] and got[n + 3]["status_of_checks"] == "FAILED"
    assert [codes[n + 5 + k] for k in range(4)] == [["VR-037"]] * 3 + [[]] and got[n + 5]["ring"] == "CRULE-A-910"
    assert {c for c, _, _ in CASES} | {"VR-030", "VR-031", "VR-037"} == {c.code for c in R.CHECKS}
    assert len({c for c in {c.code for c in R.CHECKS} if c.startswith("VR-")}) == 40
    assert checked(spark, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_equal_walks(spark, seed):
    r = random.Random(seed)
    nxt = {i: r.randrange(300) for i in range(0, 260)}
    found = rings(spark.createDataFrame(list(nxt.items()), "src long, dst long"))
    want = {}
    for v in nxt:
        path, x = [v], nxt[v]
        while x in nxt and x not in path:
            path.append(x)
            x = nxt[x]
        if x == v:
            k = path.index(min(path))
            want[v] = (min(path), (len(path) - k) % len(path), len(path))
    assert {x["node"]: (x["ring"], x["place"], x["length"]) for x in found.collect()} == want


def test_long_ring_and_empty(spark):
    n = 1500
    edges = [(i, (i + 7) % n) for i in range(n)] + [(n + i, n + i - 1) for i in range(1, 400)] + [(n, 5), (9000, 9000), (9001, None)]
    found = rings(spark.createDataFrame(edges, "src long, dst long"))
    (ring, own) = sorted(ring_chains(found).collect(), key=lambda x: x["ring"])
    assert (ring["ring"], ring["length"], own["chain"]) == (0, n, "9000 > 9000") and ring["chain"].startswith("0 > 7 > 14 > ") and ring["chain"].endswith(" > 0")
    assert rings(spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 0
    assert rings(spark.createDataFrame([], "src long, dst long")).count() == 0
