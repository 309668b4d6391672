"""Detections of evidence packages against a walk; version keys and short quotes."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions import versions as N
from tessera.functions import vocabulary as V
from tessera.operators import reasoning


def severity(text, default):
    return next((level for word, level in V.SEVERITY_WORDS if re.search(rf"\b{word}\b", text, re.I)), default)


def walk(question, evidence):
    out, seen = [], set()

    def add(*d):
        if d[:3] not in seen:
            seen.add(d[:3])
            out.append(d)

    for e in evidence or []:
        component = e["entity"] or e["target"] or "unknown"
        conf = 0.8 if e["confidence"] is None else e["confidence"]
        if e["evidence_type"] == "ViolationEvidence":
            add("RC-VERSION-MISMATCH", "VIOL-VERSION", component, severity(" ".join(e[k] or "" for k in ("source_excerpt", "description", "rule_type")), "High"), conf, "ViolationEvidence")
        elif e["evidence_type"] == "RiskEvidence":
            add("RC-UNKNOWN-STATE", "VIOL-COMPLIANCE", component, "High", conf, "RiskEvidence")
    every = " ".join([question or "", *(" ".join(e[k] or "" for k in ("source_excerpt", "description", "rule_type", "entity", "relationship")) for e in evidence or [])]).lower()
    component = next((e["entity"] for e in evidence or [] if (e["entity"] or "").lower() not in ("", "device", "unknown")), "device")
    for (word, cause, violation, risk), label in zip(V.VIOLATION_PATTERNS, V.VIOLATION_LABELS, strict=True):
        if word in every:
            add(cause, violation, component, severity(every, risk), 0.75, label)
    return out


def test_detections_equal_a_walk(spark):
    r = random.Random(3)
    texts = [None, "", "Critical upgrade", "not supported; warning", "an info on drift", "informational", "unknown order", "criticality of cve", *(p[0] for p in V.VIOLATION_PATTERNS)]
    names = ["evidence_type", "entity", "target", "confidence", "source_excerpt", "description", "rule_type", "relationship"]
    one = lambda: dict(zip(names, (r.choice(["ViolationEvidence", "RiskEvidence", "Other", None]), r.choice(["A", "B", "", None, "Device", "unknown"]), r.choice(["T", "", None]), r.choice([0.5, None, 0.9]), r.choice(texts), r.choice(texts), r.choice([None, "x"]), r.choice([None, "uses"])), strict=True))
    packages = [(i, r.choice(texts), r.choice([None, [one() for _ in range(r.randrange(5))]])) for i in range(150)]
    df = spark.createDataFrame([(i, q, None if e is None else [tuple(x.values()) for x in e], "x") for i, q, e in packages], f"report_id long, question string, evidence {V.EVIDENCE_ROWS}, low string")
    got = {i: [] for i, *_ in packages}
    for x in sorted(reasoning.detect_with_evidence(df).collect(), key=lambda x: x["detection_no"]):
        got[x["report_id"]].append(tuple(x)[2:])
    for i, q, e in packages:
        assert got[i] == walk(q, e), (q, e)


def test_version_keys_of_any_length(spark):
    long = ".".join("1" * 14)
    vs = ["17.3", "17.3.0", "17.3.0.0a", "17.3a", "17.3.1", "9.10", "9.9", "009.9", "x", "", None, "0", "0.0", "0.0b", "0.1", long, long + ".2", long + ".0", "1." + "9" * 30, "1." + "9" * 29, "1.0" + "9" * 29, "10", "100", "1.x"]

    def plain(v):
        m = re.fullmatch(r"(\d+(?:\.\d+)*)([a-z]?)", (v or "").strip(), re.I)
        numbers = [int(n) for n in m[1].split(".")] if m else []
        while numbers and not numbers[-1]:
            numbers.pop()
        return numbers, m[2].lower() if m else ""

    rows = spark.createDataFrame([(a, b) for a in vs for b in vs], "a string, b string").select("a", "b", N.compare(F.col("a"), F.col("b")).alias("c"), N.key(F.col("a")).alias("k")).collect()
    for x in rows:
        want = None if x["a"] is None or x["b"] is None else (plain(x["a"]) > plain(x["b"])) - (plain(x["a"]) < plain(x["b"]))
        assert x["c"] == want, x
        assert (x["k"] is None) == (x["a"] in ("x", "", None, "1.x"))


def test_short_passages_are_found(spark, tmp_path):
    from tessera.plans import registry

    texts = ["One two three four five six seven eight nine ten eleven.", "prefixthree four fivesuffix", None, "three  FOUR\nfive"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = ["three four five", "four", "eight nine", "two three four five six seven eight nine ten eleven.", "seven nine", "hree four fi", "one two three four five six seven eight nine"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: (r["documents"], r["first_doc"]) for r in registry.queries()["grounding_contains"](spark, str(tmp_path)).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (1, 0), 3: (1, 0), 4: (0, None), 5: (3, 0), 6: (1, 0)}
