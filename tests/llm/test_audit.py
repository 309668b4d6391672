"""The audit of filters against every order applied one by one."""

import random
import re
from itertools import permutations

from tessera.llm import audit

DOCS = "doc_id long, source string, text string, part string, words int, A string"  # the last three clash with names used inside
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(rows, labels):
    known = {}
    for i, q, t in labels:
        if i is not None:
            good, toxic = known.get(i, (False, False))
            known[i] = (good or q == 1, toxic or t == 1)
    docs = []
    for i, source, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in text for c in "#$%&*|"),
            "E": i is not None and any(j is not None and j < i and (u or "") == text for j, _, u in rows),
        }
        docs.append((source or "", fails, *known.get(i, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, "".join(order), step] = [len(left), len(gone), sum(d[1][f] for d in own) - len(gone), unique, sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key in [k for k in out if k[0] == part]:
            out[key][6] = shapley[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_every_order(spark):
    r = random.Random(5)

    def text():
        n = r.choice([0, 3, 199, 200, 260])
        w = [f"w{r.randrange(r.choice([90, 900]))}" for _ in range(n)]
        if r.random() < 0.3:
            w += ["SHOUT"] * 12
        if r.random() < 0.3:
            w.append(r.choice(list("#$%&*|")))
        return r.choice([" ", "\t", "\x0b\n ", " \r\f"]).join(w) + r.choice(["", " ", " é"])

    texts = [text() for _ in range(60)]
    rows = [(i, r.choice(["s1", "s2", None, ""]), r.choice(texts)) for i in range(150)]
    rows += [(None, "s1", texts[0]), (None, "s1", None), (151, None, None), (152, "s2", ""), (7, "s1", rows[7][2]), (7, "s1", rows[7][2]), (153, "long", "word " * 60000 + "Z"), (154, "one", "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*x, "p", 1, "a") for x in rows], DOCS)
    got = audit.audit(audit.failures(docs.repartition(5), spark.createDataFrame([(*x, "p") for x in labels], LABELS))).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * 5
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got} == want


def test_audit_of_no_rows_and_of_other_filters(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit.audit(audit.failures(spark.createDataFrame([], DOCS), labels)).count() == 0
    flags = spark.createDataFrame([("p", True, True, False, True), ("p", False, True, True, False), ("p", False, False, False, False)], "part string, short boolean, odd boolean, good boolean, toxic boolean")
    got = sorted(tuple(r) for r in audit.audit(flags, ("short", "odd")).collect())
    assert got == [("p", "oddshort", 1, 1, 2, 0, 1, 1, 1, 3), ("p", "oddshort", 2, 1, 0, 1, 0, 0, 0, 1), ("p", "shortodd", 1, 2, 1, 0, 0, 0, 1, 1), ("p", "shortodd", 2, 1, 1, 1, 1, 1, 0, 3)]
