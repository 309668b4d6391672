"""Edited passages that stand side by side in one document and elsewhere in another, against brute force over all places."""

import random

import numpy as np
import pytest

from tessera.llm import passages as P
from tessera.llm import shingles as S

LAYOUTS = ["adjacent", "swapped", "apart", "repeated", "three"]


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def edited(r, passage):
    out = list(passage)
    out[r.randrange(10, len(out) - 10)] = f"e{r.randrange(10**6)}"
    return out


def pair(seed, layout):
    """Two documents, and the words in the second one where each passage stands."""
    r = random.Random(seed)
    own = [words(r, 70) for _ in range(3 if layout == "three" else 2)]
    a = words(r, 60)
    for p in own:
        a += p + words(r, 300)
    order = {"swapped": [1, 0], "repeated": [0, 1, 0], "three": [2, 0, 1]}.get(layout, [0, 1])
    b, at = words(r, 40), []
    for k in order:
        at.append(len(b))
        b += edited(r, own[k]) + (words(r, 60) if layout == "apart" else [])
    return " ".join(a), " ".join(b + words(r, 50)), at


def covered(found, at):
    """Shares of the passage of 70 words at ``at`` that found places have."""
    inside = np.zeros(70, bool)
    for x, y in found:
        inside[max(0, x - at) : max(0, y - at)] = True
    return inside.mean()


def brute(a, b, at):
    """Whether the passage has a run in ``a`` that is like it, over all places of ``a``."""
    hashes, starts = S.sequence(*S.words([a, b]))
    x, y = hashes[starts[0] : starts[1]], hashes[starts[1] : starts[2]]
    own = set(y[at : at + 66].tolist())
    return any(len(own & (w := set(x[i : i + 66].tolist()))) >= P.SIMILAR * len(own | w) for i in range(len(x) - 65))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_stretches_of_passages_side_by_side(layout):
    hit = total = 0
    for seed in range(40):
        a, b, at = pair(seed, layout)
        hashes, starts = S.sequence(*S.words([a, b]))
        found = [(x, y + S.WIDTH - 1) for x, y, *_ in P.stretches(hashes[: starts[1]], hashes[starts[1] :])]
        for k in at:
            if brute(a, b, k):
                total += 1
                hit += covered(found, k) > 0.8
    assert total >= 60 and hit >= 0.95 * total, (hit, total)


def test_repeated_passages_side_by_side(spark):
    rows, places = [], {}
    for seed in range(50):
        layout = LAYOUTS[seed % 5]
        a, b, at = pair(1000 + seed, layout)
        rows += [(2 * seed, a), (2 * seed + 1, b)]
        places[2 * seed + 1] = (a, b, at, layout)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for parts in (2, 7):
        found = {}
        for r in P.repeated_passages(docs.repartition(parts)).collect():
            found.setdefault(r["doc_id"], []).append((r["start"], r["stop"]))
        results.append({d: sorted(x) for d, x in found.items()})
    assert results[0] == results[1] and all(d % 2 for d in results[0])
    for layout in LAYOUTS:
        told = [covered(results[0].get(d, []), k) > 0.8 for d, (a, b, at, kind) in places.items() if kind == layout for k in at if brute(a, b, k)]
        assert len(told) >= 15 and np.mean(told) >= 0.9, (layout, told)
