"""The manifest against a plain recursion, over uneven partitions, and its proofs."""

import hashlib
import random
import zlib

import pytest

from tessera.llm import manifest

DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string, index int"  # the last two clash with names used inside
FAN = 16


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def siblings(tree, at):
    found = []
    for nodes in tree[:-1]:
        run = at // FAN * FAN
        found += [n for i, n in enumerate(nodes[run : run + FAN], run) if i != at]
        at //= FAN
    return found


def fold(tree, at, own):
    for nodes in tree[:-1]:
        run = nodes[at // FAN * FAN : at // FAN * FAN + FAN]
        run[at % FAN] = own
        own, at = h(*run), at // FAN
    return own


def brute(rows):
    trees, own = {}, {}
    for row in rows:
        own.setdefault(row[1], []).append(row)
    order = sorted(own, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        own[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in own[s]])
    roots = levels([trees[s][-1][0] for s in order])
    root, out = roots[-1][0], []
    for k, s in enumerate(order):
        for at, r in enumerate(own[s]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = fold(roots, k, fold(trees[s], at, leaf((*r[:4], text))))
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*siblings(trees[s], at), *siblings(roots, k)), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows, parts):
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS).repartition(parts)
    made = manifest.manifest(docs, manifest.tampered())
    return sorted((tuple(r) for r in manifest.proofs(made).collect()), key=repr)


def test_manifest_equals_recursion(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choices(["hot", None, "", "é", "z"], [9, 1, 1, 1, 1])[0], r.choice(["en", None]), r.choice([None, 5]), r.choice([None, "", "Text A", f"ÄBC {i}"])) for i in range(700)]
    rows += [(None, "hot", None, None, None)] * 3 + [rows[5]] * 4 + [(7, "hot", "other", 1, "T")] + [(10**6 + i, f"only {i}", "en", 1, "One") for i in range(40)]
    rows += [(i, "even", "en", 1, "X") for i in range(2000, 2256)] + [(i, "more", "en", 1, "X") for i in range(3000, 3017)] + [(4000, "long", "en", 1, "Long " * 40000)]
    want = brute(rows)
    assert got(spark, rows, 3) == want
    monkeypatch.setattr(manifest, "LAID", 37)  # stretches of few leaves, none aligned
    assert got(spark, rows, 2) == want


def test_deep_source_and_small_tables(spark, monkeypatch):
    rows = [(i, "a" if i < 4200 else "b", "en", 1, f"T{i}") for i in range(4210)]  # more leaves than a block, a short run of one at three levels
    monkeypatch.setattr(manifest, "LAID", 900)
    assert got(spark, rows, 2) == brute(rows)
    for n in (1, 17):
        assert got(spark, rows[:n], 1) == brute(rows[:n])
    assert got(spark, [], 1) == []


def test_proof_is_returned(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "t") for i in range(60)]
    made = manifest.manifest(spark.createDataFrame([(*r, "k", 1) for r in rows], DOCS))
    found = manifest.proofs(made, siblings=True).collect()
    assert len(found) == 60 and all(r["verified"] for r in found)
    # 20 leaves are runs of 16 and 4, their two parents one run, the three sources another
    assert sorted(len(r["proof"]) for r in found) == [3 + 1 + 2] * 12 + [15 + 1 + 2] * 48
    assert all(h(*r["proof"]) == r["proof_sha256"] for r in found)


@pytest.mark.parametrize("stretches", [[(0, 300)], [(0, 5), (5, 300)], [(0, 16), (16, 31), (31, 273), (273, 300)], [(i, i + 1) for i in range(300)]])
def test_mountains_leave_only_edges_open(stretches):
    leaves = [h(str(i)) for i in range(300)]
    want = levels(leaves)
    for a, b in stretches:
        out = []
        stack = manifest.Mountains(out)
        stack.key = "k"
        for i in range(a, b):
            stack.push(i, leaves[i])
        stack.end(b == 300)
        assert all(want[level][index] == digest for _, level, index, digest, _, _ in out)
        opened = [x for x in out if x[4]]
        assert len({(x[1], x[2] // FAN) for x in opened}) <= 2 * len(want)
        if (a, b) == (0, 300):
            assert not opened and [x[3] for x in out if x[5]] == want[-1]
