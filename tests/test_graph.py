"""Reachability and cycles of any length, and references against names that many entities have."""

from tessera.operators import graph, retrieval, rules


def test_reach_and_cycles_have_no_longest_way(spark):
    ring = [(i, (i + 1) % 9) for i in range(9)] + [(20, 0), (30, 31), (31, 30), (40, 40), (50, 51)]
    edges = spark.createDataFrame(ring, "src int, dst int")
    hops = {(r["src"], r["dst"]): r["hops"] for r in graph.reach(edges).collect()}
    assert hops[0, 8] == 8 and hops[20, 8] == 9 and hops[0, 0] == 9 and (50, 50) not in hops and (0, 20) not in hops
    assert max(r["hops"] for r in graph.reach(edges, 4).collect()) == 4
    assert {r["node"]: r["cycle_length"] for r in graph.cycles(edges).collect()} == {i: 9 for i in range(9)} | {30: 2, 31: 2, 40: 1}
    assert graph.reach(edges.limit(0)).count() == 0


def test_references_to_shared_names(spark):
    entities = spark.createDataFrame([(1, "Alpha"), (2, "beta box"), (3, "Beta-Box"), (4, "beta box")], "entity_id long, name string")
    aliases = spark.createDataFrame([("AX", 1), ("AX", 2), ("bee", 2)], "alias string, entity_id long")
    refs = spark.createDataFrame([(1, "Alpha", 9), (2, "beta box", 9), (3, "ALPHA", 1), (4, "AX", 9), (5, "Bee", 9), (6, None, 9), (7, "Beta-Box", 9)], "ref_id long, value string, source long")
    got = {r["ref_id"]: (r["status"], r["target"]) for r in graph.resolve(refs, entities, aliases).collect()}
    assert got == {1: ("resolved", 1), 2: ("ambiguous", None), 3: ("rejected_self", None), 4: ("ambiguous", None), 5: ("resolved", 2), 6: ("unresolved", None), 7: ("resolved", 3)}


def test_a_vector_of_length_zero_scores_zero(spark):
    rows = [(1, [0.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = retrieval.cosine_top_k(vectors.withColumnRenamed("vec_id", "query_id").drop("label"), vectors, 5).collect()
    assert all(r["score"] == 0 for r in found)


def test_blockers_are_counted_without_one_task_for_all(spark):
    some = spark.createDataFrame([(i,) for i in range(5)], "rule_id int")
    decisions = spark.createDataFrame([(i, "approve" if i else "reject") for i in range(4)], "rule_id int, decision string")
    got = rules.release(some, decisions).collect()
    assert {r["blockers"] for r in got} == {2} and sorted(r["status"] for r in got) == ["approved"] * 3 + ["blocked"] * 2
