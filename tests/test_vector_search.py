"""Vector searches: against all pairs in plain Python, and without a join of all pairs in their plans."""

import math
import random

import duckdb
import pytest

from tessera.operators import retrieval
from tessera.plans import registry

SCHEMA = "vec_id long, embedding array<float>, label int"


def near(rows, asked, k):
    """The k best of each query id by all pairs, ties to the smaller id."""
    out = {}
    for q, a in asked:
        for v, b, label in rows:
            if q is None or v is None or q == v or None in (a, b) or any(x is None or not math.isfinite(x) for x in (*a, *b)):
                continue
            n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            s = sum(x * y for x, y in zip(a, b, strict=True)) / n if n and len(a) == len(b) else 0.0
            out.setdefault(q, []).append((-round(s, 9) + 0.0, v, label))
    return {q: [(v, label, -s + 0.0) for s, v, label in sorted(found, key=lambda f: f[:2])[:k]] for q, found in out.items()}


@pytest.mark.parametrize("block", [4096, 7])
def test_nearest_equal_all_pairs(spark, monkeypatch, block):
    draw = random.Random(3)
    vector = lambda n: [float(draw.randint(-3, 3)) for _ in range(n)]
    rows = [(i, vector(4), draw.choice([0, 1, None])) for i in range(300)]
    rows += [(1000 - i, [1.0, 2.0, 0.0, 1.0], i) for i in range(60)]  # equal ones
    rows += [(2000, [0.0] * 4, 1), (2001, [], 1), (2002, vector(3), 1), (2003, vector(6), 1), (2004, [1.0, None, 1.0, 1.0], 1), (2005, [float("inf")] + vector(3), 1), (2006, None, 1), (None, vector(4), 1)]
    asked = [(i, e) for i, e, _ in rows if i is None or i % 5 == 0 or i > 1990]
    got = {}
    found = retrieval.cosine_top_k(spark.createDataFrame(asked, "query_id long, embedding array<float>"), spark.createDataFrame(rows, SCHEMA).repartition(3), 5, block=block)
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["label"], round(r["score"], 9) + 0.0))
    assert got == near(rows, asked, 5)


def test_no_vectors_and_no_queries(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [1.0], 0)], SCHEMA)
    ask = lambda v: v.select(v.vec_id.alias("query_id"), "embedding")
    assert [retrieval.cosine_top_k(ask(q), v, 3).count() for q, v in ((none, one), (one, none), (one, one))] == [0, 0, 0]


def test_combined_sides_of_any_label(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, [float(draw.randint(-9, 9)) for _ in range(5)], draw.choice([-3, -2, 0, 1, 2, None])) for i in range(120)]
    at = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(at)
    got = [tuple(r) for r in registry.queries()["search_combined"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/*.parquet'")
    want = con.sql(registry.oracle_sql()["search_combined"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["vector_topk", "search_combined", "label_retrieval_eval", "search_quality_report", "vector_threshold", "vector_topk_cutoff", "answer_confidence"])
def test_plan_joins_no_pairs(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
