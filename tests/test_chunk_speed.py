"""Chunks with less work: the same words, pieces and chunks as before, of the columns that are asked for, by enough tasks."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking
from tessera.plans import registry

TEXTS = ["", " ", "a", " a  b ", "a\tb\nc\x0bd\fe\rf", "x y z", "Vendor", "Vendor\nDell", "a  b", "a • b", "a&amp;b", "a ", " a", "a ", "a\x85b", "1.2.3", "Ask desk 9 for help.", "a\x1fb", None]


def blocks(spark, texts):
    names = [c.split()[0] for c in chunking.BLOCK.split(", ")]
    return spark.createDataFrame([tuple({"doc_id": i, "block_no": 0, "text": t}.get(n) for n in names) for i, t in enumerate(texts)], chunking.BLOCK)


def test_word_count_counts_runs(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.word_count(F.col("t")).alias("n")).collect()
    assert all(r["n"] == len([w for w in re.split(r"[ \t\n\x0b\f\r]+", r["t"] or "") if w]) for r in got)


def test_plain_lines_are_cleaned_as_others(spark):
    # a line in front makes a text of several lines, which takes the long way
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "t string")
    t = F.col("t")
    for r in rows.select(chunking.clean(t).alias("a"), chunking.clean(F.concat(F.lit("1.\n1.\n"), t)).alias("b")).collect():
        assert "\n".join(["1.", "1.", *([r["a"]] if r["a"] else [])]) == r["b"]


@pytest.mark.parametrize("name", ["chunk_blocks"])
def test_queries_carry_what_they_read(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "classified as" not in plan and "metadata_penalty" not in plan
    assert "RepartitionByExpression [doc_id" in plan and "], 4" in plan


def test_columns_are_those_of_all(spark):
    some = blocks(spark, ["# 1. Overview\nThis page lists orders of one customer. It must be read whole.\nHub 7 is not supported with firmware 1.2.3 or later.", "Hub 9 requires firmware 2.0.1 here.\n\nHub 9 requires firmware 2.0.1 here."])
    whole, part = chunking.chunk_blocks(some), chunking.chunk_blocks(some, columns=("doc_id", "chunk_index", "text", "llm_usage"))
    assert part.columns == ["doc_id", "chunk_index", "text", "llm_usage"] and part.count()
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, whole.select(*part.columns).collect()))
