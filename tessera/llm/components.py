"""Connected components by alternating large-star and small-star on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import drop, table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a, b); returns edges (a, b) with a > b."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(lows, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lows = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has two long columns; order, repeats and loops don't matter, null ends are left out.
    No neighbour list is built: each star is an aggregation and a join back, so a
    node with many edges costs no memory and its join can be split. Each round is
    written to the shared folder. Without edges the result is empty.
    """
    a, b = edges.columns[:2]
    now = table(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if mark == before or not mark["n"]:
            break
        before = mark
        big = table(_stars(now, True), "large")
        small = table(_stars(big, False), "small")
        drop(now, big)
        now = small
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
