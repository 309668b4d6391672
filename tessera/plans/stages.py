"""Steps of a plan that stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns added or replaced that are worked out once for each row, however often later steps name them.

    The optimizer merges projections, and moves filters below them, by putting a column's expression in each
    place that names it. It doesn't do so with what a generator gives, so the columns are generated, one row from one.
    """
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select("*", F.explode_outer(F.array(made)).alias("once_")).select(*kept, *(F.col(f"once_.{n}") for n in columns))
