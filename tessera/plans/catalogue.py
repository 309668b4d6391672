"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a catalogue (rules, policies, states) that are broadcast at most.
MOST = 200_000


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; a larger one is joined by shuffle, to be split by AQE where skewed."""
    return F.broadcast(df) if df.count() <= most else df
