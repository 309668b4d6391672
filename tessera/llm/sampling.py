"""Bounded samples of labelled rows for fitting, the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: str, parts: int, part: int) -> F.Column:
    """True where crc32 of the id's decimal text leaves ``part`` modulo ``parts``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


#: Bytes of text of each class that a sample holds at most; it ends before the first row beyond.
BYTES = 1 << 24


def per_class(marked: DataFrame, texts: DataFrame, label: str, key: str, bound: int, salts: int = 64, most: int = BYTES) -> DataFrame:
    """At most ``bound`` rows (key, text, label), and ``most`` bytes of text, of each value of ``label``: those with the smallest hash of ``key``.

    ``marked`` has key and label, ``texts`` key and text, and label too where it depends on the row.
    Taken in two steps, ``salts`` groups in a class and then the class, so that no task sees a
    whole class. Only key and label are ranked; of rows that have both in common the one with
    the smallest text counts, so repeated ids don't enlarge the sample.
    """
    at = marked.select(F.col(key), F.col(label), F.xxhash64(F.lit(7), key).alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(salts)))
    first = Window.partitionBy(label, "salt").orderBy("h", key)
    some = at.withColumn("r", F.row_number().over(first)).where(F.col("r") <= bound)
    last = Window.partitionBy(label).orderBy("h", key)
    few = some.withColumn("r", F.row_number().over(last)).where(F.col("r") <= bound).select(key, label, "h")
    on = [key, label] if label in texts.columns else [key]
    found = texts.join(F.broadcast(few), on).groupBy(key, label, "h").agg(F.min("text").alias("text"))  # ``bound`` rows a class
    sizes = found.withColumn("size", F.sum(F.octet_length("text")).over(last))
    return sizes.where(F.col("size") <= most).select(key, "text", label)
