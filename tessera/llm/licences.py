"""Licence scans: canonical digests of entire texts, looked up by a hash join. DataFrame functions only.

The canonical form lower-cases, drops copyright lines, turns punctuation and white space
into single spaces and writes equivalent spellings in one way. Its SHA-256 is the digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.licence_texts import LICENCES

#: What becomes a space: all of ASCII but letters and digits, no-break spaces, and typographic dashes, quotes and bullets.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{2010}-\x{2027}]+"
#: A line is a copyright line if a copyright mark is its first word.
COPYRIGHT = r"(^|\n)[^a-z0-9\n©(]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Spellings and their equivalent, replaced in this order, also inside words.
SPELLINGS = [
    ("licence", "license"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"), ("centre", "center"),
    ("fulfil ", "fulfill "), ("initialise", "initialize"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("per cent", "percent"), ("whilst", "while"), ("copyright owner", "copyright holder"),
]


def canonical(text: Column) -> Column:
    low = F.lower(text)
    # the marks are looked for first, as few texts have one and the pattern is the costly part
    marked = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©")) | F.contains(low, F.lit("all rights reserved"))
    kept = F.when(marked, F.regexp_replace(low, COPYRIGHT, "\n")).otherwise(low)
    plain = F.trim(F.regexp_replace(kept, PUNCTUATION, " "))
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), SPELLINGS, plain)


def digest(text: Column) -> Column:
    """Hex SHA-256 of the canonical form; null where that is empty or the text null."""
    form = canonical(text)
    return F.when(F.length(form) > 0, F.sha2(form, 256))


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENCES, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id) for each row of ``docs`` (doc_id, text); license_id is null where no text of ``known`` (license_id, text) is equal in canonical form.

    * Null text, or nothing left of it: digest and license_id null. Null doc_ids are kept.
    * Known texts with one canonical form: the smallest license_id. Known rows that are null or empty match nothing.
    * Repeated rows are looked up each; texts of any length are read whole; empty in, empty out; other columns are not read.
    """
    names = known.select(digest(F.col("text")).alias("digest"), "license_id").where("digest is not null and license_id is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return docs.select("doc_id", digest(F.col("text")).alias("digest")).join(names, "digest", "left").select("doc_id", "digest", "license_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_form(text: str) -> str:
    low = f"lower({text})"
    kept = f"regexp_replace({low}, {_quoted(COPYRIGHT)}, chr(10), 'g')"
    plain = f"trim(regexp_replace({kept}, {_quoted(PUNCTUATION)}, ' ', 'g'))"
    return reduce(lambda t, s: f"replace({t}, {_quoted(s[0])}, {_quoted(s[1])})", SPELLINGS, plain)


def scan_sql() -> str:
    """``scan`` of the documents with the built-in licences, for DuckDB."""
    rows = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in LICENCES)
    return f"""
WITH known AS (SELECT license_id, {_sql_form("text")} AS form FROM (VALUES {rows}) AS v(license_id, text)),
names AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM known WHERE length(form) > 0 GROUP BY 1),
forms AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents),
digests AS (SELECT doc_id, CASE WHEN length(form) > 0 THEN sha256(form) END AS digest FROM forms)
SELECT d.doc_id, d.digest, n.license_id FROM digests d LEFT JOIN names n ON d.digest = n.digest"""
