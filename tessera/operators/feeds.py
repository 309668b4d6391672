"""Queries over sources and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registry import query, table
from tessera.sources import blocks as B
from tessera.streaming import audit


@query("audit_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def audit_windows(spark: SparkSession, sf: str) -> DataFrame:
    return audit.windowed_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("audit_excerpts", "SELECT conv_id, turn, substring(text, 1, 200) AS answer FROM conversations WHERE role = 'assistant'")
def audit_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", audit.entry(F.col("text"), F.col("text"))[1])


@query("cache_fresh_entries", "WITH m AS (SELECT max(ts) - INTERVAL 2 DAY AS s FROM events) SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events, m WHERE ts >= s) GROUP BY user_id")
def cache_fresh_entries(spark: SparkSession, sf: str) -> DataFrame:
    return audit.last_state(table(spark, sf, "events"), "2 days").groupBy("user_id").agg(F.count("*").alias("n"))


@query("upload_names", r"""SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS safe_name, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) WHEN 'html' THEN 'unknown' ELSE 'unknown' END AS source_type, 'DOC-' || upper(substring(sha256(url), 1, 12)) AS document_id FROM pages""")
def upload_names(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", B.safe_name(url).alias("safe_name"), B.source_type(url).alias("source_type"), B.document_id(url).alias("document_id"))


@query("extraction_route", """
WITH b AS (SELECT doc_id, line_no, CASE WHEN line_no % 2 = 0 THEN 'docling' ELSE 'pymupdf' END AS m FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)),
p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'docling' WHEN doc_id % 3 = 1 THEN 'pymupdf' ELSE 'ocr' END AS want FROM documents)
SELECT b.doc_id AS document_id, count(*) AS blocks FROM b JOIN p ON b.doc_id = p.doc_id WHERE b.m = p.want OR (b.m = 'pymupdf' AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.m = p.want)) GROUP BY b.doc_id""")
def extraction_route(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    lines = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    found = lines.withColumn("extraction_method", F.when(F.col("line_no") % 2 == 0, "docling").otherwise("pymupdf"))
    k = F.col("doc_id") % 3
    profiles = docs.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.when(k == 0, "docling").when(k == 1, "pymupdf").otherwise("ocr").alias("recommended_extractor"))
    return B.route_blocks(found, profiles).groupBy("document_id").agg(F.count("*").alias("blocks"))


@query("url_host_counts", "SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1")
def url_host_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host")).agg(F.count("*").alias("pages"))
