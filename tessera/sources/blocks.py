"""Sources and sinks: text and CSV files as blocks, extractor routing, named exports, checksums and the audit log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension and the source type it stands for.
SOURCE_TYPES = {"txt": "text", "md": "text", "csv": "csv", "pdf": "pdf", "docx": "docx", "json": "json"}
LARGEST = 25 * 1024 * 1024
BLOCK = "document_id string, page_number int, block_type string, text string, extraction_method string, quality_score double"
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def source_type(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    pairs = [x for k, v in SOURCE_TYPES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def safe_name(filename: Column) -> Column:
    """A file name of letters, digits, dot, dash and underscore."""
    return F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]+", "_")


def document_id(key: Column) -> Column:
    return F.concat(F.lit("DOC-"), F.upper(F.substring(F.sha2(key, 256), 1, 12)))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One text block for each whole file."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return files.select(document_id(F.col("file")).alias("document_id"), F.lit(1).alias("page_number"), F.lit("text").alias("block_type"), F.col("value").alias("text"), F.lit("text").alias("extraction_method"), F.lit(0.95).alias("quality_score"))


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of files that each hold a JSON array, with their source_file; what doesn't parse is a row with only _corrupt_record."""
    kept = f"{schema}, _corrupt_record string"
    rows = spark.read.schema(kept).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """One ``table_row`` block for each row of CSV files with a header: a line ``header: value`` for each column, and the row as a map."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    cells = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns]
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]
    row_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(F.concat_ws("\n", *cells).alias("text"), row_map.alias("row"), F.lit("table_row").alias("block_type"), F.lit(0.9).alias("quality_score"))


def route_blocks(blocks: DataFrame, profiles: DataFrame, fallback: str = "pymupdf") -> DataFrame:
    """Blocks of the extractor that the profile of their page names; where it gave none, those of ``fallback``."""
    keys = ["document_id", "page_number"]
    wanted = profiles.select(*keys, F.col("recommended_extractor").alias("extraction_method"))
    chosen = blocks.join(wanted, [*keys, "extraction_method"], "left_semi")
    empty = wanted.join(chosen, keys, "left_anti").select(*keys)
    rest = blocks.where(F.col("extraction_method") == fallback).join(empty, keys, "left_semi")
    stamp = wanted.withColumnRenamed("extraction_method", "extractor_selected_by_profile")
    return chosen.unionByName(rest).join(stamp, keys, "left")


def extract(files: DataFrame, provider: Provider) -> DataFrame:
    """Blocks by an outside extractor, a function over batches of (document_id, content)."""
    return files.mapInPandas(provider, BLOCK)


def export(df: DataFrame, path: str, kind: str = "json", by: str | None = "document_id") -> None:
    """A named export, a folder for each document."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(by) if by and by in df.columns else writer
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added, removed or modified between two manifests (path, sha256)."""
    a, b = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("modified")
    return a.join(b, "path", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", what.alias("change"))


def with_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``df`` with the columns it lacks, filled with their default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns}) if defaults else df
