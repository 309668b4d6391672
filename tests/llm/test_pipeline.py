"""The pipeline on a small corpus: what each stage must drop, cut or keep."""

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "123 456", "en", "s", 7), (10**6 + 1, None, "en", "s", None)], docs.schema)
    docs.union(junk).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{src}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.table(stage(spark, now, str(tmp_path)), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    ids = {n: {r[0] for r in df.select("doc_id").collect()} for n, df in seen.items()}
    assert not ids["language_id"] & {10**6, 10**6 + 1} and len(ids["language_id"]) >= 0.98 * docs.count()
    assert ids["near_dedup"] < ids["language_id"] and ids["decontamination"] <= ids["substring_dedup"] <= ids["near_dedup"]
    assert ids["packing"] == ids["decontamination"]
    assert seen["substring_dedup"].where(F.length("text") != F.col("n_chars")).count() == 0
    packed = seen["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert packed.where("n > 2048 OR n <> end").count() == 0
