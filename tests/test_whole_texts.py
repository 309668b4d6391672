"""Registered queries on texts whose findings stand far behind the beginning."""

from tessera.operators import reasoning


def test_reports_are_whole(spark, tmp_path):
    text = "word " * 400 + "boot failure after upgrade"
    spark.createDataFrame([(3, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert reasoning.reports(spark, str(tmp_path)).first()["text"] == text
    assert reasoning.violation_detect(spark, str(tmp_path)).count() > 0
