"""Record ids over classes of sizes: repeated and missing page_ids."""

import re

from tessera.llm import warc


def test_ids_are_unique_over_size_classes(spark, tmp_path):
    big = "x" * 300_000
    rows = [(None, "http://a.b/1", "small"), (None, "http://a.b/2", big), (3, "http://a.b/3", "small"), (3, "http://a.b/3", big + "y"), (3, "http://a.b/3", big + "y"), (4, None, None), (5, "http://a.b/5", big), (6, "http://a.b/6", "y" * (9 << 20)), (6, "http://a.b/6", None)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, again int").repartition(1)
    out = warc.archive(pages, path=str(tmp_path / "w")).collect()
    heads = [f.read_bytes() for f in (tmp_path / "w").rglob("part-*")]
    named = [x for h in heads for x in re.findall(rb"WARC-Record-ID: <([^>]*)>", h)]
    assert len(named) == len(set(named)) == len(rows) == len(out)
    key = lambda p: (p is not None, p or 0)
    assert sorted((r["page_id"] for r in out), key=key) == sorted((r[0] for r in rows), key=key)
    assert sorted(r["payload_bytes"] for r in out) == sorted(len(h or "") for _, _, h in rows)
