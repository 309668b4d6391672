"""References cut before their semicolon, as the pages' titles have them."""

import hashlib
import html

from tessera.plans import registry


def test_text_clean_resolves_cut_references(spark, tmp_path):
    pages = ["<title>and &amp; thedst &amp</title>", "<b>&quot;9c44 &quot</b>", "<i>&copy 1 &middot; &amp;amp</i>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["cleaned_md5"] for r in registry.queries()["text_clean"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5(html.unescape(p).encode()).hexdigest() for i, p in enumerate(pages)}
