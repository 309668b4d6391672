"""The query's verdicts where a rule fits, against the contract's list by brute force."""

from __future__ import annotations

import re

from tessera.llm import urls
from tessera.llm.queries import URL_RULES, op6_url_filters

CONTRACT = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _by_hand(url):
    found = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2] if url else "", re.S)
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]
    fit = [(len(h + p), h + p, word) for word, h, p in CONTRACT if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_url_query_follows_the_contracts_rules(spark, tmp_path):
    hosts = [front + h for h in ("com", "example.com", "net", "example.net", "org", "example.org") for front in ("", "a.", "WWW.b.", "x")]
    cases = [f"http://{h}{p}{tail}" for h in hosts for p in ("/en/", "/en/7", "/de/", "/de/8", "/de", "/es/", "/ES/", "") for tail in ("", "1", "?/de/", "#x")]
    cases += [None, "", "net/de/", "://net/de/8", "a://b.net/de/?u=c://example.net/de/8", "http://net:80/de/", "http://net./de/", "http://\u0130.NET/de/\n8"]
    spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in op6_url_filters(spark, str(tmp_path)).collect()}
    assert len(got) == len(cases)
    words = set()
    for i, url in enumerate(cases):
        host, path, rule, word = _by_hand(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == (word or ("block" if got[i]["score"] >= 0.5 else "allow")), url
        words.add((word, rule))
    assert words == {(word, h + p) for word, h, p in CONTRACT} | {(None, None)}
    # without labels, the rules' own words train the trees
    pages = spark.createDataFrame([(1, "http://a.net/de/1"), (2, "http://a.example.net/de/8")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, URL_RULES).collect()} == {1: "allow", 2: "block"}
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
