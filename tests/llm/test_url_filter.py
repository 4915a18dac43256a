"""The URL filter against plain Python, with odd urls."""

from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from variegate.llm import url_filter
from variegate.llm.queries import URL_RULES

URLS = ["http://A.example.org/es/x?q=1#f", "https://example.org/en/12", "https://x.org", "x.org/a",
        None, "", "http://www.bad.com/de/1/", "http://bad.com/de/1", "https://bad.net/a?ref=x&b=2",
        "https://bad.net/a/?b=2", "ftp://bad.net/a?b=3", "http://ÄB.com/fr/é", "http:///p", "://h/p",
        "http://notexample.org/es/", "http://a.b://c/d", "http://org/", "http://com/fr"] * 2


def by_hand(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p) for h, p, _ in URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len) if fits else None


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(URLS)],
                                  "page_id long, url string, host int")
    listed = spark.createDataFrame([("bad.net/a?b=2",), ("bad.com/de/1",), (None,),
                                    ("bad.net/a?b=2",)], "canonical string")
    return {r.page_id: r for r in url_filter.judge_urls(pages, listed, URL_RULES).collect()}


def test_host_path_and_rule(judged):
    assert len(judged) == len(URLS)
    for i, url in enumerate(URLS):
        row = judged[i]
        assert (row.host, row.path, row.rule) == by_hand(url), url


def test_listed_and_rules(judged):
    verdicts = {URLS[i]: r.verdict for i, r in judged.items()}
    assert verdicts["https://bad.net/a?ref=x&b=2"] == verdicts["https://bad.net/a/?b=2"] == "block"
    assert verdicts["ftp://bad.net/a?b=3"] == verdicts[None] == verdicts[""] == "allow"
    assert verdicts["http://A.example.org/es/x?q=1#f"] == "block"
    assert verdicts["https://x.org"] == "allow"  # no path, so no rule
    assert verdicts["http://org/"] == "allow"


def test_no_false_positive_and_no_miss(spark):
    """A filter of one block passes many names; the exact join removes them."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"),
                                     F.format_string("http://h%d.net/p", F.col("id") % 500).alias("url"))
    listed = spark.range(0, 500, 7).select(F.format_string("h%d.net/p", "id").alias("canonical"))
    rows = url_filter.judge_urls(pages, listed, []).collect()
    assert len(rows) == 3000
    for row in rows:
        assert (row.verdict == "block") == (row.page_id % 500 % 7 == 0)


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    listed = spark.createDataFrame([], "canonical string")
    assert url_filter.judge_urls(pages, listed, URL_RULES).count() == 0
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge_urls(some, listed, []).collect()] == ["allow"]


def test_hosts_as_a_library_reads_them(spark):
    urls = ["http://Host.com:80/a/b?x#y", "https://u@h.org/", "http://h.org?x=/y"]
    df = spark.createDataFrame([(u,) for u in urls], "url string") \
        .select("url", url_filter.host_of(F.col("url")).alias("host"),
                url_filter.path_of(F.col("url")).alias("path"))
    for row in df.collect():
        parts = urlsplit(row.url)
        assert (row.host, row.path) == (parts.netloc.lower(), parts.path)
