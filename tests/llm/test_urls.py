import pytest
from pyspark.sql import functions as F

from billspark.llm.urls import filter_pages, host_of, host_reputation, path_of

URLS = [
    ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/2", "notexample.org", "/es/2", "org/", "allow"),
    ("http://org/", "org", "/", "org/", "allow"),
    ("http://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
    ("http://b.com/de/x", "b.com", "/de/x", "com/de/", "block"),
    ("http://example.org", "example.org", "", None, None),
    ("http://example.org?q=/es/", "example.org", "", None, None),
    ("x://y://z/p", "y:", "//z/p", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "drop", i) for i, (u, *_) in enumerate(URLS)]
    rows += [(100 + i, "http://bad.spam.net/x", "", i) for i in range(60)] + [(200 + i, "http://good.net/x", "", i) for i in range(60)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rate int")


def test_rules_and_parts(spark, pages):
    none = spark.createDataFrame([], "page_id long, good boolean")
    got = {r.page_id: r for r in filter_pages(pages, none).collect()}
    assert len(got) == len(URLS) + 120
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or "allow")


def test_reputation_blocks_only_what_is_surely_bad(spark, pages):
    outcomes = spark.createDataFrame(
        [(100 + i, i < 6) for i in range(60)] + [(200 + i, i < 58) for i in range(60)] + [(9, None), (999, True), (200, True)],
        "page_id long, good boolean",
    )
    got = {r.page_id: r.verdict for r in filter_pages(pages, outcomes).collect()}
    assert got[100] == "block" and got[200] == "allow"
    rates = {r.host: r for r in host_reputation(pages, outcomes).collect()}
    assert 0.1 < rates["bad.spam.net"].rate < 0.5 < rates["good.net"].rate < 58 / 60
    assert rates["notexample.org"].rate == pytest.approx(rates["example.org"].rate, abs=0.2)


def test_native_and_empty(spark, pages):
    none = spark.createDataFrame([], "page_id long, good boolean")
    plan = pages.select(host_of(F.col("url")), path_of(F.col("url")))._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "Python" not in filter_pages(pages, none)._jdf.queryExecution().toString()
    assert filter_pages(pages.limit(0), none).count() == 0
