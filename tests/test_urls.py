"""URL algebra, filters and links against expected values."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.operators import links as L


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("HTTP://Example.COM:80/A/../b/./c/?z=1&a=2#top", "http://example.com/b/c?a=2&z=1"), ("https://example.com:443", "https://example.com/"), ("https://example.com:8443/", "https://example.com:8443/"), ("http://user:pw@h.com/x//y/", "http://h.com/x/y"),
        ("http://h.com/Path/CASE", "http://h.com/Path/CASE"), ("http://h.com//a//b", "http://h.com//a/b"), ("http://a_b.com/../..", "http://a_b.com/"), ("http://h.com/a;p=1?b", "http://h.com/a;p=1?b"),
    ],
)
def test_crawl_form(spark, raw, expected):
    assert value(spark, U.normalize_crawl(F.lit(raw))) == expected
    assert value(spark, U.normalize_crawl(F.lit(expected))) == expected


@pytest.mark.parametrize(("raw", "expected"), [("HTTP://Ex.com/A/B/?Z=1&a=2#Frag", "http://ex.com/a/b?a=2&z=1#Frag"), ("http://ex.com/", "http://ex.com/"), ("http://ex.com", "http://ex.com")])
def test_cache_form(spark, raw, expected):
    assert value(spark, U.normalize_cache(F.lit(raw))) == expected


def test_domains(spark):
    assert value(spark, U.domain(F.lit("https://U@Docs.Ex.com:8080/x"), True)) == "https://docs.ex.com:8080"
    assert value(spark, U.domain(F.lit("http://[::1]:5/x"), True)) == "http://[::1]:5"
    assert value(spark, U.domain(F.lit("/relative"))) == ""
    assert value(spark, U.same_origin(F.lit("http://A.com/x"), F.lit("HTTP://a.com/y")))
    assert not value(spark, U.same_origin(F.lit("http://a.com:1/"), F.lit("http://a.com/")))


@pytest.mark.parametrize(("url", "private"), [("http://10.1.2.3/", True), ("http://8.8.8.8/", False), ("http://100.100.100.200/", True), ("http://x.docker.internal/", True), ("/x", True), ("http://[::1]/", True), ("http://[fd00::1]/", True), ("http://[2001:db8::1]/", False), ("http://ex.com/", None), ("http://010.1.1.1/", None)])
def test_private_hosts(spark, url, private):
    assert value(spark, U.is_private(F.lit(url))) is private


@pytest.mark.parametrize(("url", "include", "exclude", "ok"), [("http://a/x/y", ["/x/*"], None, True), ("http://a/x/y/z", ["/x/*"], None, False), ("http://a/x/y/z", ["/x/**"], None, True), ("http://a/x/y", ["/x/*"], ["/x/?"], False), ("http://a/x.y", ["/x.y"], None, True), ("http://a/xzy", ["/x.y"], None, False), ("http://a/q", None, None, True)])
def test_path_filter(spark, url, include, exclude, ok):
    assert value(spark, U.path_allowed(F.lit(url), include, exclude)) is ok


def test_bad_pattern_matches_nothing(spark):
    assert value(spark, U.path_allowed(F.lit("http://a/x"), None, ["("], True)) is True
    assert value(spark, U.path_allowed(F.lit("http://a/x"), ["("], None, True)) is False


def test_scores_keep_part_matches(spark):
    assert value(spark, U.extractability(F.lit("https://netflix.com/a/b"))) == 0  # holds "x.com": -1, deep path: +1
    assert value(spark, U.extractability(F.lit("https://mit.edu/login"))) == -9999
    assert value(spark, U.extractability(F.lit("https://en.wikipedia.org/wiki/x?utm_a=1"))) == -5000
    assert value(spark, U.extractability(F.lit("https://en.wikipedia.org/wiki/x"))) == 4
    assert value(spark, U.category(F.lit("http://www.docs.x.com/"))) == "docs"
    assert value(spark, U.category(F.lit("http://bbc.co.uk/"))) == "news"


def test_links():
    html = '<base href="http://b.com/d/"><a href="x">1</a><a href="x#f">2</a><a href="//c.com/">3</a><a href="mailto:a@b">4</a><a href="#top">5</a><a>6</a>'
    assert L.extract_links(html, "http://a.com/") == ["http://b.com/d/x", "http://c.com/"]
    assert L.extract_links(None, "http://a.com/") == []
    assert L.extract_links("<a href='http://[bad'>", "http://a.com/") == []


def test_link_scope(spark):
    base = F.lit("Ex.com")
    kinds = [value(spark, U.link_class(F.lit(u), base)) for u in ("http://ex.com/", "http://a.ex.com/", "http://notex.com/")]
    assert kinds == ["internal", "subdomain", "external"]
    assert not value(spark, U.in_scope(F.lit("http://a.ex.com/"), base))
    assert value(spark, U.in_scope(F.lit("http://a.ex.com/"), base, allow_subdomains=True))
    assert value(spark, U.below(F.lit("http://a/x/y"), F.lit("http://a/x/")))
    assert not value(spark, U.below(F.lit("http://a/xy"), F.lit("http://a/x")))
