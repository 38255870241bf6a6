"""Sources, adapters and sinks on small files."""

import gzip
import json

from pyspark.sql import functions as F

from siltstone.sinks import writers as W
from siltstone.sources import adapters as A
from siltstone.sources import documents as D
from siltstone.sources import sitemaps as S

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def test_sitemaps(spark):
    index = lambda *u: f"<sitemapindex {NS}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    urls = lambda *u: f"<urlset {NS}>" + "".join(f"<url><loc> {x} </loc></url>" for x in u) + "</urlset>"
    files = [
        ("r", index("http://h/a.xml", "http://h/b.xml.gz", "http://h/bad.xml").encode()), ("http://h/a.xml", urls("http://h/1", "http://h/1", "ftp://h/x", "http://h/tag/2").encode("utf-8-sig")), ("http://h/b.xml.gz", gzip.compress(index("http://h/c.xml").encode())), ("http://h/c.xml", urls("http://h/3").encode()),
        ("http://h/bad.xml", b"<urlset><url>"), ("empty", None),
    ]
    table = spark.createDataFrame([(a, bytearray(b) if b else None) for a, b in files], "location string, content binary")
    roots = spark.createDataFrame([("r",)], "location string")
    found = S.sitemap_urls(table, roots)
    assert {r.loc for r in found.collect()} == {"http://h/1", "http://h/tag/2", "http://h/3"}
    assert S.sitemap_urls(table, roots, limit=2).count() == 2
    seeds = [(r.url, r.seq) for r in S.seeds(found, "http://h", 10).orderBy("seq").collect()]
    assert seeds[-1] == ("http://h/", 0) and {u for u, _ in seeds[:-1]} == {"http://h/1", "http://h/3"}


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private/*.html$\nDisallow:\nCrawl-delay: 2\n# no\nUser-agent: other\nDisallow: /all\nUser-agent: Bot\nDisallow: /a+b\nSitemap: http://h/s.xml"
    rules = S.robots_rules(spark.createDataFrame([("h", text)], "domain string, text string"))
    r = rules.first()
    assert (r.rules, r.crawl_delay, r.sitemaps) == (["^/private/.*\\.html$", "^/a\\+b"], 2.0, ["http://h/s.xml"])
    pages = spark.createDataFrame([("http://h/private/x.html",), ("http://h/private/x.htm",), ("http://h/a+b/c",), ("http://h/aab",), ("http://h/all",), ("http://other/a+b",)], "url string")
    assert {x.url for x in S.robots_verdict(pages, rules).where("blocked").collect()} == {"http://h/private/x.html", "http://h/a+b/c"}


def test_documents(spark, tmp_path):
    for name, content in {"a.csv": "x,y\n1,a|b\n", "b.txt": " hi ", "c.html": "<h1>T</h1>", "d.json": '{"a":1}', "e.exe": "no", "f.md": "x" * 50}.items():
        (tmp_path / name).write_text(content)
    out = {r.path.rsplit("/", 1)[1]: r for r in D.parse_documents(D.read_files(spark, str(tmp_path)), max_bytes=40).collect()}
    assert {k: v.status for k, v in out.items()} == {"a.csv": "ok", "b.txt": "ok", "c.html": "ok", "d.json": "ok", "e.exe": "unsupported", "f.md": "too_large"}
    assert out["a.csv"].markdown.split("\n")[0].split() == ["|", "x", "|", "y", "|"] and out["b.txt"].markdown == "hi" and out["c.html"].markdown == "# T" and json.loads(out["a.csv"].metadata)["rows"] == 2


def test_dispatch_takes_the_highest_priority(spark):
    urls = ["https://github.com/a/b/issues/1", "https://github.com/a/b", "https://www.youtube.com/watch?v=abcdefghijk", "https://x.com/"]
    got = {r.url: r.adapter for r in A.dispatched(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert list(got.values()) == ["github_social", "github", "youtube", None]
    assert A.adapter_table(spark).count() == len(A.ADAPTERS)
    row = spark.range(1).select(A.video_id(F.lit(urls[2])).alias("v"), A.repository_parts(F.lit(urls[0])).alias("r"), A.indicators(F.lit("at 1.2.3.4 and 1.2.3.4, CVE-2024-12345")).alias("i")).first()
    assert row.v == "abcdefghijk" and (row.r.kind, row.r.owner, row.r.rest) == ("issue", "a", "1") and row.i.ipv4 == ["1.2.3.4"] and row.i.cve == ["CVE-2024-12345"]


def test_records(spark):
    nvd = {"id": "CVE-1", "descriptions": [{"lang": "es", "value": "x"}, {"lang": "en", "value": "hello"}], "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 5.5}}], "cvssMetricV31": [{"cvssData": {"baseScore": 7.5, "baseSeverity": "HIGH"}}]}, "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "n"}]}], "references": [{"url": "u", "tags": ["Exploit"]}]}
    nvd["configurations"] = [{"cpeMatch": [{"criteria": "a", "vulnerable": False, "versionEndExcluding": "2"}], "children": [{"cpeMatch": [{"criteria": "a"}, {"criteria": "b"}]}]}]
    table = spark.createDataFrame([(json.dumps(nvd),), ("{bad",), (None,)], "raw string")
    r = A.cve_records(table).where("cve = 'CVE-1'").first()
    assert (r.description, r.cvss_v3, r.severity, r.cvss_v4, r.cwes, r.exploited) == ("hello", 7.5, "HIGH", None, ["CWE-79"], True)
    assert {(x.criteria, x.vulnerable, x.versions) for x in A.cpe_matches(table).collect()} == {("a", False, "<2"), ("b", True, "any")}
    feed = spark.createDataFrame([("<rss><channel><item><title>t</title><link>l</link><description>d</description></item></channel></rss>",), ("<bad",)], "xml string")
    assert [(x.title, x.link, x.content) for x in A.feed_items(feed).collect()] == [("t", "l", "d")]
    books = spark.createDataFrame([(1, "*** START OF THE PROJECT X ***\nCHAPTER I\nhello\nChapter 2. B\nbye\n*** END OF THE PROJECT X ***"), (2, "plain")], "id int, t string").withColumn("t", A.book_text(F.col("t")))
    assert [(x.id, x.chapter, x.title, x.content) for x in A.chapters(books, "id", "t").orderBy("id", "chapter").collect()] == [(1, 1, "CHAPTER I", "hello"), (1, 2, "Chapter 2. B", "bye"), (2, 1, "", "plain")]
    facets = F.expr("array(named_struct('start',7L,'end',11L,'kind','mention','target','did:1'),named_struct('start',12L,'end',14L,'kind','tag','target','x'))")
    assert spark.range(1).select(A.faceted_text(F.lit("héllo @bob #x"), facets).alias("t")).first().t == "héllo [@bob](at://did:1) #x"
    fm = A.with_front_matter(F.lit("body"), F.create_map(F.lit("a"), F.lit("1")))
    assert spark.range(1).select(fm.alias("t")).first().t == "---\na: 1\n---\n\nbody"
    posts = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id int, parent int")
    assert {(x.root, x.id, x.depth) for x in A.replies(posts).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0)}


def test_sinks(spark, tmp_path):
    sent, waits = [], []
    assert W.deliver(b"x", lambda b: sent.append(b) or 503, waits.append) == (False, 3) and waits == [2.0, 4.0]
    assert W.deliver(b"x", lambda b: 404, waits.append) == (False, 1)
    assert W.signature(b"{}", "k").startswith("sha256=")
    signed = W.signed(spark.createDataFrame([("{}",), (None,)], "body string"), "body", "k").collect()
    assert {r.signature for r in signed} == {W.signature(b"{}", "k"), None}
    answers = spark.createDataFrame([("A query", "text", [("http://h/x", "T", "body")])], "query string, answer string, sources array<struct<url:string,title:string,text:string>>")
    W.write_pyramid(answers, str(tmp_path / "p"))
    assert (tmp_path / "p/L3/slug=a-query/domain=h").is_dir() and "# A query" in next((tmp_path / "p/L1/slug=a-query").glob("*.txt")).read_text()
    assert W.by_domain(spark.createDataFrame([("http://B/x",), ("nohost",), ("http://b/y",)], "url string")).first().sources == 2
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c")], "id int, v string")
    assert {tuple(r) for r in W.index_rows(old, new, "id").collect()} == {(1, "a"), (2, "c")} and W.without(old, new, "id").count() == 1
    points = spark.range(1).select(F.create_map(F.lit("a"), F.array(F.lit(1.0))).alias("vectors"))
    assert W.migrated(points, "b", F.array(F.lit(2.0))).first().vectors == {"a": [1.0], "b": [2.0]}
