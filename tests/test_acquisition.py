"""Tiers and adapters: early stop, order, fall-through, records."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import acquisition as A
from siltstone.sources import adapters, dispatch as D, records as R

GOOD = "\n\n".join(f"Paragraph {i} has enough plain words to pass for a text that people would like to read on a page." for i in range(12))
POOR = "[a](/a)\n[b](/b)\n[c](/c)"


def urls(spark, names, **more):
    return spark.createDataFrame([(x, *more.values()) for x in names], "url string" + "".join(f", `{c}` string" for c in more))


def results(spark, rows):
    return spark.createDataFrame(rows, "url string, markdown string, title string, error string")


class Spy:
    """A source that notes what it was asked for."""

    def __init__(self, fetch):
        self.fetch, self.asked = fetch, []

    def __call__(self, pending):
        self.asked.append(sorted(r.url for r in pending.collect()))
        return self.fetch(pending)


def test_a_later_tier_never_sees_an_accepted_row(spark):
    first = Spy(A.from_table(results(spark, [("a", GOOD, None, None), ("b", POOR, None, None), ("c", None, None, "timeout"), ("z", GOOD, None, None)]), "url"))
    second = Spy(A.from_table(results(spark, [("a", "wrong", None, None), ("b", GOOD, "A fine title", None), ("d", " ", None, None), ("e", POOR, None, None)]), "url"))
    third = Spy(A.from_table(results(spark, [("c", GOOD, None, None), ("e", POOR + "\n[d](/d)", None, None)]), "url"))
    never = Spy(A.from_table(results(spark, []), "url"))
    out, tries = A.acquire(urls(spark, ["a", "b", "c", "d", "e", None, "a"], tier="x", place="y"), [A.Tier(n, s) for n, s in zip("123", (first, second, third), strict=True)], threshold=0.8)
    got = {r.url: r for r in out.collect()}
    assert [first.asked, second.asked, third.asked] == [[["a", "b", "c", "d", "e"]], [["b", "c", "d", "e"]], [["c", "d", "e"]]]
    assert {u: r.tier for u, r in got.items()} == {"a": "1", "b": "2", "c": "3", "d": "none", "e": "2", None: "none"}
    assert got["a"].markdown == GOOD and got["a"].warning is None and got["b"].title == "A fine title"
    assert got["e"].markdown == POOR and got["e"].warning.startswith("Suboptimal content: quality (0.") and got["d"].score is None
    log = {(r.url, r.place): r.reason for r in tries.collect()}
    assert log[("c", 0)] == "error: timeout" and log[("d", 1)] == "empty" and ("a", 1) not in log and ("z", 0) not in log and len(log) == 8
    out, tries = A.acquire(urls(spark, ["a"]), [A.Tier("1", first), A.Tier("2", never)], threshold=0.8)
    assert out.first().tier == "1" and tries.count() == 1 and never.asked == []


def test_acquire_without_rows_or_tiers(spark):
    tier = A.Tier("t", A.from_table(results(spark, []), "url"))
    assert A.acquire(urls(spark, []), [tier])[0].count() == 0
    out, tries = A.acquire(urls(spark, ["a"]), [])
    assert out.first().tier == "none" and tries.count() == 0
    out, tries = A.acquire(urls(spark, ["a"]), [tier])
    assert out.first().tier == "none" and tries.count() == 0


def test_sources_of_tiers(spark):
    pending = urls(spark, ["http://h.com/1", "http://h.com/2", "http://k.com/3", "http://k.com/4", "http://k.com/5", "http://k.com/6"])
    texts = spark.createDataFrame([("h.com", 200, "# Site\ntext"), ("k.com", 404, "# No"), ("x.com", 200, "plain")], "host string, status int, body string")
    got = A.site_texts(texts, "url")(pending).collect()
    assert sorted((r.url, r.markdown, r.final_url) for r in got) == [(f"http://h.com/{i}", "# Site\ntext", "https://h.com/llms.txt") for i in (1, 2)]
    page = f"<html><body><article><p>{GOOD}</p></article></body></html>"
    answers = [("http://h.com/1", 200, "application/pdf", "%PDF"), ("http://h.com/2", 200, "text/plain", "# a\n- b\n- c\n"), ("http://k.com/3", 200, "text/html", page), ("http://k.com/4", 200, "text/html", "<p>short</p>"), ("http://k.com/5", 500, "text/html", page), ("http://k.com/6", 200, "text/plain", GOOD)]
    table = spark.createDataFrame(answers, "url string, status int, content_type string, body string")
    assert {r.url: r.kind for r in A.negotiated(table, "url")(pending).collect()} == {"http://h.com/1": "download", "http://h.com/2": "markdown", "http://k.com/3": "html"}
    out, _ = A.acquire(pending, [A.Tier("negotiation", A.negotiated(table, "url"))])
    assert {r.kind for r in out.where("url = 'http://h.com/1'").collect()} == {"download"}


# adapters


@pytest.mark.parametrize(
    ("url", "names"),
    [
        ("https://github.com/a/b/issues/1", ["github_social", "github"]), ("cve:CVE-2024-1234", ["nvd", "cveorg"]), ("https://x.substack.com/p/hello", ["substack"]), ("https://blog.example.com/p/hello", ["substack"]), ("https://shop.example.com/products/p/q", ["shopify"]),
        ("https://otx.alienvault.com/indicator/ip/1.2.3.4", ["otx"]), ("https://www.abuseipdb.com/check/1.2.3.4", ["abuseipdb"]), ("https://search.censys.io/ipv4/1.2.3.4", ["censys"]), ("https://haveibeenpwned.com/account/a@b", ["hibp"]), ("https://vulncheck.com/cve/CVE-2024-1", ["vulncheck"]), ("https://jobs.vaco.com/job/12", ["vaco"]), ("https://example.com/", []),
    ],
)
def test_patterns(spark, url, names):
    assert spark.range(1).select(adapters.matching(F.lit(url)).alias("m")).first().m == names
    assert len(adapters.ADAPTERS) == 22 and len({n for n, *_ in adapters.ADAPTERS}) == 22


def test_failures_fall_through_and_successes_do_not(spark):
    rows = urls(spark, ["https://github.com/a/b/issues/1", "https://github.com/a/b/issues/2", "https://github.com/a/b/issues/3", "cve:CVE-2024-1234", "https://example.com/", "https://github.com/a/b", None], adapter="x", turn="y")
    social = Spy(lambda p: p.select("url", F.lit("text").alias("markdown"), F.when(F.col("url").endswith("1"), F.lit(None)).otherwise(F.lit("rate limited")).alias("error")))
    repo = Spy(lambda p: p.where("url not like '%3'").select("url", F.lit("# repo").alias("markdown"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata")))
    out, tries = D.dispatch(rows, {"github_social": social, "github": repo})
    got = {r.url: r for r in out.collect()}
    assert {u: r.adapter for u, r in got.items()} == {"https://github.com/a/b/issues/1": "github_social", "https://github.com/a/b/issues/2": "github", "https://github.com/a/b/issues/3": None, "cve:CVE-2024-1234": None, "https://example.com/": None, "https://github.com/a/b": "github", None: None}
    assert got["https://github.com/a/b/issues/2"].metadata == {"k": "v"} and got["https://github.com/a/b/issues/3"].error == "no result" and got["cve:CVE-2024-1234"].error == "no source"
    assert social.asked == [[f"https://github.com/a/b/issues/{i}" for i in (1, 2, 3)]]
    assert repo.asked == [["https://github.com/a/b"], ["https://github.com/a/b/issues/2", "https://github.com/a/b/issues/3"]]
    log = {(r.url[-1], r.turn): r.error for r in tries.collect() if "github" in r.url}
    assert log == {("1", 0): None, ("2", 0): "rate limited", ("3", 0): "rate limited", ("2", 1): None, ("3", 1): "no result", ("b", 0): None}
    assert D.dispatch(rows.limit(0), {})[0].count() == 0 and D.dispatch(rows.where("url = 'https://example.com/'"), {})[1].count() == 0


def test_records_as_reports(spark):
    issue = {"title": "It breaks | often", "state": "open", "user": {"login": "someone"}, "comments": 3, "labels": [{"name": "bug"}, {"name": "a|b"}], "body": "Steps:\n1. run"}
    host = {"ip_str": "1.2.3.4", "org": "Org", "ports": [22, 443], "hostnames": [f"h{i}" for i in range(9)]}
    breaches = {"email": "a@b", "count": 1, "breaches": [{"Name": "N", "BreachDate": "2020-01-01", "DataClasses": ["Emails", "Names"]}]}
    table = spark.createDataFrame([("1", json.dumps(issue)), ("2", "{bad"), ("3", None), ("4", "{}")], "url string, raw string")
    got = {r.url: r for r in R.source(table, "url", "github_issue")(table).collect()}
    assert got["1"].markdown == "## Issue: It breaks | often\n\n| Field | Value |\n|---|---|\n| State | open |\n| Author | someone |\n| Comments | 3 |\n\n### Labels\n\n| Name |\n|---|\n| bug |\n| a\\|b |\n\n### Text\n\nSteps:\n1. run"
    assert got["1"].metadata == {"source": "github_issue", "state": "open", "author": "someone", "comments": "3"}
    assert got["2"].error == got["3"].error == "not JSON" and got["4"].markdown == "## Issue: unknown\n\n| Field | Value |\n|---|---|" and got["4"].error is None
    one = lambda record, kind: spark.range(1).select(R.rendered(F.lit(json.dumps(record)), kind)["markdown"].alias("m")).first().m
    assert "### Open Ports\n\n- 22\n- 443\n\n### Hostnames\n\n- h0\n- h1\n- h2\n- h3\n- h4" in one(host, "shodan") and "h5" not in one(host, "shodan")
    assert "| N | 2020-01-01 | Emails, Names |" in one(breaches, "hibp")
    for kind in R.REPORTS:
        assert one({}, kind).startswith("## ")


def test_a_text_of_many_pages_is_judged_once_and_kept_as_its_digest(spark, monkeypatch):
    seen, judged = [], A.judged
    monkeypatch.setattr(A, "judged", lambda found, threshold: seen.append(found.count()) or judged(found, threshold))
    pending = spark.range(40).selectExpr("id AS page_id", "concat('https://', if(id % 4 = 0, 'b', 'a'), '.example.com/', id) AS url")
    texts = spark.createDataFrame([("a.example.com", 200, "# A\n" + GOOD), ("b.example.com", 200, POOR + "\n[d](/d)"), ("c.example.com", 200, "# C")], "host string, status int, body string")
    out, tries = A.acquire(pending, [A.Tier("site", A.site_texts(texts, "page_id"))], "page_id", 0.8, F.md5)
    assert seen == [3] and tries.count() == 40 and tries.where("accepted").count() == 30
    assert {(r.page_id % 4 == 0, r.markdown) for r in out.collect()} == {(r.host[0] == "b", r.m) for r in texts.where("host < 'c'").select("host", F.md5("body").alias("m")).collect()}


def test_tier_chain_on_a_page_whose_heading_is_cut_in_a_reference(spark, tmp_path):
    import duckdb

    from siltstone.plans import catalog

    html = f"<html><head><title>T</title></head><body><article><h1>Rivers and&amp</h1>{''.join(f'<p>{p}</p>' for p in GOOD.split(chr(10) * 2))}</article></body></html>"
    spark.createDataFrame([(i, "https://a.example.com/%d" % i, html) for i in range(3)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(0, POOR), (1, GOOD)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    for t in ("pages", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(f"SELECT page_id, tier, text_md5 FROM ({catalog.oracle_sql()['tier_chain']}) ORDER BY page_id").fetchall()
    assert [r[1] for r in want] == ["negotiation", "cache", "negotiation"]
    assert want == [tuple(r) for r in catalog.queries()["tier_chain"](spark, str(tmp_path)).select("page_id", "tier", "text_md5").orderBy("page_id").collect()]
