"""Quality, barriers, clean-up and metadata against expected values."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as T
from siltstone.operators import extraction as X
from siltstone.operators import research as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


PARAGRAPH = "This is a paragraph of an article that is long enough to count as a solid line of text here."


@pytest.mark.parametrize(
    ("md", "title", "score"),
    [("", "", 0.0), ("\n\n".join([PARAGRAPH] * 12), "A good long title", 1.0), ("[a](b)\n" * 10, "", 0.17 + 0.32), (PARAGRAPH * 4 + "\n\n" + "subscribe to continue", "", 0.48)],
)
def test_quality(spark, md, title, score):
    if md.startswith("[a]"):
        assert value(spark, T.boilerplate(F.lit(md))).status == "fail"
        return
    q = value(spark, T.quality(F.lit(md), F.lit(title)))
    assert q.score == pytest.approx(score)


@pytest.mark.parametrize(
    ("title", "url", "content", "html", "kind", "confidence"),
    [
        ("Just a moment...", "http://x/", "c" * 200, "", "cloudflare", 0.7), ("Just a moment...", "http://x/?cf_chl=1", "c" * 200, "", "cloudflare", 0.9), ("Just a moment...", "http://x/?cf_chl=1", "rate limit", "", "cloudflare", 0.95), ("", "http://x/", "", "", "empty", 0.95),
        ("", "http://x/", "c" * 200, "<div class='g-recaptcha'>", "captcha", 0.95), ("", "http://x/", "c" * 200, "<iframe data-sitekey=1 challenge>", "captcha", 0.85), ("", "http://x/", "c" * 200, "<p>", None, 0.0), ("t", "http://x/", "too many requests " + "c" * 200, "", "rate-limit", 0.7),
        ("t", "http://x/", "see DDoS-Guard " + "c" * 200, "", "suspicious", 0.7),
    ],
)
def test_barrier(spark, title, url, content, html, kind, confidence):
    b = value(spark, T.barrier(*map(F.lit, (title, url, content, html))))
    assert (b.barrier_type, b.confidence) == (kind, confidence)
    assert b.detected is (kind is not None)


def test_redaction_order(spark):
    said = "api_key=sk-foobar123 password: hunter2 x?token=abc&y=1 Bearer abcdef123 pk-abcdef1"
    assert value(spark, T.redact(F.lit(said))) == "api_key=[REDACTED] password: [REDACTED] x?token=[REDACTED]&y=1 Bearer [REDACTED] pk-[REDACTED]"


def test_small_rules(spark):
    assert value(spark, T.slugify(F.lit("  Hello, World -- again!  "))) == "hello-world-again"
    assert value(spark, T.looks_like_markdown(F.lit("# a\n- b\n```\n")))
    assert not value(spark, T.looks_like_markdown(F.lit("a\nb")))
    assert value(spark, T.has_embedded_document(F.lit("<iframe src='x.pdf'>")))
    assert value(spark, T.error_type(F.lit("connection timed out"))) == "connection_error"
    assert value(spark, T.error_type(F.lit("x"), F.lit("TIMEOUT"))) == "timeout"


HEAD = """<html lang="en-GB"><head><title>T</title><meta property="og:image" content="a"><meta property="og:image" content="b"><meta name="twitter:card" content="x"><meta name="twitter:card" content="y">
<meta content="D" name="description"><link href="http://c/" rel="canonical"><script type="application/ld+json">{"@type": "A"}</script><script type="application/ld+json">{bad</script></head><body><nav>n</nav><p>Hi &amp; you</p></body></html>"""


def test_metadata(spark):
    page = F.lit(HEAD)
    assert value(spark, H.open_graph(page)) == {"image": ["a", "b"]}
    assert value(spark, H.twitter_card(page)) == {"card": "y"}
    m = value(spark, H.standard_meta(page))
    assert (m.canonical, m.language, m.description, m.author) == ("http://c/", "en", "D", None)
    assert value(spark, F.size(H.json_ld(page))) == 1
    assert value(spark, H.structural_text(page)) == "# T\n\nD\n\nT\nHi & you"


def test_markdown_and_media():
    html = "<body><nav><a href='/n'>n</a></nav><h2>Hi <b>you</b></h2><ol><li>a<li>b</ol><pre><code>x = 1</code></pre><p><code>y</code><img src='/i.png' width='10' height='z'><img src='data:x'></p></body>"
    assert X.to_markdown(html, exclude=["navigation"]).startswith("## Hi **you**\n\n1. a\n2. b")
    assert X.to_markdown(html, include=["navigation"]) == "[n](/n)"
    assert X.to_markdown("<p>" + "a " * 400, verbosity="compact").endswith("\n...")
    images, code = X.page_media(html, "http://h/")
    assert images == [{"url": "http://h/i.png", "alt": "", "width": 10, "height": None, "position": 1}] and code == ["x = 1", "y"]


def test_citations(spark):
    text = "a [1] b [2](u) [9] [1]"
    every = value(spark, R.cite(F.lit(text), F.array(F.lit("http://x$"), F.lit("http://y")), "compact"))
    assert every.text == "a [1](http://x$) b [2](u) [9] [1](http://x$)" and [c["index"] for c in every.citations] == [1]
    first, found = R.resolve_citations(text, [{"url": "http://x"}, {"url": "http://y"}], compact=True)
    assert first == "a [1](http://x) b [2](u) [9] [1]" and len(found) == 1


def test_plans(spark):
    phase = "struct<action:string,title:string,description:string,estimated_sources:int,queries:array<string>>"
    changes = "narrow string, modify_queries array<struct<phase_index:int,new_query:string>>, add_dimension array<string>, remove_dimension array<string>"
    rows = [
        (1, "q", [("scrape", None, None, -1, None)], 0, None, "n", [(1, "new"), (7, "none")], ["a", "b", "a"], ["b"]),
        (2, "q", [], None, None, None, None, None, None),
        (3, "q", [("dance", None, None, 1, None)], None, None, None, None, None, None),
        (4, "q", [(None, "t", "d", 2, ["x"]), ("synthesize", None, "end", 0, None)], None, ["z"], "", None, None, None),
    ]
    plans = spark.createDataFrame(rows, f"id int, prompt string, phases array<{phase}>, estimated_sources int, comparison_dimensions array<string>, {changes}")
    whole = R.completed_plans(plans)
    got = {r.id: r for r in whole.collect()}
    assert [p.action for p in got[1].phases] == ["search", "scrape", "synthesize"] and got[1].estimated_sources == 5 and got[1].phases[1].title == "Phase 1" and got[1].phases[0].queries == ["q"]
    assert (got[2].problem, got[3].problem, got[1].problem, got[2].phases) == ("no phases", "unknown action", None, None)
    assert [p.title for p in got[4].phases] == ["t", "end"] and got[4].estimated_sources == 10
    changed = {r.id: r for r in R.changed_plans(whole).collect()}
    assert changed[1].phases[0].description == "[FOCUS: n] Search for: q" and changed[1].phases[1].description == "new" and changed[1].comparison_dimensions == ["a"]
    assert changed[4].phases == got[4].phases and changed[4].comparison_dimensions == ["z"] and changed[2].phases is None
    assert R.valid_params({"max_depth": "3", "max_pages": 0, "include_paths": ["a", 1]}) == {"max_depth": 3}
    assert R.merged_params({"max_depth": 1}, {"max_depth": 2, "max_pages": None}) == {"max_depth": 2}
    assert R.salvaged_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and R.salvaged_json("{bad") is None
    assert R.valid_gaps(list("abcdef")) == []


def test_lines_of_a_long_text_are_counted_in_blocks(spark, monkeypatch):
    link, solid, short = "[a](/a)", "x" * 70, "y"
    texts = [None, "", "\n", " \n\t\n", solid, "\n".join([link, solid, "", short, "\u4e16" * 3] * 40), "\n\n" + solid + "\n" * 90 + short, ("z" * 500 + "\n") * 3 + link, (link + "\r\n") * 30 + "\n", "a" * 64, "a" * 63 + "\n", "a" * 63 + "\n" + link]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(1)
    whole = {r.i: (r.b, r.c) for r in table.select("i", T.boilerplate(F.col("text")).alias("b"), T.completeness(F.col("text")).alias("c")).collect()}
    for block in (1, 7, 64):
        monkeypatch.setattr(T, "BLOCK", block)
        got = {r.i: r.v for r in table.where("text is not null").select("i", T._line_counts(F.col("text")).alias("v")).collect()}
        for i, text in enumerate(texts[1:], 1):
            lines = [x for x in (y.strip(" \t\n\x0b\f\r") for y in text.split("\n")) if x]
            want = (len(lines), lines.count(link), sum(len(x) > 60 for x in lines))
            assert (got[i].n, got[i].links, got[i].solid) == want, (block, i)
        again = {r.i: (r.b, r.c) for r in table.select("i", T.boilerplate(F.col("text")).alias("b"), T.completeness(F.col("text")).alias("c")).collect()}
        assert again == whole
