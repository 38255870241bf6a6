"""Search results and response headers."""

from pyspark.sql import functions as F

from siltstone.operators import search as S


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_categories_and_images(spark):
    texts = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, S.search_categories(texts("web", "video"), texts("research", "pdf", "odd"))) == ["general", "videos", "science", "odd"]
    assert one(spark, S.search_categories(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))) == ["general"]
    assert tuple(one(spark, S.image_size(F.lit("800 × 600 px")))) == (800, 600) and one(spark, S.image_size(F.lit("none"))).width is None


def test_health_and_budget(spark):
    engines = spark.createDataFrame([("q", "a", 3), ("q", "b", 0), ("q", "c", 0), ("p", "a", 1)], "k string, engine string, results int")
    results = spark.createDataFrame([("q", "http://x"), ("p", None)], "k string, url string")
    got = {r.k: (r.total, r.responding, r.degraded, r.empty) for r in S.engine_health(engines, results, "k").collect()}
    assert got == {"q": (3, 1, True, False), "p": (1, 1, False, True)}
    assert S.budgeted(spark.range(10).withColumn("k", F.lit(1)), "k", "id", 5).count() == 5


def test_quota(spark):
    rows = [("q", 0, "http://youtube.com/a", True), ("q", 1, "http://a/", True), ("q", 2, "http://b/", False), ("q", 3, "http://c/", True), ("q", 4, "http://youtu.be/d", True), ("p", 0, "http://a/", True), ("p", 1, "http://b/", True), ("p", 2, "http://c/", True)]
    table = spark.createDataFrame(rows, "k string, pos int, url string, ok boolean")
    got = {(r.k, r.pos) for r in S.until_enough(table, "k", "url", "pos", "ok", 3).collect()}
    assert got == {("q", 1), ("q", 2), ("q", 3), ("q", 0), ("p", 0), ("p", 1), ("p", 2)}
    assert {(r.k, r.pos) for r in S.until_enough(table, "k", "url", "pos", "ok", 1).collect()} == {("q", 1), ("p", 0)}


def test_headers(spark):
    rows = [("http://h/a/report", "http://h/a/report", 200, "application/pdf; q=1", "5000", None), ("http://h/", "http://g/", 200, "text/html", "10", None), ("http://h/x.bin", "http://h/x.bin", 403, None, "x", "challenge")]
    table = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, content_length string, mitigated string")
    got = [tuple(r)[1:] for r in S.routing_signals(table).collect()]
    assert got == [(False, False, True, False), (False, True, False, True), (True, False, False, False)]
    names = S.downloads(table.withColumn("content", F.lit("abc").cast("binary"))).collect()
    assert [(r.filename, r.size) for r in names] == [("report.pdf", 3)]


def test_rerank_and_routes(spark):
    table = spark.createDataFrame([(1, "red fox", i, t) for i, t in enumerate(["a red fox", "fox", "none", "red fox"])], "k int, q string, id int, t string")
    assert [(r.id, r.score) for r in S.rerank(table, "k", "q", "t", "id", 3).orderBy("place").collect()] == [(0, 1.0), (3, 1.0), (1, 0.5)]
    routes = S.routed(spark.createDataFrame([(["news"],), (["images", "news"],), (["x"],)], "categories array<string>"))
    assert [r.route for r in routes.collect()] == ["news", "images", "web"]
    page = one(spark, S.enriched_page([F.lit(""), F.lit("t")], [F.lit(None).cast("string")], F.lit("en"), F.lit(None).cast("int")))
    assert tuple(page) == ("t", "", "en", 200)
    rich = S.rich_contents(spark.createDataFrame([("m" * 5, "d"), ("", "d"), (None, "d")], "markdown string, description string"), chars=3)
    assert [r.content for r in rich.collect()] == ["mmm", "d", "d"]
