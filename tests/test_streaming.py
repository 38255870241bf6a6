"""Streams against their batch counterparts, over files in several batches; and state machines against plain loops."""

from pyspark.sql import functions as F

from siltstone.operators import metrics as M
from siltstone.operators import sessions as X
from siltstone.streaming import queries as Q
from tests.conftest import SF


def split_files(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    ordered = events.withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = [r.q for r in ordered.selectExpr("explode(percentile_approx(unix_micros(ts), array(0.33, 0.66))) AS q").collect()]
    edges = [-1, *bounds, 1 << 62]
    for a, b in zip(edges, edges[1:], strict=False):
        ordered.where((F.unix_micros("ts") > a) & (F.unix_micros("ts") <= b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, ordered.schema, str(tmp_path / "in")


def test_streams_equal_batches(spark, tmp_path):
    events, schema, path = split_files(spark, tmp_path)
    stream = lambda: Q.event_stream(spark, path, schema, late="60 days")
    Q.run_available(Q.window_counts(stream(), "1 day", ["event_type"]), str(tmp_path / "c1"), name="win", mode="complete")
    want = {(r.window, r.event_type, r.increase) for r in M.rate(events, ["event_type"], "ts", 86_400).collect()}
    assert {(int(r.s), r.event_type, r.n) for r in spark.sql("SELECT unix_timestamp(start) AS s, event_type, n FROM win").collect()} == want
    changes = []
    monitor = Q.page_monitor(stream(), "user_id", "event_type")
    Q.run_available(monitor, str(tmp_path / "c2"), sink=lambda df, _: changes.extend(map(tuple, df.select("event_id", "changed").collect())))
    batch = X.page_changes(events, "user_id", ["ts", "event_id"], "event_type").select("event_id", "changed")
    assert sorted(changes) == sorted(map(tuple, batch.collect()))
    states = []
    calls = stream().withColumn("ok", F.col("event_type") != "error")
    Q.run_available(Q.breaker(calls, "user_id", "ok", failures=2, cooldown=86_400.0), str(tmp_path / "c3"), sink=lambda df, _: states.extend(map(tuple, df.select("event_id", "state").collect())))
    batch = M.breaker_states(events, "user_id", "ts", "event_id", F.col("event_type") != "error", failures=2, cooldown=86_400.0)
    assert sorted(states) == sorted(map(tuple, batch.select("event_id", "state").collect()))
    Q.run_available(Q.first_seen(stream(), ["user_id", "event_type"]).select("user_id", "event_type"), str(tmp_path / "c4"), name="seen")
    assert spark.table("seen").count() == events.select("user_id", "event_type").distinct().count()
    told = []
    Q.run_available(stream(), str(tmp_path / "c5"), sink=Q.crawl_progress(100, told.append))
    assert [x["completed"] for x in told if x["type"] == "progress"] == list(range(100, events.count() + 1, 100))


def test_sliding_limit_against_a_loop(spark):
    rows = [(i, "k", t) for i, t in enumerate([0, 1, 2, 3, 10, 11, 12, 13])]
    table = spark.createDataFrame(rows, "id long, key string, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = [r.allowed for r in M.sliding_window_limit(table, "key", "ts", "id", 2, 10.0).orderBy("id").collect()]
    assert got == [True, True, False, False, True, True, False, False]


def test_breaker_opens_and_probes(spark):
    oks = [False] * 5 + [True, True, False, True]
    times = [0, 1, 2, 3, 4, 5, 40, 41, 42]
    table = spark.createDataFrame([(i, "k", t, ok) for i, (t, ok) in enumerate(zip(times, oks, strict=True))], "id long, key string, t long, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = [(r.state, r.passed) for r in M.breaker_states(table, "key", "ts", "id", F.col("ok")).orderBy("id").collect()]
    assert got == [("closed", True)] * 5 + [("open", False), ("half_open", True), ("closed", True), ("closed", True)]


def test_crawl_stops_at_max_pages_in_order(spark):
    pages = spark.createDataFrame([(u,) for u in "abcdefg"], "url string")
    edges = spark.createDataFrame([("a", "c", 0), ("a", "b", 1), ("b", "e", 0), ("c", "d", 0), ("c", "x", 1), ("d", "a", 0), ("e", "f", 0)], "src string, dst string, pos int")
    start = spark.createDataFrame([("a", 1)], "url string, seq long")
    out = [(r.url, r.depth) for r in X.crawl_levels(pages, edges, start, 10, 4).orderBy("seq").collect()]
    assert out == [("a", 0), ("c", 1), ("b", 1), ("d", 2)]
    assert X.crawl_levels(pages, edges, start, 1, 100).count() == 3


def test_exposition_and_quantile(spark):
    rows = spark.createDataFrame([("x", v) for v in (0.5, 1.0, 1.5, 9.0)], "name string, v double")
    assert {(r.le, r["count"]) for r in M.histogram(rows, ["name"], "v", (1.0, 2.0)).collect()} == {("1.0", 2), ("2.0", 3), ("+Inf", 4)}
    assert M.quantile(rows, ["name"], "v", 0.5, (1.0, 2.0)).first()["quantile"] == 1.0
    assert M.quantile(rows, ["name"], "v", 0.99, (1.0, 2.0)).first()["quantile"] == 2.0


def test_the_state_of_a_silent_key_goes(spark, tmp_path):
    path, out = str(tmp_path / "in"), []
    for n, rows in enumerate([[(1, "a", 0, "x")], [(2, "b", 100, "x"), (3, "b", 101, "y")], [(4, "b", 102, "y")], [(5, "a", 103, "z")]]):
        table = spark.createDataFrame(rows, "event_id long, key string, day long, body string").withColumn("ts", F.timestamp_seconds(F.col("day") * 86_400 + 1_000_000))
        table.coalesce(1).write.mode("append").parquet(path)
        stream = Q.event_stream(spark, path, table.schema, late="1 day")
        Q.run_available(Q.page_monitor(stream, "key", "body", ttl_s=30 * 86_400), str(tmp_path / "check"), sink=lambda df, _: out.extend(map(tuple, df.select("event_id", "changed").collect())))
    assert sorted(out) == [(1, False), (2, False), (3, True), (4, False), (5, False)]  # the last would be a change otherwise
