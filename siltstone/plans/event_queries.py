"""Metrics, limits, sessions, monitors, crawls and conversations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import metrics as M
from siltstone.operators import sessions as X
from siltstone.plans.registry import Family, table

family = Family()
_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0)
_SLOT = "CAST(floor(epoch_us(ts) / {us}) * {s} AS BIGINT)"


def _slot(seconds: int) -> str:
    return _SLOT.format(us=f"{seconds * 1_000_000}.0", s=seconds)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@family.query("SELECT event_type, CAST(count(*) AS DOUBLE) AS total FROM events GROUP BY event_type")
def metric_counter(spark, sf_dir):
    return M.counter(_events(spark, sf_dir), ["event_type"])


@family.query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY ALL")
def gauge_last(spark, sf_dir):
    return M.gauge(_events(spark, sf_dir), ["user_id", "event_type"], "value", ["ts", "event_id"])


@family.query("SELECT event_type, le, count FROM (" + " UNION ALL ".join(f"SELECT event_type, '{b}' AS le, count(*) FILTER (WHERE value <= {b}) AS count FROM events GROUP BY event_type" for b in _BOUNDS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type)")
def metric_histogram(spark, sf_dir):
    return M.histogram(_events(spark, sf_dir), ["event_type"], "value", _BOUNDS)


_CUM = ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS c{i}" for i, b in enumerate(_BOUNDS))


def _sql_quantile(q: float) -> str:
    out = "CASE "
    for i, b in enumerate(_BOUNDS):
        low, below = (_BOUNDS[i - 1], f"c{i - 1}") if i else (0.0, "0")
        out += f"WHEN c{i} >= n * {q} THEN {low} + ({b} - {low}) * CASE WHEN c{i} - {below} > 0 THEN (n * {q} - {below}) / (c{i} - {below}) ELSE 1.0 END "
    return out + f"ELSE {_BOUNDS[-1]} END"


@family.query(f"SELECT event_type, round({_sql_quantile(0.5)}, 6) AS p50, round({_sql_quantile(0.95)}, 6) AS p95 FROM (SELECT event_type, {_CUM}, CAST(count(value) AS DOUBLE) AS n FROM events GROUP BY event_type)")
def metric_quantile(spark, sf_dir):
    one = lambda q, name: M.quantile(_events(spark, sf_dir), ["event_type"], "value", q, _BOUNDS).select("event_type", F.round("quantile", 6).alias(name))
    return one(0.5, "p50").join(one(0.95, "p95"), "event_type")


@family.query(f"SELECT {_slot(3600)} AS \"window\", event_type, count(*) AS increase, count(*) / 3600.0 AS rate FROM events GROUP BY ALL")
def metric_rate(spark, sf_dir):
    return M.rate(_events(spark, sf_dir), ["event_type"], "ts", 3600)


@family.query("SELECT event_type, round(sum(CAST(value AS DECIMAL(18, 6))) / count(value), 4) AS mean FROM events GROUP BY event_type")
def metric_mean(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,6)"))
    return M.mean_latency(rows, ["event_type"], "value").select("event_type", F.round(F.col("mean").cast("double"), 4).alias("mean"))


@family.query(f"""WITH w AS (SELECT {_slot(3600)} AS win, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1), o AS (SELECT *, win - row_number() OVER (ORDER BY win) * 3600 AS island FROM w WHERE errors >= 1)
SELECT min(win) AS since, max(win) + 3600 AS until, count(*) AS windows FROM o GROUP BY island HAVING max(win) + 3600 - min(win) >= 7200""")
def alert_islands(spark, sf_dir):
    windows = _events(spark, sf_dir).groupBy(M.slot(F.col("ts"), 3600).alias("window")).agg(F.count_if(F.col("event_type") == "error").alias("errors")).withColumn("name", F.lit("errors"))
    return M.alerts(windows, ["name"], F.col("errors") >= 1, 3600, 7200).drop("name")


@family.query(f"SELECT event_id, place, place <= 2 AS allowed, greatest(0, 2 - place) AS remaining FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, {_slot(86400)} ORDER BY ts, event_id) AS place FROM events)")
def rate_limit_fixed(spark, sf_dir):
    out = M.fixed_window_limit(_events(spark, sf_dir), "user_id", "ts", ["ts", "event_id"], 2, 86_400)
    return out.select("event_id", "place", "allowed", "remaining")


_STEPS = "WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS sec, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@family.query(f"""{_STEPS}, s AS (SELECT user_id, n, event_id, TRUE AS allowed, [sec] AS held FROM r WHERE n = 1
UNION ALL SELECT user_id, n, event_id, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, sec) ELSE k END FROM (SELECT r.*, list_filter(s.held, lambda t: r.sec - t < 86400) AS k FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))
SELECT event_id, user_id, allowed FROM s""")
def sliding_limiter(spark, sf_dir):
    return M.sliding_window_limit(_events(spark, sf_dir), "user_id", "ts", "event_id", 3, 86_400.0)


@family.query(f"""{_STEPS}, s AS (SELECT 0 AS n, user_id, CAST(NULL AS BIGINT) AS event_id, '' AS before, 'closed' AS state, 0 AS bad, CAST(0 AS DOUBLE) AS opened FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT n, user_id, event_id, cur, CASE WHEN cur = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN cur = 'half_open' OR bad + 1 >= 2 THEN 'open' ELSE cur END, CASE WHEN cur = 'open' THEN bad WHEN ok THEN 0 ELSE bad + 1 END,
  CASE WHEN cur <> 'open' AND NOT ok AND (cur = 'half_open' OR bad + 1 >= 2) THEN sec ELSE opened END
FROM (SELECT r.*, s.bad, s.opened, CASE WHEN s.state = 'open' AND r.sec - s.opened >= 86400 THEN 'half_open' ELSE s.state END AS cur FROM s JOIN r ON r.user_id = s.user_id AND r.n = s.n + 1))
SELECT event_id, user_id, before AS state, before <> 'open' AS passed FROM s WHERE n > 0""")
def circuit_breaker(spark, sf_dir):
    return M.breaker_states(_events(spark, sf_dir), "user_id", "ts", "event_id", F.col("event_type") != "error", failures=2, cooldown=86_400.0)


@family.query("SELECT event_id, least(0.5 * pow(2.0, event_id % 8), 10.0) AS wait_s FROM events")
def retry_backoff(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", M.backoff(F.col("event_id") % 8).alias("wait_s"))


@family.query("SELECT 'events_total{event_type=\"' || event_type || '\",lang=\"x\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metrics_exposition(spark, sf_dir):
    counts = _events(spark, sf_dir).groupBy("event_type").count().withColumn("lang", F.lit("x"))
    return M.exposition(counts, "events_total", ["lang", "event_type"], "count")


@family.query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failing, CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'ok' WHEN count(*) FILTER (WHERE event_type = 'error') = count(*) THEN 'down' ELSE 'degraded' END AS status FROM events GROUP BY user_id")
def health_status(spark, sf_dir):
    return M.health(_events(spark, sf_dir), "user_id", F.col("event_type") == "error")


@family.query("""WITH g AS (SELECT *, CASE WHEN lag(epoch_us(ts)) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 36000000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS last, count(*) AS events FROM s GROUP BY ALL""")
def session_windows(spark, sf_dir):
    return X.idle_sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", 36_000)


@family.query("""SELECT event_id, coalesce(before <> '' AND before <> event_type, false) AS changed, length(before) AS previous_length, length(event_type) AS current_length FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""")
def monitor_change(spark, sf_dir):
    return X.page_changes(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("event_id", "changed", "previous_length", "current_length")


@family.query("SELECT event_id, before IS NULL OR epoch_us(ts) - before >= 432000000000 AS is_new FROM (SELECT event_id, ts, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events)")
def monitor_new_urls(spark, sf_dir):
    return X.new_urls(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id", ttl_days=5).select("event_id", "is_new")


@family.query("SELECT event_id, epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) < 864000000000 AS live, CASE WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) < 216000000000 THEN 'fresh' WHEN epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts) < 432000000000 THEN 'aging' ELSE 'stale' END AS freshness FROM events")
def ttl_freshness(spark, sf_dir):
    return X.expired(_events(spark, sf_dir), "ts", 864_000, F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("event_id", "live", "freshness")


@family.query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, 'ref_' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || '_1' AS ref FROM conversations")
def conversation_refs(spark, sf_dir):
    return X.numbered_refs(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "step", "ref")


@family.query("SELECT conv_id, string_agg(piece, chr(10) ORDER BY turn) AS context FROM (SELECT conv_id, turn, '[' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '] ' || substr(text, 1, 200) AS piece FROM conversations) GROUP BY conv_id")
def context_listagg(spark, sf_dir):
    return X.context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 200)


_KIND = "CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'source' WHEN 'purchase' THEN 'answer' WHEN 'error' THEN 'error' ELSE 'status' END"


@family.query(f"""WITH e AS (SELECT user_id, event_id, {_KIND} AS kind, 'p' || (event_id % 13) AS payload FROM events), first AS (SELECT user_id, payload, min(event_id) AS n FROM e WHERE kind = 'source' GROUP BY ALL), src AS (SELECT user_id, string_agg(payload, ',' ORDER BY n) AS sources FROM first GROUP BY user_id)
SELECT user_id, arg_max(payload, event_id) FILTER (WHERE kind = 'status') AS status, arg_max(payload, event_id) FILTER (WHERE kind = 'answer') AS answer, coalesce(string_agg(payload, '' ORDER BY event_id) FILTER (WHERE kind = 'token'), '') AS text, coalesce(any_value(sources), '') AS sources, bool_or(kind = 'error') AS failed FROM e LEFT JOIN src USING (user_id) GROUP BY user_id""")
def research_fold(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.expr(_KIND).alias("kind"), F.expr("'p' || (event_id % 13)").alias("payload"))
    return X.fold_events(rows, "user_id", "event_id", "kind", "payload").withColumn("sources", F.array_join("sources", ","))


@family.query("""WITH RECURSIVE edges AS (SELECT page_id AS src, (page_id * 7 + k * 13) % (SELECT count(*) FROM pages) AS dst, k AS pos FROM pages, (SELECT unnest([1, 2, 3]) AS k)),
walk AS (SELECT CAST(0 AS BIGINT) AS url, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < 4)
SELECT CAST(url AS VARCHAR) AS url, min(depth) AS depth FROM walk GROUP BY url""")
def bfs_levels(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("url"), "page_id")
    n = pages.count()
    edges = pages.withColumn("pos", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select(F.col("url").alias("src"), ((F.col("page_id") * 7 + F.col("pos") * 13) % n).cast("string").alias("dst"), "pos")
    start = pages.where("page_id = 0").select("url", F.lit(1).cast("long").alias("seq"))
    return X.crawl_levels(pages.select("url"), edges, start, max_depth=4, max_pages=1 << 30).select("url", "depth")


@family.query("SELECT CAST(floor(epoch_us(ts) / 3600000000.0) * 3600 AS BIGINT) AS \"window\", event_type, count(*) AS n, round(sum(CAST(value AS DECIMAL(18, 4))), 4)::DOUBLE AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return X.tumbling(rows, "ts", 3600, ["event_type"]).withColumn("total", F.col("total").cast("double"))


@family.query()
def unified_diff(spark, sf_dir):
    """Diffs between each document and the one before it in its source."""
    docs = table(spark, sf_dir, "documents")
    old = F.lag("text").over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return X.unified_diff(docs.select("doc_id", old.alias("old"), "text"), "doc_id", "old", "text")
