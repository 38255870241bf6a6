"""Relational operators that Spark brings along (joins, grouping sets, windows, set operations, subqueries)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import positions as P
from siltstone.plans.registry import Family, table

family = Family()


@family.query("SELECT r_name, n_name, count(*) AS orders, round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2)::DOUBLE AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_chain(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    # nation and region are dimensions of fixed size
    places = F.broadcast(t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")))
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@family.query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@family.query("SELECT coalesce(p_partkey, l_partkey) AS partkey, p_partkey IS NULL AS no_part, n FROM part FULL JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY l_partkey) ON p_partkey = l_partkey")
def join_full(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_partkey").agg(F.count("*").alias("n"))
    part = table(spark, sf_dir, "part")
    return part.join(sold, part["p_partkey"] == sold["l_partkey"], "full_outer").select(F.coalesce("p_partkey", "l_partkey").alias("partkey"), F.col("p_partkey").isNull().alias("no_part"), "n")


@family.query("""SELECT event_id, signup_id FROM (SELECT e.event_id, s.event_id AS signup_id, row_number() OVER (PARTITION BY e.event_id ORDER BY s.ts DESC, s.event_id DESC) AS n FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND (s.ts < e.ts OR (s.ts = e.ts AND s.event_id < e.event_id)) WHERE e.event_type = 'purchase') WHERE n = 1""")
def join_asof(spark, sf_dir):
    """The latest signup before each purchase: one sort per user instead of a range join."""
    rows = table(spark, sf_dir, "events").where("event_type in ('signup', 'purchase')")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    signup = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(before)
    return rows.withColumn("signup_id", signup).where("event_type = 'purchase'").select("event_id", "signup_id")


@family.query("SELECT a.event_id, count(b.event_id) AS within_hour FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'click' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'view' GROUP BY a.event_id")
def join_interval(spark, sf_dir):
    """Clicks within an hour of each view: hours as an equi-join key, so that no user's rows are all paired."""
    e = table(spark, sf_dir, "events")
    hour = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 3_600_000_000)
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts", F.explode(F.array(hour("ts"), hour("ts") + 1)).alias("slot"))
    clicks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), hour("ts").alias("slot"))
    hits = views.join(clicks, ["user_id", "slot"]).where("at BETWEEN ts AND ts + INTERVAL 1 HOUR").groupBy("event_id").agg(F.count("*").alias("n"))
    return e.where("event_type = 'view'").select("event_id").join(hits, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("within_hour"))


_MONEY = "CAST(l_extendedprice AS DECIMAL(18, 2))"


def _agg(name: str):
    return F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias(name)


@family.query(f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, sum({_MONEY})::DOUBLE AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), _agg("total"))


@family.query(f"SELECT l_returnflag, l_linestatus, sum({_MONEY})::DOUBLE AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def group_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(_agg("total"))


@family.query(f"SELECT l_returnflag, l_shipdate, sum({_MONEY})::DOUBLE AS total FROM (SELECT l_returnflag, date_trunc('year', l_shipdate)::DATE AS l_shipdate, l_extendedprice FROM lineitem) GROUP BY GROUPING SETS ((l_returnflag), (l_shipdate), ())")
def group_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.trunc(F.col("l_shipdate").cast("date"), "year").alias("l_shipdate"), "l_extendedprice")
    return rows.groupingSets([["l_returnflag"], ["l_shipdate"], []], "l_returnflag", "l_shipdate").agg(_agg("total"))


@family.query("SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def group_pivot(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return out.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@family.query()
def approximate_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id")).alias("users_hll"))


@family.query("""SELECT event_id, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q, round(percent_rank() OVER w, 9) AS p, lead(event_id) OVER w AS next_id, first_value(event_id) OVER w AS first_id, sum(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_analytics(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.rank().over(by).alias("r"), F.dense_rank().over(by).alias("d"), F.ntile(4).over(by).alias("q"), F.round(F.percent_rank().over(by), 9).alias("p"), F.lead("event_id").over(by).alias("next_id"), F.first_value("event_id").over(by).alias("first_id"), F.sum("event_id").over(by.rowsBetween(-2, 0)).alias("run")
    )


@family.query("SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).intersect(table(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_orderkey"))


@family.query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def set_except_all(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).exceptAll(rows.where("l_returnflag = 'A'").select("l_partkey"))


@family.query("SELECT 'en' AS list, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'src1', doc_id FROM documents WHERE source = 'src1'")
def set_union_all(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = lambda name, test: docs.where(test).select(F.lit(name).alias("list"), "doc_id")
    return one("en", "lang = 'en'").unionAll(one("src1", "source = 'src1'"))


@family.query("SELECT l_orderkey, l_linenumber FROM lineitem l JOIN (SELECT l_partkey AS k, avg(CAST(l_quantity AS DECIMAL(18, 4))) AS mean FROM lineitem GROUP BY l_partkey) ON k = l_partkey WHERE l_quantity < mean * 0.2")
def correlated_subquery(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_siltstone_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber FROM _siltstone_lineitem l WHERE l_quantity < (SELECT 0.2 * avg(CAST(l_quantity AS DECIMAL(18, 4))) FROM _siltstone_lineitem x WHERE x.l_partkey = l.l_partkey)")


@family.query("""SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18, 2)))::DOUBLE AS sum_qty, sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_base"), F.count("*").alias("n"))


@family.query("""SELECT position, doc_id, vec_id FROM (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position, doc_id FROM documents) FULL JOIN (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS position, vec_id FROM embeddings) USING (position)""")
def positional_zip(spark, sf_dir):
    """Documents by falling length beside vectors by label: tables of unequal length, joined by position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars")).alias("short"))
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return P.zipped(docs, points, ["short", "doc_id"], ["label", "vec_id"], longest=True).select("position", "left.doc_id", "right.vec_id")
