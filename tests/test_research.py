"""Research loop, enrichment, memory log, migration and claims."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.operators import memory as M, positions as P, research_loop as R
from siltstone.sinks.claims import Claims
from siltstone.sinks.migration import Migration


class Plug:
    """A plug-in that notes how often it was called."""

    def __init__(self, f):
        self.f, self.calls = f, 0

    def __call__(self, df):
        self.calls += 1
        return self.f(df)


def plugs(spark):
    hits = spark.createDataFrame([("a", "u1", 1), ("a", "u2", 2), ("b", "u2", 1), ("b", "u3", 2), ("gap", "u1", 1), ("gap", "u4", 2), ("none", "u9", 1)], "query string, url string, rank int")
    plan = Plug(lambda runs: runs.select("run", F.split("prompt", ",").alias("queries")))
    search = Plug(lambda asked: asked.join(hits, "query").select("run", "query", "url", "rank"))
    answer = Plug(lambda c: c.select("run", F.concat(F.lit("read "), F.length("context").cast("string")).alias("answer")))
    gaps = Plug(lambda c: c.select("run", F.when(F.col("prompt") == "a,b", F.array(F.lit("gap"))).when(F.col("prompt") == "b", F.array(*[F.lit(f"g{i}") for i in range(6)])).otherwise(F.array()).alias("gaps")))
    texts = spark.createDataFrame([("u1", "one"), ("u2", "two"), ("u3", "three"), ("u4", "four"), ("u9", " ")], "url string, text string")
    return plan, search, texts, answer, gaps


RUNS = [(1, "a,b"), (2, "b"), (3, "none"), (4, "unknown"), (None, "a")]


def test_research_passes(spark):
    runs = spark.createDataFrame(RUNS, "run long, prompt string")
    plan, search, texts, answer, gaps = plugs(spark)
    out, sources = R.research(runs, plan, search, texts, answer, gaps)
    got = {r.run: (r.passes, r.sources, r.answer is not None) for r in out.collect()}
    assert got == {1: (2, ["u1", "u2", "u3", "u4"], True), 2: (1, ["u2", "u3"], True), 3: (0, [], False), 4: (0, [], False), None: (0, [], False)}
    assert {(r["pass"], r.url) for r in sources.where("run = 1").collect()} == {(1, "u1"), (1, "u2"), (1, "u3"), (2, "u4")}
    two = "[1] u1\none\n\n[2] u2\ntwo\n\n[3] u3\nthree" + R.AGAIN + "[1] u4\nfour"
    assert {r.run: r.answer for r in out.collect()}[1] == f"read {len(two)}" and gaps.calls == 1 and search.calls == 2
    assert R.research(runs.limit(0), plan, search, texts, answer, gaps)[0].count() == 0
    assert R.research(runs, plan, search, texts, answer, gaps, passes=1)[0].agg(F.max("passes")).first()[0] == 1


def test_research_goes_on_after_the_last_step(spark, tmp_path):
    runs = spark.createDataFrame(RUNS[:2], "run long, prompt string")
    plan, search, texts, answer, gaps = plugs(spark)

    def fails(_):
        raise RuntimeError("the model is away")

    with pytest.raises(RuntimeError):
        R.research(runs, plan, search, texts, answer, fails, folder=str(tmp_path / "run"))
    stamp = (tmp_path / "run/sources-1/_SUCCESS").stat().st_mtime_ns
    out, _ = R.research(runs, plan, search, texts, answer, gaps, folder=str(tmp_path / "run"))
    assert {r.run: r.passes for r in out.collect()} == {1: 2, 2: 1}
    assert (tmp_path / "run/sources-1/_SUCCESS").stat().st_mtime_ns == stamp


def test_enrichment_keeps_values_with_their_sources(spark):
    items = spark.createDataFrame([(1, "Acme", "Rome"), (2, None, None), (3, "Nowhere", None), (4, "Blank", None)], "id long, name string, city string")
    hits = {"Acme Rome company": [("u1", 2), ("u2", 1)], "Nowhere company": [], "Blank company": [("u3", 1)], "company": [("u1", 1)]}
    found = spark.createDataFrame([(q, u, r) for q, rows in hits.items() for u, r in rows], "query string, url string, rank int")
    texts = spark.createDataFrame([("u1", "x"), ("u2", "founded 1990"), ("u3", "")], "url string, text string")
    extract = lambda read: read.select("run", F.inline(F.array(F.struct(F.lit("year").alias("field"), F.nullif(F.regexp_extract("text", "[0-9]{4}", 0), F.lit("")).alias("value"), F.lit(None).cast("string").alias("source")), F.struct(F.lit("boss").alias("field"), F.lit("B").alias("value"), F.lit("elsewhere").alias("source")))))
    search = lambda asked: asked.join(found, "query").select("run", "url", "rank")
    out = {(r.id, r.field): (r.value, r.source) for r in R.enriched(items, "id", ["name", "city"], ["year", "boss"], search, texts, extract, hint="company").collect()}
    assert out == {(1, "year"): ("1990", "u2"), (1, "boss"): ("B", "elsewhere"), (2, "year"): (None, None), (2, "boss"): ("B", "elsewhere"), (3, "year"): (None, None), (3, "boss"): (None, None), (4, "year"): (None, None), (4, "boss"): (None, None)}


# memory


def at(s):
    return datetime.datetime.fromtimestamp(s, datetime.UTC).replace(tzinfo=None)


def test_memory_is_the_same_after_a_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = lambda *rows: spark.createDataFrame([(i, u, "q", [float(x), 1.0], f"a{i}{x}", at(t), ttl) for i, u, x, t, ttl in rows], "memory_id string, user_id string, query string, embedding array<float>, artifact string, created_at timestamp, ttl_s long")
    M.append(M.stores(entry(("m1", None, 1, 0, 100), ("m2", "ann", 2, 0, None), ("m3", "ann", 3, 50, 100), ("m4", "bob", 4, 0, 1000)), 1), path)
    M.append(M.stores(entry(("m1", None, 9, 90, 100)), 2), path)
    M.append(M.deletes(spark.createDataFrame([("m4",), ("m9",)], "memory_id string"), 3), path)
    M.append(M.stores(entry(("m4", "bob", 5, 90, 1000)), 3), path)  # a store beside a delete of the same version counts
    log = spark.read.schema(M.LOG).parquet(path)
    as_of = lambda s: F.timestamp_seconds(F.lit(s))
    state = lambda log, s: {(r.memory_id, r.version, r.artifact, r.freshness) for r in M.live(log, as_of(s)).collect()}
    assert state(log, 100) == {("m1", 2, "am19", "fresh"), ("m2", 1, "am22", "fresh"), ("m3", 1, "am33", "stale"), ("m4", 3, "am45", "fresh")}
    assert state(log, 200) == {("m2", 1, "am22", "fresh"), ("m4", 3, "am45", "fresh")}
    for s in (100, 149, 160, 200):
        small = M.compacted(log, as_of(s))
        assert small.count() <= log.count() and all(state(small, x) == state(log, x) for x in (s, s + 10, 2000))
    assert M.get(log, spark.createDataFrame([("m1",), ("m4",), ("zz",)], "memory_id string"), as_of(200)).select("memory_id").collect() == [("m4",)]
    M.append(M.expired(log, as_of(200), 7), path)
    swept = spark.read.schema(M.LOG).parquet(path)
    assert {r.memory_id for r in swept.where("version = 7").collect()} == {"m1", "m3"} and state(swept, 100) == {("m2", 1, "am22", "fresh"), ("m4", 3, "am45", "fresh")}
    assert M.live(log.limit(0), as_of(0)).count() == 0


def test_memory_hits_are_live_similar_and_the_users_own(spark):
    rows = [("m1", "ann", [1.0, 0.0]), ("m2", "bob", [0.96, 0.28]), ("m3", None, [0.6, 0.8]), ("m4", "ann", [0.0, 1.0])]
    entries = spark.createDataFrame([(i, u, "q", v, f"a{i}", at(0), None) for i, u, v in rows], "memory_id string, user_id string, query string, embedding array<float>, artifact string, created_at timestamp, ttl_s long")
    log = M.stores(entries, 1).unionByName(M.deletes(spark.createDataFrame([("m1",)], "memory_id string"), 2))
    asked = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [1.0, 0.0], "ann"), (3, [0.0, 1.0], "ann"), (4, [-1.0, 0.0], None), (5, [0.0, 1.0], "zoe")], "query_id long, query array<float>, user_id string")
    got = {(r.query_id, r.memory_id, r.similarity) for r in M.hits(log, asked, F.timestamp_seconds(F.lit(10))).collect()}
    assert got == {(1, "m2", 0.96), (3, "m4", 1.0)}


# migration


def test_a_backfill_that_was_stopped_goes_on(spark, tmp_path):
    points = spark.createDataFrame([(i, {"old": [float(i)]}) for i in range(200)], "id long, vectors map<string,array<double>>")
    calls = []

    def embed(part):
        calls.append(1)
        if len(calls) == 5:
            raise RuntimeError("lost")
        return part.select("id", F.array(F.col("id") * 2.0).alias("vector"))

    m = Migration(spark, str(tmp_path / "m"), ranges=8)
    assert m.state()["state"] == "idle"
    with pytest.raises(ValueError):
        m.cut_over()
    m.start("new")
    assert m.backfill(points, embed, most=2) == 6 and m.done() == [x for x in m.done()] and len(m.done()) == 2
    with pytest.raises(RuntimeError):
        m.backfill(points, embed)
    again = Migration(spark, str(tmp_path / "m"), ranges=8)
    stamps = {n: (tmp_path / f"m/vectors/new/range={n}/_SUCCESS").stat().st_mtime_ns for n in again.done()}
    assert len(stamps) == 4 and again.backfill(points, embed) == 0
    assert all((tmp_path / f"m/vectors/new/range={n}/_SUCCESS").stat().st_mtime_ns == t for n, t in stamps.items())
    assert again.state()["state"] == "dual_write" and again.vectors().count() == 200 and again.vectors().select("id").distinct().count() == 200
    more = again.write(points.limit(3), lambda p: p.select("id", F.array(F.lit(0.0)).alias("vector")), lambda p: p.select("id", F.array(F.lit(1.0)).alias("vector"))).collect()
    assert all(set(r.vectors) == {"default", "new"} for r in more)
    merged = again.merged(points).collect()
    assert all(r.vectors == {"old": [float(r.id)], "new": [r.id * 2.0]} for r in merged) and len(merged) == 200
    assert again.cut_over()["active"] == "new" and Migration(spark, str(tmp_path / "m"), ranges=8).state()["state"] == "cutover"


# claims


def test_two_readers_never_get_one_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i}", at(i)) for i in range(40)], "file string, uploaded timestamp")
    got, errors = {}, []

    def reader(name, part):
        try:
            got[name] = [r.file for r in Claims(spark, str(tmp_path / "claims")).claim(part, "file").collect()]
        except Exception as e:  # noqa: BLE001  shown by the assertion below
            errors.append(e)

    parts = {"a": rows.where("file < 'f3'"), "b": rows.where("file > 'f2'"), "c": rows, "d": rows.where("file like '%5'")}
    threads = [threading.Thread(target=reader, args=x) for x in parts.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors
    every = [f for files in got.values() for f in files]
    assert sorted(every) == sorted(f"f{i}" for i in range(40))
    claims = Claims(spark, str(tmp_path / "claims"))
    assert claims.taken().count() == 40 and claims.claim(rows, "file").count() == 0
    more = rows.unionByName(spark.createDataFrame([("new", at(30)), ("old", at(-99999))], "file string, uploaded timestamp"))
    assert [r.file for r in claims.open(more, "file", "uploaded", F.timestamp_seconds(F.lit(60))).collect()] == ["new"]


# positions


def test_positions_and_zip(spark):
    rows = spark.createDataFrame([(i * 7 % 100, f"x{i}") for i in range(100)], "k long, position string").repartition(7)
    got = P.numbered(rows, "k", name="n").collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i) for i in range(100)]
    few = spark.createDataFrame([(None, 1), (5, 2), (3, 3)], "k long, v int")
    both = {r.position: (r.left.v, r.right.k if r.right else None) for r in P.zipped(few, rows.where("k < 2"), ["k"], ["k"], longest=True).collect()}
    assert both == {0: (1, 0), 1: (3, 1), 2: (2, None)}
    assert P.zipped(few, rows, ["k"], ["k"]).count() == 3 and P.numbered(rows.limit(0), "k").count() == 0
