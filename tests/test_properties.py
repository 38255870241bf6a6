"""Properties over generated inputs."""

import posixpath
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import urls as U
from siltstone.functions.text import slugify
from siltstone.operators import dedup as D
from siltstone.operators.extraction import to_markdown
from siltstone.operators.links import extract_links


def test_paths_are_cleaned_as_posix_does(spark):
    rng = random.Random(1)
    paths = {"".join(rng.choice(["/", "/", ".", "..", "a", "b"]) for _ in range(rng.randint(0, 9))) for _ in range(2000)}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", U.clean_path(F.col("p")).alias("c"))
    wrong = [(r.p, r.c, posixpath.normpath(r.p or "/")) for r in rows.collect() if r.c != posixpath.normpath(r.p or "/")]
    assert not wrong


def test_normal_forms_are_fixed_points(spark):
    rng = random.Random(2)
    part = lambda xs, n: "".join(rng.choice(xs) for _ in range(n))
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{part('aB.', 4)}x{rng.choice(['', ':80', ':443', ':8080'])}/{part(['a', 'B', '/', '..', '.'], 5)}{rng.choice(['', '?b=1&a=2', '?', '#f'])}" for _ in range(500)]
    once = spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalize_crawl("u").alias("a"), U.normalize_cache("u").alias("b"))
    twice = once.select("a", U.normalize_crawl("a").alias("a2"), "b", U.normalize_cache("b").alias("b2"))
    assert twice.where("a <> a2 or b <> b2").count() == 0


def test_first_wins_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 40).alias("k"), F.col("id").alias("n"), F.lit("x").alias("v"))
    want = sorted(map(tuple, D.first_per_key(rows, ["k"], ["n"]).collect()))
    assert sorted(map(tuple, D.first_per_key(rows.repartition(7), ["k"], ["n"]).collect())) == want and len(want) == 40


def test_slugs_have_only_what_they_may(spark):
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([32, 45, 65, 97, 49, 233, 9731, 10])) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    slugs = spark.createDataFrame([(t,) for t in texts], "t string").select(slugify(F.col("t")).alias("s"))
    assert slugs.where("not (s rlike '^([a-z0-9]+(-[a-z0-9]+)*)?$') or length(s) > 60").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab =\"'hrefp&;#!-", max_size=80))
def test_any_markup_is_read(html):
    assert all(x for x in extract_links(html, "http://h/"))
    assert isinstance(to_markdown(html), str)
