"""The inverted-file index against the exact search."""

from collections import Counter
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import vector_index as VI, vectors as V
from siltstone.plans import catalog


def recall_of(found, exact):
    got, want = {(r.query_id, r.vec_id) for r in found}, {(r.query_id, r.vec_id) for r in exact}
    return len(got & want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_over_the_tables(spark, sf):
    found = catalog.queries()["vector_index_topk"](spark, f"/root/testdata/{sf}").collect()
    exact = catalog.queries()["vector_topk"](spark, f"/root/testdata/{sf}").collect()
    assert recall_of(found, exact) >= 0.9
    scores = {(r.query_id, r.vec_id): r.score for r in exact}
    assert all(abs(scores[(r.query_id, r.vec_id)] - r.score) < 2e-6 for r in found if (r.query_id, r.vec_id) in scores)


def clustered(spark, n=3000, dims=16):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, dims))
    rows = [(i, (centres[i % 20] + rng.normal(scale=0.15, size=dims)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_few_cells_are_probed_where_vectors_have_structure(spark):
    points = clustered(spark)
    cells = VI.fitted(points)
    assert 32 <= len(cells.centroids) <= 64 and cells.probes <= len(cells.centroids) // 4
    queries = points.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    # centroids are of unit vectors, so scores are compared among unit vectors
    unit = points.withColumn("size", F.sqrt(V.dot(F.col("embedding"), F.col("embedding")))).withColumn("embedding", F.transform("embedding", lambda x: (x / F.col("size")).cast("float"))).drop("size")
    asked = unit.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = VI.search(VI.indexed(unit, cells), cells, asked, 10).collect()
    assert recall_of(found, V.top_k(unit, asked, 10).collect()) >= 0.9 and len(found) == 10 * queries.count()


def test_every_usable_row_is_in_the_index_once_and_hot_cells_are_many_blocks(spark):
    same = [(i, [1.0, 0.5, 0.25]) for i in range(2000)]
    odd = [(9001, None), (9002, [0.0, 0.0, 0.0]), (9003, [1.0]), (9004, [1.0, None, 2.0]), (9005, [float("nan"), 1.0, 1.0]), (9006, [-1.0, 0.2, 0.3]), (9006, [-1.0, 0.2, 0.3]), (None, [0.1, -1.0, 0.4])]
    points = spark.createDataFrame([(i, v, 5, "x") for i, v in same + odd], "vec_id long, embedding array<float>, cell int, id string").repartition(4)
    cells = VI.fitted(points, sample=500)
    index = VI.indexed(points, cells).collect()
    ids = [r.id for r in index]
    assert sorted(ids, key=str) == sorted([*range(2000), 9006, 9006, None], key=str)
    blocks = Counter((r.cell, r.part) for r in index)
    assert max(blocks.values()) < 1.5 * VI.BLOCK and len(blocks) >= 2
    queries = spark.createDataFrame([(1, [1.0, 0.5, 0.25]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0])], "query_id long, query array<float>")
    found = VI.search(VI.indexed(points, cells), cells, queries, 5).orderBy("place").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(1, i) for i in range(5)]


def test_exact_search_in_blocks(spark, monkeypatch):
    points = clustered(spark, 300)
    asked = points.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(map(tuple, V.top_k(points, asked, 4).collect()))
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "PARTS", 3)
    assert sorted(map(tuple, V.top_k(points, asked, 4).collect())) == whole and len(whole) == 240


def test_written_index_and_empty_tables(spark, tmp_path):
    points = clustered(spark, 400)
    queries = points.limit(3).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    cells = VI.fitted(points)
    VI.write_index(VI.indexed(points, cells), str(tmp_path / "index"))
    kept = spark.read.parquet(str(tmp_path / "index"))
    assert VI.search(kept, cells, queries, 4).count() == VI.search(VI.indexed(points, cells), cells, queries, 4).count() == 12
    assert VI.nearest(points.limit(0), queries, 5).count() == 0 and VI.nearest(points, queries.limit(0), 5).count() == 0
    assert VI.nearest(points.limit(0), queries, 5).columns == VI.nearest(points, queries, 5).columns
    assert VI.nearest(points.limit(1), queries, 5).count() == 3


@pytest.mark.parametrize("seed", range(4))
def test_matrix_search_ranks_as_sums_in_order_do(seed):
    rng = np.random.default_rng(seed)
    p = rng.choice([rng.normal(size=(500, 8)), np.round(rng.normal(size=(500, 8)))][seed % 2], 3000).astype(np.float32).astype(np.float64)
    p[100:900], p[900:1000] = p[7], p[8][::-1]
    q, k = np.concatenate([p[:40], np.zeros((1, 8))]), 5
    i, j, score = V._nearest(p, q, k)
    for n, x in enumerate(q):
        exact = [reduce(lambda s, z: s + float(z[0] * z[1]), zip(y, x, strict=True), 0.0) for y in p]  # (sum() would round otherwise)
        want = sorted(range(len(p)), key=lambda m: (-exact[m], m))[:k]
        assert j[i == n].tolist() == want and score[i == n].tolist() == [exact[m] for m in want]


def test_matrix_search_forms_small_blocks_of_single_precision_and_ranks_what_they_cannot_tell_apart(monkeypatch):
    blocks, product = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, out: blocks.append((out.dtype, out.size)) or product(a, b, out=out))
    rng = np.random.default_rng(5)
    p = rng.normal(size=(4000, 16))
    p[500:600] = p[0] * (1 + rng.permutation(100)[:, None] * 1e-13)  # the same in single precision
    p[600], p[700:800] = p[1] * 2.0**60, p[2] * 2.0**-300
    q = np.concatenate([p[:300], p[:5] * 2.0**-400, p[:5] * 2.0**40])
    i, j, score = V._nearest(p, q, 20)
    assert len(blocks) > 1 and all(kind == np.float32 and size <= 1 << 20 for kind, size in blocks)
    for n, x in enumerate(q):
        exact = np.cumsum(p * x, axis=1)[:, -1]
        want = np.lexsort((np.arange(len(p)), -exact))[:20]
        assert j[i == n].tolist() == want.tolist() and score[i == n].tolist() == exact[want].tolist()


def test_exact_search_forms_no_pairs_outside_of_its_matrix_products(spark):
    points = spark.range(6000).selectExpr("id AS vec_id", "transform(sequence(0, 7), i -> float(hash(id, i) % 1000) / 1000) AS embedding")
    asked = points.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    found = V.top_k(points, asked, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and found.count() == 1200


def test_exact_search_over_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    points = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 0.0]), (None, [1.0, 0.0])]
    points = spark.createDataFrame(points, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(10, [1.0, 1.0]), (11, None), (12, [1.0])], "query_id long, query array<float>")
    found = {}
    for r in V.top_k(points, asked, 8).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, None if r.score is None else str(r.score)))
    assert found[10] == [(6, "nan"), (7, "inf"), (None, "1.0"), (1, "1.0"), (2, "1.0"), (8, "1.0"), (3, None), (4, None)]
    assert [v for v, _ in found[11]] == [None, 1, 2, 3, 4, 5, 6, 7] and {s for _, s in found[11]} == {None}
    assert found[12][:2] == [(4, "1.0"), (None, None)] and len(found[12]) == 8
    none = points.limit(0)
    assert V.top_k(none, asked, 3).count() == 0 and V.top_k(points, asked.limit(0), 3).count() == 0
