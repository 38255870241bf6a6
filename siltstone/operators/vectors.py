"""Exact vector search, reranking, retention and eviction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions import urls as U

#: Weight of each category in a retention score.
MULTIPLIERS = {"news": 0.3, "social": 0.4, "blog": 0.6, "api": 0.7, "unknown": 0.8, "reference": 1.0, "docs": 1.2}
HALF_LIFE_DAYS = 90.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


#: Queries and points, at most on average, that meet in one task; parts into which few points are dealt; pairs scored at once (they stay in a core's cache).
BLOCK, PART, PARTS, PAIRS = 16_384, 131_072, 64, 1 << 20
_RUN, _SUMMED = 32, 4096  # scores of which only the highest is compared at first; pairs summed at once


def _matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = [chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for chunk in vectors.chunks]
    return np.concatenate([np.zeros(0), *flat]).reshape(-1, size)


def _in_order(p: np.ndarray, q: np.ndarray, j: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Dot products of rows j of p and i of q, summed from the first element on, as ``dot`` does."""
    out = np.zeros(len(i))
    for at in range(0, len(i) if p.shape[1] else 0, _SUMMED):
        some = slice(at, at + _SUMMED)
        out[some] += np.cumsum(p[j[some]] * q[i[some]], axis=1)[:, -1]
    return out


def _single(rows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """rows in single precision, times powers of two by which most, their largest values, come near to 1."""
    return np.ldexp(rows, -np.frexp(most)[1]).astype(np.float32)


def _nearest(p: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of p, score) of the k best of p for each q; ties go to the earlier row of p.  All values are finite.

    A matrix product in single precision gives scores up to an error bound; those that may be among the best k are computed once more in order.
    """
    kinds = np.unique(np.ascontiguousarray(p).view(np.dtype((np.void, p.shape[1] * 8))).ravel(), return_inverse=True)[1]
    by = np.argsort(kinds, kind="stable")
    first = np.r_[True, kinds[by][1:] != kinds[by][:-1]]
    place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
    kept = np.sort(by[place < k])  # of equal vectors only the first k can be found
    p = p[kept]
    n, run = len(p), _RUN if len(p) >= k * _RUN else 1
    runs = -(-n // run)  # row m of p is in run m % runs
    across = np.zeros((p.shape[1], runs * run), np.float32)
    across[:, :n] = _single(p, np.abs(p).max()).T
    slack = 8 * (p.shape[1] + 4) * 2.0**-24 * np.sqrt((across.astype(np.float64) ** 2).sum(0)).reshape(run, runs)  # for a query of length 1
    step, found = max(1, PAIRS // (runs * run)), []
    room = np.empty((min(step, len(q)), runs * run), np.float32)
    for at in range(0, len(q), step):
        part = _single(q[at : at + step], np.abs(q[at : at + step]).max(1, keepdims=True))
        size = np.sqrt((part.astype(np.float64) ** 2).sum(1))
        scores = np.matmul(part, across, out=room[: len(part)])
        scores[:, n:] = -np.inf
        scores = scores.reshape(len(part), run, runs)
        tops, about = scores.max(1), np.outer(size, slack.max(0))
        least = np.partition(tops - about, runs - k, axis=1)[:, runs - k] if runs >= k else np.full(len(part), -np.inf)
        i, r = np.nonzero(tops + about >= least[:, None])
        m, row = np.nonzero(scores[i, :, r] + size[i, None] * slack.T[r] >= least[i, None])
        i, j = i[m], r[m] + row * runs
        exact = _in_order(p, q, j, i + at)
        by = np.lexsort((j, -exact, i))
        i, j, exact = i[by], j[by], exact[by]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[best] + at, kept[j[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _searched(id_col: str, vector_col: str, k: int, size: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        i = j = score = np.zeros(0, np.int64)
        if len(points) and len(queries):
            points = points.take(pc.sort_indices(points, sort_keys=[(id_col, "ascending")], null_placement="at_start"))
            i, j, score = _nearest(_matrix(points[vector_col], size), _matrix(queries["query"], size), k)
        return pa.table({"query_id": queries["query_id"].take(pa.array(i)), id_col: points[id_col].take(pa.array(j)), "score": pa.array(score, pa.float64())})

    return run


def _paired(points: DataFrame, queries: DataFrame, parts: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """points for each block of queries, and queries for each part of the points, with _part and _block."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda id_col, n: F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    return points.withColumn("_part", dealt(points.columns[0], parts)).withColumn("_block", every(blocks)), queries.withColumn("_block", dealt("query_id", blocks)).withColumn("_part", every(parts))


def top_k(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, id, score, place): the k nearest points of each query by dot product of unit vectors; ties go to the lower id.

    queries is (query_id, query), a stated set.  Both sides are counted; queries are cut into blocks of about BLOCK and points into parts of
    about PART, and each block meets each part in one task by both numbers; the plan is the same however many there are.  There, matrix
    products in single precision leave the pairs that can be among the best k, which are computed once more in a fixed order (see ``_nearest``).  Vectors that
    have nulls, values that are not finite (or beyond 1e15) or another size than most meet the other side pair by pair, if there are any; a
    pair without a score comes last.  Scores are rounded after the ranking.  (``vector_index`` searches without all pairs.)
    """
    points, queries = points.select(id_col, vector_col), queries.select("query_id", "query")
    sized = lambda c: F.when(F.forall(c, lambda x: x.isNotNull() & (F.abs(x) < 1e15)), F.size(c))
    sizes = points.groupBy(sized(vector_col).alias("size")).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.when(F.col("size") > 0, F.struct("n", "size")))).first()
    n_good, size = most or (0, 0)
    plain = lambda c: F.coalesce(sized(c) == size, F.lit(False)) & F.lit(size > 0)
    good, asked = points.where(plain(vector_col)), queries.where(plain("query"))
    n_queries, n_asked = queries.agg(F.count("*"), F.count_if(plain("query"))).first()
    parts, blocks = max(min(PARTS, -(-n_good // 2048)), -(-n_good // PART), 1), -(-n_asked // BLOCK) or 1
    p, q = (d.groupBy("_part", "_block") for d in _paired(good, asked, parts, blocks))
    kinds = {f.name: f.dataType.simpleString() for f in [*points.schema, *queries.schema]}
    pairs = p.cogroup(q).applyInArrow(_searched(id_col, vector_col, k, size), f"query_id {kinds['query_id']}, `{id_col}` {kinds[id_col]}, score double")
    odd = []
    if n_good < total:
        odd.append((points.where(~plain(vector_col)), queries))
    if n_asked < n_queries:
        odd.append((good, queries.where(~plain("query"))))
    for some in odd:
        x, y = _paired(*some, PARTS, -(-n_queries // BLOCK))
        pairs = pairs.unionByName(x.join(y, ["_block", "_part"]).select("query_id", id_col, dot(F.col(vector_col), F.col("query")).alias("score")))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    best = pairs.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
    return best.withColumn("score", F.round("score", digits))


def retention_score(category: Column, days: Column, access_count: Column, crawl_count: Column) -> Column:
    """Weight of the category times decay with age, plus bonuses; 0.5 stands for an unknown age."""
    weight = F.lit(0.8)
    for name, value in MULTIPLIERS.items():
        weight = F.when(category == name, value).otherwise(weight)
    decay = F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-F.greatest(days, F.lit(0)) / HALF_LIFE_DAYS))), F.lit(0.5))
    return F.round(weight * decay + F.least(F.coalesce(access_count, F.lit(0)), F.lit(100)) * 0.01 + F.least(F.coalesce(crawl_count, F.lit(0)), F.lit(20)) * 0.05, 4)


def eviction_size(count: int, max_docs: int) -> int:
    """How many entries go once there are more than max_docs."""
    return 0 if count <= max_docs else count - max_docs + max(100, int(max_docs * 0.02))


def evicted(scored: DataFrame, max_docs: int, id_col: str, score_col: str = "score") -> DataFrame:
    """The entries with the lowest scores that have to go.  Only a take-ordered runs over the table."""
    return scored.orderBy(score_col, id_col).limit(eviction_size(scored.count(), max_docs))


def scored_pages(pages: DataFrame, activity: DataFrame, as_of: Column, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Retention scores of pages from their activity: (id, last_ts, access_count, crawl_count)."""
    rows = pages.select(id_col, U.category(url_col).alias("category")).join(activity, id_col, "left")
    days = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 86_400_000_000)
    return rows.withColumn("score", retention_score(F.col("category"), days, F.col("access_count"), F.col("crawl_count")))


def memory_hits(points: DataFrame, queries: DataFrame, live: DataFrame, threshold: float = 0.85, candidates: int = 5, id_col: str = "vec_id") -> DataFrame:
    """For each query the first of its nearest candidates that is similar enough and whose entry is still live."""
    near = top_k(points, queries, candidates, id_col).where(F.col("score") >= threshold)
    alive = near.join(live.select(id_col), id_col, "left_semi")
    return alive.groupBy("query_id").agg(F.min_by(F.struct(id_col, "score"), "place").alias("hit")).select("query_id", "hit.*")
