"""An inverted-file index for vectors: cells of like vectors, and searches that read only the nearest cells.

1. Centroids are fitted on the driver to a sample of at most ``SAMPLE`` unit vectors, those with the least hashes of
   their ids (spherical k-means from a fixed start), about the square root of the count of vectors.  The number of cells that a
   search must probe is measured on the same sample: the least at which ``recall`` of the true neighbours are met.
2. Every vector of the table goes to its nearest centroid.  A cell is cut into blocks of about ``BLOCK`` vectors by a
   hash of their ids, as many as its count asks for, so a cell that holds a third of all vectors is many blocks.
3. Queries go to their nearest cells, in blocks too.  Blocks of one cell meet by an equi-join (a cogroup on cell and
   both blocks' numbers); each pair is one matrix product, of which every query keeps its k best.
4. The best of all blocks: a window over k rows a block and query.

Nothing is all pairs: the work is the queries times the share of the cells that are probed.  Vectors without structure
need many cells for a high recall (the measure says how many); with structure, few.

Defined results: null vectors, and those without length or of another length than the sample's first, are in no cell and are not found; as queries
they find nothing; ties go to the lower id; repeated rows are found each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Vectors that centroids are fitted to; vectors, and queries, in a block of a cell; queries that probes are measured with.
SAMPLE, BLOCK, PROBED = 16_384, 1024, 512
_STEPS = 12


@dataclass(frozen=True)
class Cells:
    """Unit centroids, one a row, and how many of them a search probes."""

    centroids: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    sizes = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(sizes == 0, 1, sizes)


def k_means(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid without vectors stays where it is."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(_STEPS):
        nearest = (sample @ centroids.T).argmax(1)
        order = np.argsort(nearest, kind="stable")
        found, first = np.unique(nearest[order], return_index=True)
        centroids[found] = np.add.reduceat(sample[order], first, axis=0)
        centroids = _unit(centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int) -> int:
    """The least number of cells in which that share of the k nearest of sample vectors lies."""
    cells = (sample @ centroids.T).argmax(1)
    queries = sample[:: max(1, len(sample) // PROBED)]
    near = np.argsort(-(queries @ sample.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(queries @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(order), 0), 1)
    needed = np.sort(np.take_along_axis(place, cells[near], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1 if len(needed) else 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))


def fitted(points: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = 0.95, k: int = 10) -> Cells | None:
    """Centroids from a bounded sample; None for a table without vectors."""
    good = points.where(usable(F.col(vector_col)))
    n = good.count()
    rows = good.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), F.col(vector_col).alias("v")).orderBy("h", "i").limit(sample).collect()
    if not rows:
        return None
    held = _unit(np.array([r.v for r in rows if len(r.v) == len(rows[0].v)], np.float32))
    centroids = k_means(held, int(max(1, min(2 ** round(np.log2(max(n, 1)) / 2), len(held) // 16))))
    return Cells(centroids, probes_for(held, centroids, recall, k))


def _nearest(df: DataFrame, cells: Cells, most: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as float32, cell) of usable rows, one for each of their nearest cells."""
    centroids = cells.centroids
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.array(batch.column("v").flatten(), np.float32).reshape(batch.num_rows, -1)
            scores = _unit(vectors) @ centroids.T
            best = scores.argmax(1)[:, None] if most == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :most]
            at = np.repeat(np.arange(len(vectors)), best.shape[1])
            packed = pa.array([v.tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), packed.take(pa.array(at)), pa.array(best.ravel().astype(np.int32))], ["id", "v", "cell"])

    fit = usable(F.col(vector_col)) & (F.size(vector_col) == centroids.shape[1])
    rows = df.where(fit).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, f"id {kind}, v binary, cell int")


def _dealt(rows: DataFrame, name: str) -> DataFrame:
    """rows with a number below their cell's count over BLOCK, by a hash of their ids."""
    parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("_n"))  # a row for each cell
    return rows.join(F.broadcast(parts), "cell").withColumn(name, F.pmod(F.xxhash64("id"), "_n").cast("int")).drop("_n")


def indexed(points: DataFrame, cells: Cells, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The index, rows (cell, part, id, v); to be written where it is used again."""
    return _dealt(_nearest(points, cells, 1, id_col, vector_col), "part").select("cell", "part", "id", "v")


def write_index(index: DataFrame, path: str) -> None:
    """The index in files that hold ranges of cells."""
    index.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(path)


def _over(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """rows once for each of the other side's numbers in their cell; cells that the other side lacks go."""
    counts = other.groupBy("cell").agg(F.max(name).alias("_last"))  # a row for each cell
    return rows.join(F.broadcast(counts), "cell").withColumn(name, F.explode(F.sequence(F.lit(0), "_last"))).drop("_last")


def search(index: DataFrame, cells: Cells, queries: DataFrame, k: int, id_name: str = "vec_id", digits: int = 6) -> DataFrame:
    """(query_id, id, score, place): the k nearest vectors that the probed cells hold; score: the dot product of the vectors as they are."""
    asked = _dealt(_nearest(queries, cells, cells.probes, "query_id", "query"), "asked_part")
    kinds, dims = (queries.schema["query_id"].dataType.simpleString(), index.schema["id"].dataType.simpleString()), cells.centroids.shape[1]
    matrix = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, dims).astype(np.float64)

    def product(points: pa.Table, asking: pa.Table) -> pa.Table:
        points = points.sort_by("id")  # so that ties go to the lower id
        scores = matrix(asking) @ matrix(points).T
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        at = pa.array(np.repeat(np.arange(len(scores)), best.shape[1]))
        found = pa.array(np.take_along_axis(scores, best, 1).ravel(), pa.float64())
        return pa.table({"query_id": asking.column("id").take(at), "id": points.column("id").take(pa.array(best.ravel())), "score": found})

    key = ["cell", "part", "asked_part"]
    left, right = _over(index, asked, "asked_part").groupBy(*key), _over(asked, index, "part").groupBy(*key)
    found = left.cogroup(right).applyInArrow(product, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
    return near.select("query_id", F.col("id").alias(id_name), F.round("score", digits).alias("score"), "place")


def nearest(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.95) -> DataFrame:
    """search() in an index that is made for it."""
    cells = fitted(points, id_col, vector_col, recall=recall, k=k)
    if cells is None:
        kind, own = queries.schema["query_id"].dataType.simpleString(), points.schema[id_col].dataType.simpleString()
        return points.sparkSession.createDataFrame([], f"query_id {kind}, {id_col} {own}, score double, place int")
    return search(indexed(points, cells, id_col, vector_col), cells, queries, k, id_col)
