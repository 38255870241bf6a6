"""What the operators of this package share: scratch space, hashing of rows, batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.classic.dataframe import DataFrame

#: Sides up to this many rows and bytes may be broadcast after counting them.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 48 << 20
#: Rows of a saved narrow table that make a file of their own.
FILE_ROWS = 500_000
#: Narrow rows of one key that a task takes easily, and the tasks that a hotter key is dealt to.
HOT_ROWS, SALTS = 1_000_000, 8


def _shared_folder(spark: SparkSession) -> str:
    """The folder that the session's ``spark.checkpoint.dir`` names.

    Where none is named, a temporary one will do on a single machine, and elsewhere it is an error: executors would not see it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="siltstone-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """df computed once and kept in the folder that all executors share.

    rows: a bound on the rows, where one is known: then as many files as keep all cores busy are enough, or one
    for each file_rows, however many partitions shuffles have.  The session's setting
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` has Spark remove a table when it is no longer used; ``cleared``
    removes all that a session has left.
    """
    spark = df.sparkSession
    _shared_folder(spark)
    return (df if rows is None else df.coalesce(max(2 * spark.sparkContext.defaultParallelism, rows // file_rows))).checkpoint(eager=True)


def unestimated(df: DataFrame) -> DataFrame:
    """A saved table without the size that Spark estimates for its plan.

    Estimates multiply at each join and outlive a checkpoint: in a loop of joins the number doubles its digits with
    every round, until the driver has no memory left for it.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def cleared(spark: SparkSession) -> None:
    """Removes this session's saved tables; for the end of a job, when their results have been written."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        dropped(spark, _shared_folder(spark))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and the path for dropped()."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def counted_small(df: DataFrame, more_bytes: int = 0, times: int = 1) -> bool:
    """Whether df is small enough to be broadcast, by its rows and bytes, counted; also with more_bytes in each row, and so many times over."""
    width = F.sum(F.length(F.to_json(F.struct("*"))).cast("long") + more_bytes)
    rows, size = df.limit(BROADCAST_ROWS // times + 1).agg(F.count("*"), width).first()
    return rows * times <= BROADCAST_ROWS and (size or 0) * times <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if a count shows that it is small; df itself otherwise."""
    return F.broadcast(df) if counted_small(df) else df


def join_salted(left: DataFrame, right: DataFrame, on: str | list[str], salt: str, rows: int, how: str = "inner") -> DataFrame:
    """left, of about so many rows (counted), joined with right, which has each key once: a key that may be hot is dealt to several tasks by a hash of its column salt.

    A key has no more rows than its table, so a table of up to HOT_ROWS rows is joined as it is.
    """
    salts = min(SALTS, 1 + rows // HOT_ROWS)
    if salts == 1:
        return left.join(right, [on] if isinstance(on, str) else on, how)
    dealt = left.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")


def row_key(*columns: Column | str) -> Column:
    """A 64-bit hash of a row; equal rows share it, and null differs from every value."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*named, *[c.isNull() for c in named])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, in as many partitions as there are cores at least: a small one that is a single file would keep one core busy."""
    out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return out.repartition(cores) if out._jdf.queryExecution().toRdd().getNumPartitions() < cores else out


def fresh(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the columns an operator works on, so extra ones with any names do no harm."""
    return df.select(*[df[c] for c in wanted])


def give_back() -> None:
    """Returns memory that is free in this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a C library without it keeps its memory
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, giving memory back to the system at the end of each task, as Spark keeps its Python workers for later ones."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
