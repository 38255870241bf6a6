"""Exactly-once claims of rows (uploads, jobs): of any number of readers, one gets each.

A claim is a batch of keys.  Batches are numbered by files that are created under the rule that none is replaced, which a
file system does atomically; whoever fails to create a number takes the next.  A key belongs to the lowest batch that has it, and
whoever committed number N can read all lower ones, so two readers never both get a key.  A reader that dies after its
commit keeps its claim until ``ttl_s`` have passed since the upload, when the row is out of date anyway.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: How long a claim waits for the names of lower numbers.
WAIT_S = 60.0


class Claims:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.folder}/commits")
        if not self._files.exists(at):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(at) if f.getPath().getName().isdigit())

    def _batch(self, number: int) -> str:
        with_name = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._files.open(self._path(f"{self.folder}/commits/{number}"))
        try:
            return with_name.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _first(self, name: str) -> bool:
        """Creates an empty file, if nobody has; on a single machine's disk by the call that is atomic there."""
        at = self._path(f"{self.folder}/{name}")
        self._files.mkdirs(at.getParent())
        if self._files.getUri().getScheme() == "file":
            return self.spark._jvm.java.io.File(at.toUri().getPath()).createNewFile()
        try:
            self._files.create(at, False).close()
        except Py4JJavaError:
            if not self._files.exists(at):
                raise
            return False
        return True

    def _commit(self, batch: str) -> int:
        number = max(self._numbers(), default=-1) + 1
        while True:
            # a whole file under a name of its own, then a name that only one can have
            whole = self._path(f"{self.folder}/batches/{batch}.name")
            out = self._files.create(whole, True)
            out.write(bytearray(batch.encode()))
            out.close()
            target = self._path(f"{self.folder}/commits/{number}")
            self._files.mkdirs(target.getParent())
            if self._first(f"numbers/{number}"):
                self._files.rename(whole, target)
                return number
            number += 1

    def claim(self, rows: DataFrame, key: str) -> DataFrame:
        """Those of rows that this call got; no other call gets them."""
        batch = uuid.uuid4().hex
        keys = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).distinct()
        keys.write.parquet(f"{self.folder}/batches/{batch}")
        number = self._commit(batch)
        own = self.spark.read.parquet(f"{self.folder}/batches/{batch}")
        began = time.monotonic()
        while len(lower := [n for n in self._numbers() if n < number]) < number:
            if time.monotonic() - began > WAIT_S:
                raise TimeoutError(f"a number below {number} was taken by a reader that did not go on; remove it from {self.folder}/numbers and claim again")
            time.sleep(0.05)  # a lower number was taken and is about to be named
        if lower:
            taken = self.spark.read.schema(own.schema).parquet(*[f"{self.folder}/batches/{self._batch(n)}" for n in lower])
            own = own.join(taken.distinct(), "key", "left_anti")
        got = own.withColumnRenamed("key", "_key")
        return rows.join(got, rows[key].cast("string") == got["_key"], "left_semi")

    def taken(self) -> DataFrame:
        """(key) of all that was claimed."""
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], "key string")
        return self.spark.read.schema("key string").parquet(*[f"{self.folder}/batches/{self._batch(n)}" for n in numbers]).distinct()

    def open(self, rows: DataFrame, key: str, uploaded: str, as_of: Column, ttl_s: int = 3 * 3600) -> DataFrame:
        """Rows that are in time and not claimed yet."""
        age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(uploaded).cast("timestamp"))) / 1e6
        return rows.where(age < ttl_s).join(self.taken().withColumnRenamed("key", "_key"), F.col(key).cast("string") == F.col("_key"), "left_anti")
