"""Migration of an index to another embedding model, as a resumable state machine over tables in a folder.

States: idle, backfilling, dual_write, cutover.  The folder holds ``state.json`` files by number (the last counts), and the new
vectors under ``vectors/range=N``: ids are cut into a fixed number of ranges by a hash, and each range is written as
a whole, once.  A backfill that was stopped goes on with the ranges that have no ``_SUCCESS``; ranges that are done are never written again.
While backfilling and in dual write, new points go to both; reads ask the old model until cutover and the new one from then on.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: What each state may be followed by.
NEXT = {"idle": ("backfilling",), "backfilling": ("dual_write", "idle"), "dual_write": ("cutover", "idle"), "cutover": ("backfilling",)}


class Migration:
    def __init__(self, spark: SparkSession, folder: str, ranges: int = 64):
        self.spark, self.folder, self.ranges = spark, folder, ranges
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda x: path(f"{folder}/{x}")
        self._files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._files.exists(self._path(name))

    def state(self) -> dict:
        """The last state: its name, and the models it is between."""
        if not self._exists("states"):
            return {"number": 0, "state": "idle", "active": None, "target": None}
        return max((json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/states").collect()), key=lambda s: s["number"])  # a few rows

    def _enter(self, name: str, **more) -> dict:
        now = self.state()
        if name not in NEXT[now["state"]]:
            raise ValueError(f"{now['state']} is not followed by {name}")
        new = now | {"number": now["number"] + 1, "state": name} | more
        self.spark.createDataFrame([(json.dumps(new),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/states")
        return new

    def start(self, target: str) -> dict:
        return self._enter("backfilling", target=target)

    def cancel(self) -> dict:
        return self._enter("idle", target=None)

    def done(self) -> list[int]:
        """The ranges that are written."""
        target = self.state()["target"]
        return [n for n in range(self.ranges) if self._exists(f"vectors/{target}/range={n}/_SUCCESS")]

    def backfill(self, points: DataFrame, embed: Callable[[DataFrame], DataFrame], id_col: str = "id", most: int | None = None) -> int:
        """Writes the new vectors of the ranges that are missing, most of them at a time; returns how many are still missing.

        embed: a model's function from points to (id, vector).
        """
        if self.state()["state"] != "backfilling":
            raise ValueError("no backfill is on")
        target, ready = self.state()["target"], set(self.done())
        missing = [n for n in range(self.ranges) if n not in ready]
        for n in missing[:most]:
            part = points.where(F.pmod(F.xxhash64(id_col), F.lit(self.ranges)) == n)
            embed(part).select(id_col, "vector").write.mode("overwrite").parquet(f"{self.folder}/vectors/{target}/range={n}")
        left = len(missing) - len(missing[:most])
        if not left:
            self._enter("dual_write")
        return left

    def write(self, points: DataFrame, old: Callable[[DataFrame], DataFrame], new: Callable[[DataFrame], DataFrame], id_col: str = "id") -> DataFrame:
        """(id, vectors by model) of new points: both models' while a migration is on."""
        now = self.state()
        sides = [(now["active"], old)] if now["state"] in ("idle", "cutover") else [(now["active"], old), (now["target"], new)]
        rows = None
        for name, embed in sides:
            each = embed(points).select(id_col, F.create_map(F.lit(name or "default"), F.col("vector")).alias("vectors"))
            rows = each if rows is None else rows.join(each.withColumnRenamed("vectors", "_more"), id_col).select(id_col, F.map_concat("vectors", "_more").alias("vectors"))
        return rows

    def vectors(self, id_col: str = "id") -> DataFrame:
        """(id, vector) of the model that is being filled, or was last."""
        return self.spark.read.parquet(*[f"{self.folder}/vectors/{self.state()['target']}/range={n}" for n in self.done()]).select(id_col, "vector")

    def merged(self, points: DataFrame, id_col: str = "id", vectors_col: str = "vectors") -> DataFrame:
        """points with the new vectors beside the old ones in their map; points that have both keep them."""
        now = self.state()
        new = self.vectors(id_col).withColumnRenamed("vector", "_new")
        rows = points.join(new, id_col, "left")
        add = F.when(F.col("_new").isNotNull() & ~F.map_contains_key(vectors_col, now["target"]), F.map_concat(vectors_col, F.create_map(F.lit(now["target"]), "_new"))).otherwise(F.col(vectors_col))
        return rows.withColumn(vectors_col, add).drop("_new")

    def cut_over(self) -> dict:
        """The new model is asked from now on."""
        return self._enter("cutover", active=self.state()["target"])
