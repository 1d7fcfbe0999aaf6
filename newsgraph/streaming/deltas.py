"""A small table that a stream keeps up to date: a snapshot, what came after it, and a pointer to both.

Each batch writes a folder of its own; every so many batches they are merged with the
snapshot into a new one. The pointer of batch n is one file, written aside and renamed into place, that names
the snapshot and the batches behind it. Readers take the newest pointer, so they see whole
batches only; a batch that has its pointer is done and does nothing when replayed. Folders that
neither of the two newest pointers names are removed, so their number stays bounded.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Batches between two snapshots.
COMPACT_EVERY = 20
#: The column that tells a row's batch.
BATCH = "_batch"


class DeltaTable:
    """``merge`` brings rows of snapshot and batches, with their ``_batch``, to the rows of a new snapshot."""

    def __init__(self, path: str, merge: Callable[[DataFrame], DataFrame] | None = None, compact_every: int = COMPACT_EVERY):
        self.path, self.merge, self.compact_every = path.rstrip("/"), merge, compact_every

    def _at(self, spark, name=""):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()), where

    def _names(self, spark, folder):
        system, where = self._at(spark, folder)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def _pointers(self, spark):
        return [n for n in self._names(spark, "_pointers") if n.isdigit()]

    def _pointed(self, spark, name):
        system, where = self._at(spark, f"_pointers/{name}")
        stream = system.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _point(self, spark, batch_id, state):
        system, aside = self._at(spark, f"_pointers/_{batch_id:020d}")
        out = system.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._at(spark, f"_pointers/{batch_id:020d}")[1]
        if not system.rename(aside, final):
            raise RuntimeError(f"pointer of batch {batch_id} could not be put in place at {self.path}")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        pointers = self._pointers(spark)
        if pointers and int(pointers[-1]) >= batch_id:
            return
        state = self._pointed(spark, pointers[-1]) if pointers else {"snapshot": None, "deltas": []}
        own = f"delta-{batch_id}"
        batch.withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{own}")
        state = {"snapshot": state["snapshot"], "deltas": [*state["deltas"], own]}
        if len(state["deltas"]) >= self.compact_every:
            snapshot = f"snapshot-{batch_id}"
            self.merge(self._rows(spark, state)).write.mode("overwrite").parquet(f"{self.path}/{snapshot}")
            state = {"snapshot": snapshot, "deltas": []}
        self._point(spark, batch_id, state)
        self._tidy(spark)

    def _tidy(self, spark):
        """Removes what the two newest pointers do not name; a reader may still be at the older of them."""
        pointers = self._pointers(spark)
        named = {"_pointers"}
        for name in pointers[-2:]:
            state = self._pointed(spark, name)
            named |= {state["snapshot"], *state["deltas"]}
        for gone in [n for n in self._names(spark, "") if n not in named] + [f"_pointers/{n}" for n in pointers[:-2]]:
            system, where = self._at(spark, gone)
            system.delete(where, True)

    def _rows(self, spark, state):
        return spark.read.parquet(*[f"{self.path}/{n}" for n in (state["snapshot"], *state["deltas"]) if n])

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of the snapshot and of the batches behind it, not merged."""
        pointers = self._pointers(spark)
        if not pointers:
            raise FileNotFoundError(f"no batch has been written to {self.path}")
        return self._rows(spark, self._pointed(spark, pointers[-1]))
