import os
import random

import pytest
from pyspark.sql import functions as F

from newsgraph.streaming import feed as ST
from newsgraph.streaming.deltas import DeltaTable


def folders(path):
    return [n for n in os.listdir(path) if n.startswith(("delta", "snapshot"))], [
        n for n in os.listdir(f"{path}/_pointers") if n.isdigit()]


def test_newest_row_per_key_in_few_folders(spark, scratch):
    rng, want = random.Random(1), {}
    write = ST.upsert_by_batch(scratch("out"), compact_every=4)
    for i in range(23):
        rows = {f"day{rng.randint(1, 6)}": rng.randint(0, 99) for _ in range(3)}
        batch = spark.createDataFrame(list(rows.items()), "day string, n long").coalesce(1)
        write(batch, i)
        write(batch.withColumn("n", F.lit(-1).cast("long")), i)  # a replay is not written again
        if i:
            write(batch.withColumn("n", F.lit(-2).cast("long")), i - 1)  # nor is an older batch
        want |= rows
        stored, pointers = folders(scratch("out"))
        assert len(stored) <= 6 and len(pointers) <= 2
    assert {r.day: r.n for r in ST.latest(spark, scratch("out")).collect()} == want


def test_a_stop_at_any_point_counts_each_row_once(spark, scratch, monkeypatch):
    """Stopped after the folder, after the snapshot or before the tidying, then replayed."""
    def stop(*args, **kwargs):
        raise KeyboardInterrupt
    write = ST.manifest_sink(scratch("out"), F.col("d"), compact_every=2)
    want = 0
    for i in range(6):
        batch = spark.createDataFrame([("2024-01-01",)] * (i + 1), "d string").coalesce(1)
        with monkeypatch.context() as m:
            m.setattr(DeltaTable, ("_point", "_tidy", "_rows")[i // 2], stop)
            try:
                write(batch, i)
            except KeyboardInterrupt:
                pass
        if want:
            assert ST.stream_manifest(spark, scratch("out")).first().n in (want, want + i + 1)  # whole batches only
        write(batch, i)
        want += i + 1
        assert [tuple(r) for r in ST.stream_manifest(spark, scratch("out")).collect()] == [("2024-01-01", want)]


def test_readers_hold_on_through_a_merge(spark, scratch):
    write = ST.manifest_sink(scratch("out"), F.col("d"), compact_every=2)
    batch = spark.createDataFrame([("2024-01-01",)], "d string").coalesce(1)
    write(batch, 0)
    before = ST.stream_manifest(spark, scratch("out"))
    write(batch, 1)
    assert before.first().n == 1 and ST.stream_manifest(spark, scratch("out")).first().n == 2


def test_nothing_written_yet(spark, scratch):
    with pytest.raises(FileNotFoundError):
        ST.stream_manifest(spark, scratch("out"))
