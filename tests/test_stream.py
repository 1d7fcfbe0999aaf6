import datetime as dt

from pyspark.sql import functions as F

from newsgraph.streaming import feed as ST
from test_archive import record, zipped

SCHEMA = "id long, ts timestamp_ntz"


def put(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def day(d, h=12):
    return dt.datetime(2024, 1, d, h)


def stream(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ST.landed(spark, path, schema, files_per_batch=1).withColumn("time", ST.utc(F.col("ts")))


def test_each_file_once_over_restarts(spark, scratch):
    put(spark, scratch("in"), [(1, day(1))])
    for extra in ([(2, day(2))], [(3, day(3))], None):
        ST.ingest(stream(spark, scratch("in")), scratch("out"), scratch("marks"))
        if extra:
            put(spark, scratch("in"), extra)
    assert sorted(r.id for r in spark.read.parquet(scratch("out")).collect()) == [1, 2, 3]


def test_late_rows_are_dropped_and_reported(spark, scratch):
    put(spark, scratch("in"), [(1, day(1)), (2, day(1, 20))])
    counts = lambda: ST.drain(ST.daily_counts(stream(spark, scratch("in")), "time", "2 days"),
                              scratch("marks"), ST.upsert_by_batch(scratch("out")), "update")
    counts()
    put(spark, scratch("in"), [(3, day(20))])
    counts()
    put(spark, scratch("in"), [(4, day(1)), (5, day(20))])  # the first of these is far behind
    run = counts()
    assert {r.day: r.n for r in ST.latest(spark, scratch("out")).collect()} == {"2024-01-01": 2, "2024-01-20": 2}
    dropped = sum(s.numRowsDroppedByWatermark for p in run.recentProgress for s in p.stateOperators)
    assert dropped == 1


def test_copies_across_batches(spark, scratch):
    put(spark, scratch("in"), [(1, day(1)), (1, day(1)), (2, day(2))])
    ST.ingest(ST.deduped(stream(spark, scratch("in")), "id", "time", "9 days"), scratch("out"), scratch("marks"))
    put(spark, scratch("in"), [(2, day(2)), (3, day(3))])
    ST.ingest(ST.deduped(stream(spark, scratch("in")), "id", "time", "9 days"), scratch("out"), scratch("marks"))
    assert sorted(r.id for r in spark.read.parquet(scratch("out")).collect()) == [1, 2, 3]


def test_manifest_survives_a_replay(spark, scratch):
    put(spark, scratch("in"), [(1, day(1)), (2, day(1)), (3, day(2))])
    sink = ST.manifest_sink(scratch("out"), F.col("ts").cast("date").cast("string"))
    ST.drain(stream(spark, scratch("in")), scratch("marks"), sink)
    sink(spark.read.parquet(scratch("in")), 0)  # the same batch again
    assert {r.day: r.n for r in ST.stream_manifest(spark, scratch("out")).collect()} == {
        "2024-01-01": 2, "2024-01-02": 1}


def test_archives_as_they_land(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = zipped((record(1, V2Themes="INFO_HOAX,1") + "\n" + record(2, V2Themes="OTHER,1") + "\n").encode())
    (folder / "20230601121500.gkg.csv.zip").write_bytes(good)
    (folder / "20230601123000.gkg.csv.zip").write_bytes(good)  # not the sampled time
    rows = ST.landed_archives(spark, str(folder))
    ST.ingest(rows, str(tmp_path / "out"), str(tmp_path / "marks"))
    assert [r.GKGRECORDID for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["id1"]
