from pyspark.sql import functions as F

from newsgraph.sources import archive as A, archive_source as AS
from newsgraph.streaming import feed as ST
from test_archive import land, record, zipped


def test_the_same_as_whole_files(spark, tmp_path):
    folder = land(tmp_path / "in")
    key = lambda df: sorted((r.path, r.line_no, tuple(r.fields or ())) for r in df.collect())
    assert key(AS.fields_of(AS.scan_archives(spark, folder))) == key(A.archive_lines(A.read_archives(spark, folder)))
    ends = {r.stamp[6:8]: r.state for r in AS.scan_archives(spark, folder).where("state <> 'line'").collect()}
    assert ends == {"01": "end", "02": "end", "03": "broken", "04": "broken"}


def test_quotes_times_and_empty_folders(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deeper").mkdir(parents=True)
    assert AS.scan_archives(spark, str(folder)).count() == 0
    text = record(0, V2Tone='"a') + "\n" + record(1, DATE='b"') + "\n" + record(2, Extras='"x\ty"') + "\n"
    (folder / "20230601121500.zip").write_bytes(zipped(text.encode()))
    (folder / "deeper" / "20230601123000.zip").write_bytes(zipped(b""))
    (folder / "20230601121500.txt").write_bytes(b"other")
    lines = AS.fields_of(AS.scan_archives(spark, str(folder), "121500", legacy_quotes=True), legacy_quotes=True)
    assert [(r.GKGRECORDID, r.Extras) for r in A.well_formed(lines).collect()] == [("id2", "x\ty")]
    assert [r.state for r in AS.scan_archives(spark, str(folder), "123000").collect()] == ["end"]


def test_stamps_are_chosen_by_name(spark, tmp_path):
    """Conditions on the stamp go to the source: files of other stamps have no task."""
    folder = tmp_path / "in"
    folder.mkdir()
    for d in range(1, 29):
        (folder / f"202306{d:02d}121500.zip").write_bytes(zipped((record(d) + "\n") .encode()))
    lines = AS.scan_archives(spark, str(folder), taskBytes="1").where("state = 'line'")
    assert lines.rdd.getNumPartitions() == 28
    many = [f"202306{d:02d}121500" for d in range(1, 15)]
    for condition, n in ((F.col("stamp") == many[3], 1), (F.col("stamp").isin(many), 14), (F.col("stamp") > many[-1], 14),
                         ((F.col("stamp") >= many[2]) & (F.col("stamp") < many[4]), 2), (F.col("stamp").isin([]), 0)):
        some = lines.where(condition)
        assert some.count() == n and some.rdd.getNumPartitions() == max(n, some.rdd.getNumPartitions() if n == 0 else 1)
    assert AS.scan_archives(spark, str(folder)).rdd.getNumPartitions() == 1


def test_lines_beyond_one_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "20230601121500.zip").write_bytes(zipped("".join(f"{i}\n" for i in range(5_001)).encode()))
    rows = AS.scan_archives(spark, str(folder)).where("state = 'line'").collect()
    assert sorted((r.line_no, r.line) for r in rows) == [(i, str(i)) for i in range(5_001)]


def test_stream_over_restarts_and_late_files(spark, tmp_path):
    """Every file once: in order, late within the window, and in parts of one stamp; what is later is left out."""
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    def deliver(*names):
        for name in names:
            (folder / f"{name}.zip").write_bytes(zipped((record(name, V2Themes="INFO_HOAX,1") + "\n").encode()))
        ST.ingest(ST.landed_archives(spark, str(folder), windowDays="3"), out, marks)
        return sorted(r.GKGRECORDID[2:] for r in spark.read.parquet(out).collect())
    first = ["20230601121500.0", "20230610121500.0"]
    assert deliver(*first) == first
    assert deliver() == first
    later = ["20230608121500.0", "20230610121500.1", "20230612121500.0"]
    assert deliver(*later) == sorted(first + later)
    assert deliver("20230602121500.0", "20230612123000.0") == sorted(first + later)  # too late; another time of day
    assert deliver("20230611121500.0") == sorted(first + later + ["20230611121500.0"])
