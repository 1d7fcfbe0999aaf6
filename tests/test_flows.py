import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph.operators.clean import EVENT_COLUMNS
from newsgraph.plans import flows
from newsgraph.sources import files as FS
from test_archive import record, zipped

THEMES = ["INFO_HOAX", "ELECTION", "ECON_INFLATION", "WB_HEALTH", "CYBER_ATTACK"]


def day_file(rng, day, rows=40):
    lines = []
    for i in range(rows):
        nation = int(rng.integers(0, 8))
        themes = ";".join(f"{t},{i}" for t in rng.choice(THEMES, 2, replace=False)) + ";INFO_RUMOR,9"
        lines.append(record(
            f"{day}-{i % 35}", DATE=f"{day}121500", V2Themes=themes, SourceCommonName=f"s{i % 5}",
            V2Locations=f"1#Land{nation}#L##{nation * 4}.{i % 3}#{nation * 9}.{i % 3}#1",
            V2Tone=f"{rng.normal():.2f},1,2,3,4,5,100"))
    return zipped(("\n".join(lines) + "\n" + record("x", 20) + "\n").encode())


def test_from_archives_to_results(spark, tmp_path):
    rng = np.random.default_rng(1)
    landing = tmp_path / "landing"
    landing.mkdir()
    path = lambda n: str(tmp_path / n)
    days = ["20230530", "20230531", "20230601", "20230602"]
    for d in days[:3]:
        (landing / f"{d}121500.gkg.csv.zip").write_bytes(day_file(rng, d))
    (landing / f"{days[3]}121500.gkg.csv.zip").write_bytes(b"broken")
    (landing / "20230530123000.gkg.csv.zip").write_bytes(day_file(rng, "20230530"))

    args = (spark, str(landing), path("raw"), path("manifest"))
    flows.extract(*args, "2023-05-30", "2023-06-03")
    manifest = lambda: {(r.date, r.rows_matched, r.status) for r in FS.read_manifest(spark, path("manifest")).collect()}
    assert manifest() == {("2023-05-30", 40, "ok"), ("2023-05-31", 40, "ok"), ("2023-06-01", 40, "ok"),
                          ("2023-06-02", 0, "failed"), ("2023-06-03", 0, "failed")}

    (landing / f"{days[3]}121500.gkg.csv.zip").write_bytes(day_file(rng, days[3]))
    rows = flows.extract(*args, "2023-05-30", "2023-06-03", resume=True)
    assert {(r.date, r.rows_matched, r.status) for r in rows.collect()} == {
        ("2023-06-02", 40, "ok"), ("2023-06-03", 0, "failed")}
    assert spark.read.parquet(path("raw")).count() == 160

    report = {r.measure: r.n for r in flows.clean(spark, path("raw"), path("events")).collect()}
    assert (report["raw_rows"], report["duplicates"], report["final_rows"]) == (160, 20, 140)
    events = spark.read.parquet(path("events"))
    assert set(events.columns) == set(EVENT_COLUMNS) and events.count() == 140

    flows.analyse(spark, path("events"), path("results"), 300.0, 5)
    panel = spark.read.parquet(path("results/country_month_panel.parquet"))
    assert panel.agg({"Misinfo_Event_Count": "sum"}).first()[0] == 140
    table = spark.read.csv(path("results/negative_binomial_irr.csv"), header=True)
    assert table.columns == ["term", "coef", "IRR", "IRR_ci_lower", "IRR_ci_upper", "p_value"] and table.count() == 5
    assert spark.read.parquet(path("results/morans_i.parquet")).count() == 2


def test_broken_archives_and_foreign_dates(spark, tmp_path):
    """A file broken after many lines gives nothing; once mended it is read whole; rows count by file."""
    rng = np.random.default_rng(2)
    landing = tmp_path / "landing"
    landing.mkdir()
    path = lambda n: str(tmp_path / n)
    noise = lambda i: "".join(map(chr, rng.integers(97, 123, 30)))
    sound = zipped("".join(record(i, V2Themes="INFO_HOAX,1", DATE="20230601121500", AllNames=noise(i)) + "\n"
                           for i in range(25_000)).encode())
    broken = bytearray(sound)
    broken[int(len(broken) * 0.95)] ^= 255
    (landing / "20230601121500.gkg.csv.zip").write_bytes(broken)
    (landing / "20230602121500.gkg.csv.zip").write_bytes(zipped(
        "".join(record(i, V2Themes="INFO_HOAX,1", DATE="20230603121500") + "\n" for i in range(5)).encode()))
    args = (spark, str(landing), path("raw"), path("manifest"), "2023-06-01", "2023-06-03")
    first = {(r.date, r.rows_matched, r.status) for r in flows.extract(*args).collect()}
    assert first == {("2023-06-01", 0, "failed"), ("2023-06-02", 5, "ok"), ("2023-06-03", 0, "failed")}
    assert spark.read.parquet(path("raw")).count() == 5
    (landing / "20230601121500.gkg.csv.zip").write_bytes(sound)
    again = {(r.date, r.rows_matched, r.status) for r in flows.extract(*args, resume=True).collect()}
    assert again == {("2023-06-01", 25_000, "ok"), ("2023-06-03", 0, "failed")}
    assert spark.read.parquet(path("raw")).count() == 25_005
    fixed = {r.date: (r.rows_matched, r.status) for r in flows.repair(spark, path("raw"), path("manifest")).collect()}
    assert fixed == {"2023-06-01": (25_000, "ok"), "2023-06-02": (5, "ok"), "2023-06-03": (0, "failed")}


def test_a_run_without_its_manifest_is_rescued(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    path = lambda n: str(tmp_path / n)
    for day in ("20230601", "20230602"):
        (landing / f"{day}121500.gkg.csv.zip").write_bytes(zipped((record(1, V2Themes="INFO_HOAX,1", DATE=f"{day}121500") + "\n").encode()))
    args = (spark, str(landing), path("raw"))
    flows.extract(*args, path("lost"), "2023-06-01", "2023-06-01")
    rows = flows.extract(*args, path("manifest"), "2023-06-01", "2023-06-02", resume=True)
    assert {(r.date, r.rows_matched, r.status) for r in rows.collect()} == {("2023-06-01", 1, "ok"), ("2023-06-02", 1, "ok")}
    assert spark.read.parquet(path("raw")).count() == 2


def test_pilot(spark, tmp_path):
    rows = [(str(i % 50), "2023-06-01", "UK" if i % 2 else "United Kingdom", 1.0, 2.0, "T", i % 3 and 1, None if i % 5 else 1.5)
            for i in range(80)]
    table = spark.createDataFrame(rows, "Record_ID string, Date string, Country string, Latitude double, Longitude double, "
                                        "Themes string, Misinfo_Flag int, Tone_Overall double").withColumn("_pos", F.monotonically_increasing_id())
    needed = ["Record_ID", "Country", "Tone_Overall"]
    gaps = flows.pilot(spark, table, str(tmp_path / "clean"), str(tmp_path / "sample"), 10, required=needed)
    assert {r.column: r.n_null for r in gaps.collect()} == {"Record_ID": 0, "Country": 0, "Tone_Overall": 64}
    cleaned = spark.read.parquet(str(tmp_path / "clean"))
    assert cleaned.where("Tone_Overall IS NULL").count() == 0 and cleaned.count() == cleaned.select("Record_ID").distinct().count()
    assert spark.read.parquet(str(tmp_path / "sample")).count() == 10
    with pytest.raises(ValueError):
        flows.pilot(spark, table.drop("Country"), str(tmp_path / "c2"), str(tmp_path / "s2"), required=needed)


def test_topics_meet_events(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    words = ["ball goal team match", "vote law court bill"]
    texts = spark.createDataFrame([(str(i), f"{words[i % 2]} " * 5 if i < 40 else "zzz qqq") for i in range(44)], "Record_ID string, text string")
    FS.write_articles(texts, path("articles"))
    FS.write_articles(texts.limit(5), path("articles"), "append")  # an append that was repeated
    events = spark.range(60).selectExpr("cast(id as string) AS Record_ID", "'2023-06' AS Year_Month", "double(id % 2) AS Tone_Overall",
                                        "1.0D AS Tone_Positive", "2.0D AS Tone_Negative", "3.0D AS Tone_Polarity")
    events.write.partitionBy("Year_Month").parquet(path("events"))
    tone = flows.topics(spark, path("articles"), path("events"), path("results"), [2], min_docs=5, max_share=0.9)
    assert {r.Tone_Overall for r in tone.collect()} == {0.0, 1.0}
    labels = spark.read.parquet(path("results/event_topics.parquet"))
    assert labels.count() == 60 and labels.where("Topic_Label IS NULL").count() == 20


def test_articles_with_resume(spark, tmp_path):
    page = "<p>" + "word " * 60 + "</p>"
    rows = [(i, str(i), f"http://h{i % 3}.org/a", None, 200, "text/html", page) for i in range(6)]
    fetched = spark.createDataFrame(rows, "_pos long, Record_ID string, url string, fetch_error string, "
                                          "http_status int, content_type string, html string")
    rules = spark.createDataFrame([("h0.org", False, "/")], "host string, allow boolean, path_prefix string")
    go = lambda **k: {r.status: r.n for r in flows.collect_articles(
        spark, fetched, rules, str(tmp_path / "a"), str(tmp_path / "m"), **k).collect()}
    assert go(limit=2, resume=True) == {"disallowed": 1, "ok": 1}
    assert go(resume=True) == {"disallowed": 1, "ok": 3}
    assert go(resume=True) == {}
    assert spark.read.json(str(tmp_path / "a")).count() == 4


@pytest.mark.parametrize("resumed", [False, True])
@pytest.mark.parametrize("point", ["write_raw_by_stamp", "write_commits", "write_manifest"])
@pytest.mark.parametrize("after", [False, True])
def test_a_stop_between_any_two_writes(spark, tmp_path, monkeypatch, point, after, resumed):
    """A first run or a resume stops before or after a write; the next resume leaves the rows of one clean run."""
    landing = tmp_path / "landing"
    landing.mkdir()
    path = lambda n: str(tmp_path / n)
    lines = lambda day, n: zipped("".join(record(i, V2Themes="INFO_HOAX,1", DATE=f"{day}121500") + "\n" for i in range(n)).encode())
    sound = {"20230601": 5, "20230602": 7, "20230603": 0}
    for day, n in sound.items():
        (landing / f"{day}121500.gkg.csv.zip").write_bytes(lines(day, n))
    args = (spark, str(landing), path("raw"), path("manifest"), "2023-06-01", "2023-06-04")
    if resumed:
        (landing / "20230602121500.gkg.csv.zip").write_bytes(b"broken")
        flows.extract(*args)
        (landing / "20230602121500.gkg.csv.zip").write_bytes(lines("20230602", 7))
    with monkeypatch.context() as m:
        write, calls = getattr(FS, point), []

        def stop(*a, **k):
            calls.append(1)
            if point == "write_manifest" and not resumed and len(calls) == 1:
                return write(*a, **k)  # the emptied manifest of a first run
            if after:
                write(*a, **k)
            raise KeyboardInterrupt
        m.setattr(FS, point, stop)
        with pytest.raises(KeyboardInterrupt):
            flows.extract(*args, resume=resumed)
    for _ in range(2):  # once more changes nothing
        flows.extract(*args, resume=True)
        held = FS.read_raw_by_stamp(spark, path("raw"), flows.ORDER)
        assert {(r.stamp[:8], r["count"]) for r in held.groupBy("stamp").count().collect()} == {("20230601", 5), ("20230602", 7)}
        rows = [(r.date, r.rows_matched, r.status) for r in FS.read_manifest(spark, path("manifest")).collect()]
        assert sorted(rows) == [("2023-06-01", 5, "ok"), ("2023-06-02", 7, "ok"), ("2023-06-03", 0, "ok"), ("2023-06-04", 0, "failed")]
    fixed = sorted((r.date, r.rows_matched, r.status) for r in flows.repair(spark, path("raw"), path("manifest")).collect())
    assert fixed == sorted(rows)


def test_records_of_a_stopped_run_do_not_outlive_their_file(spark, tmp_path, monkeypatch):
    landing = tmp_path / "landing"
    landing.mkdir()
    path = lambda n: str(tmp_path / n)
    file = landing / "20230601121500.gkg.csv.zip"
    file.write_bytes(zipped((record(1, V2Themes="INFO_HOAX,1", DATE="20230601121500") + "\n").encode()))
    args = (spark, str(landing), path("raw"), path("manifest"), "2023-06-01", "2023-06-01")
    with monkeypatch.context() as m:
        m.setattr(FS, "write_commits", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            flows.extract(*args)
    file.write_bytes(zipped((record(1, V2Themes="OTHER,1", DATE="20230601121500") + "\n").encode()))
    with pytest.warns(UserWarning, match="no record"):
        flows.extract(*args, resume=True)
    assert not list((tmp_path / "raw").glob("stamp=*"))
    assert [(r.rows_matched, r.status) for r in FS.read_manifest(spark, path("manifest")).collect()] == [(0, "ok")]


def test_cleaning_reads_records_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    landing = tmp_path / "landing"
    landing.mkdir()
    path = lambda n: str(tmp_path / n)
    (landing / "20230601121500.gkg.csv.zip").write_bytes(day_file(rng, "20230601", 90))
    flows.extract(spark, str(landing), path("raw"), path("manifest"), "2023-06-01", "2023-06-01")
    from newsgraph.operators import clean as C
    whole = {r.measure: r.n for r in C.drop_report(FS.read_raw_by_stamp(spark, path("raw"), flows.ORDER)).collect()}
    monkeypatch.setattr(C, "drop_report", lambda *_: pytest.fail("a second pass over the records"))
    report = {r.measure: r.n for r in flows.clean(spark, path("raw"), path("events"), path("flat")).collect()}
    assert report == whole and report["duplicates"] == 55
    assert spark.read.csv(path("flat"), header=True, quote='"', escape='"').count() == report["final_rows"]
    # counts that do not fit the stored tables are not trusted
    monkeypatch.undo()
    monkeypatch.setattr(C, "observed_report", lambda *_: [("raw_rows", 180), ("final_rows", 35)])
    assert {r.measure: r.n for r in flows.clean(spark, path("raw"), path("events")).collect()} == whole
