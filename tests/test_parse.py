import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgraph.functions import parse as P
from newsgraph.operators import clean as C
from newsgraph.schema import RAW_COLUMNS

GOOD = {"DATE": "20230601121500", "V2Themes": "A,1;B,2", "V2Locations": "1#Brazil#BR##-14.2#-51.9#BR",
        "V2Tone": "-1,2,3,5,6,7,100", "SourceCommonName": "s"}


def raw(spark, rows):
    full = [(i, *[{"GKGRECORDID": f"r{i}", **GOOD, **r}.get(c, "") for c in RAW_COLUMNS])
            for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "_pos long, " + ", ".join(f"{c} string" for c in RAW_COLUMNS))


def parsed(spark, column, values):
    df = C.parse_events(raw(spark, [{column: v} for v in values]), ["_pos"])
    return df.orderBy("_pos").collect()


def test_dates(spark):
    cases = {"20230601121500": dt.datetime(2023, 6, 1, 12, 15), "20230601121500xyz": dt.datetime(2023, 6, 1, 12, 15),
             "": None, None: None, "20230229121500": None, "202306011215": None, "20231301000000": None}
    assert [r.Date for r in parsed(spark, "DATE", list(cases))] == list(cases.values())


def test_date_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # this wall time does not exist in that zone
        assert parsed(spark, "DATE", ["20230312023000"])[0].Date == dt.datetime(2023, 3, 12, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("v2, v1, want", [
    ("A,1;B,2;A,9; C ,3;;", "Z", ["A", "B", "C"]), ("", "A;B;A", ["A", "B"]), (";;", "A", []),
    (",5;A,1", "", ["A"]), (" ;\t; ,7;", "", []), ("A", "", ["A"]), (None, None, []),
    ("\xa0A ,1;　B", "", ["A", "B"]), ("B,1,x;A", "", ["B", "A"]),
])
def test_themes(spark, v2, v1, want):
    df = raw(spark, [{"V2Themes": v2, "Themes": v1}])
    row = C.parse_events(df).first()
    assert (row.Themes, row.Theme_Count) == (want, len(want))
    assert (df.where(C.drop_reason().isNull()).count() == 1) == bool(want)


LOCATIONS = {
    "1#Brazil#BR##-14.2#-51.9#BR": ("Brazil", "1", -14.2, -51.9),
    "4#Kano, Kano, Nigeria#NI#NI29#12#8.5#x": ("Nigeria", "4", 12.0, 8.5),
    "3#X, #US#US01#1#2#3": ("", "3", 1.0, 2.0),
    "1##US##1#2#3": (None, "1", 1.0, 2.0),
    "1#A#B##x#2#3": ("A", "1", None, None),
    "1#A#B##1#nan#3": ("A", "1", None, None),
    "1#A#B##1_0#2#3": ("A", "1", None, None),
    "1#A#B###2#3": ("A", "1", None, 2.0),
    "1#A, B#B##1#2": ("A, B", "1", 1.0, 2.0),
    "1#A#B##+1.5e1# .5 #": ("A", "1", 15.0, 0.5),
    "1#A#B##1": (None, None, None, None),
    "": (None, None, None, None),
    "1#A#B##;1#C#D##1#2#3": (None, None, None, None),
}


def test_locations(spark):
    rows = parsed(spark, "V2Locations", list(LOCATIONS))
    got = [(r.Country, r.Location_Type, r.Latitude, r.Longitude) for r in rows]
    assert got == list(LOCATIONS.values())


def test_location_test_on_text_agrees_with_parsed_values(spark):
    df = raw(spark, [{"V2Locations": v} for v in LOCATIONS])
    kept = {r._pos for r in df.where(C.drop_reason().isNull()).collect()}
    want = {i for i, (c, _, a, b) in enumerate(LOCATIONS.values()) if None not in (c, a, b)}
    assert kept == want


def test_tones(spark):
    none = (None,) * 6
    cases = {"-1,2,3,5,6,7,100": (-1, 2, 3, 5, 6, 7), "-1,,3,5,6,7": (-1, None, 3, 5, 6, 7),
             "-1,x,3,5,6,7": none, "1,2": none, "": none, "1,2,3,4,5,6": (1, 2, 3, 4, 5, 6),
             "1,2,3,4,5,6,x": (1, 2, 3, 4, 5, 6), "1,2,3,4,5,inf": none, "1,2,3,4,5, ": none}
    got = [tuple(r)[-6:] for r in parsed(spark, "V2Tone", list(cases))]
    assert got == list(cases.values())


def test_reason_order_and_late_dedupe(spark):
    rows = [{"DATE": "bad", "V2Themes": "", "V2Locations": ""}, {"V2Themes": ";;", "V2Locations": ""},
            {"V2Locations": ""}, {"GKGRECORDID": "d", "V2Themes": ""},
            {"GKGRECORDID": "d", "SourceCommonName": "second"}, {"GKGRECORDID": "d", "SourceCommonName": "third"}]
    df = raw(spark, rows)
    report = {r.measure: r.n for r in C.drop_report(df).collect()}
    assert report == {"raw_rows": 6, "bad_date": 1, "no_themes": 2, "no_location": 1,
                      "duplicates": 1, "final_rows": 1}
    assert [r.Source for r in C.clean_events(df).collect()] == ["second"]


def test_theme_filter_modes(spark):
    df = raw(spark, [{"V2Themes": "X_SURVEILLANCE_Y,1"}, {"V2Themes": "", "Themes": "SURVEILLANCE"},
                     {"V2Themes": "OTHER,3"}, {"V2Themes": "OTHER,3; SURVEILLANCE,4"}])
    got = lambda **k: [r._pos for r in C.theme_filter(df, ["SURVEILLANCE"], **k).orderBy("_pos").collect()]
    assert got() == [0, 1, 3]
    assert got(mode="token") == [1, 3]


def test_pilot_dedupes_before_the_flag(spark):
    df = spark.createDataFrame(
        [(0, "a", 0, 1.0, 1.0, "T", 1.0, "UK"), (1, "a", 1, 1.0, 1.0, "T", 9.0, "UK"),
         (2, "b", 1, 1.0, 1.0, "T", None, "U.S."), (3, "c", 1, 1.0, 1.0, "T", 2.0, "France"),
         (4, "d", 1, None, 1.0, "T", 100.0, "France"), (5, "e", 1, 1.0, 1.0, "T", 3.0, "UK")],
        "_pos long, Record_ID string, Misinfo_Flag int, Latitude double, Longitude double, "
        "Themes string, Tone_Overall double, Country string")
    rows = C.pilot_clean(df).orderBy("Record_ID").collect()
    assert [(r.Record_ID, r.Tone_Overall, r.Country) for r in rows] == [
        ("b", 2.5, "USA"), ("c", 2.0, "France"), ("e", 3.0, "United Kingdom")]


def test_sample_is_stable_and_sorted(spark):
    df = spark.createDataFrame([(f"r{i}",) for i in range(200)], "Record_ID string")
    one = [r[0] for r in C.seeded_sample(df, 20, 42).collect()]
    assert one == sorted(one) and len(one) == 20
    assert one == [r[0] for r in C.seeded_sample(df.repartition(7), 20, 42).collect()]
    assert one != [r[0] for r in C.seeded_sample(df, 20, 7).collect()]
    assert C.seeded_sample(df, 500).count() == 200


def test_one_key_with_most_rows_is_cut_before_the_shuffle(spark):
    df = spark.range(0, 200_000, 1, 8).select(
        F.col("id").alias("_pos"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("Record_ID"))
    out = C.dedupe_first(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert out.where("Record_ID = 'hot'").first()._pos == 0
