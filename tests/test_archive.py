import io
import zipfile

from newsgraph.operators import clean as C
from newsgraph.schema import RAW_COLUMNS
from newsgraph.sources import archive as A, files as FS
from test_parse import raw


def record(i, n=27, **named):
    fields = [named.get(c, "") for c in RAW_COLUMNS]
    fields[0] = f"id{i}"
    return "\t".join((fields + ["more"])[:n])


def zipped(text: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("member.csv", text)
    return out.getvalue()


def land(folder):
    folder.mkdir()
    lines = [record(0, V2Themes="INFO_HOAX,1"), record(1, 26), record(2, 28), record(3, V2Themes="OTHER,1"),
             record(4, V2Themes='"CYBER_ATTACK,1')]
    (folder / "20230601121500.gkg.csv.zip").write_bytes(zipped("\n".join(lines).encode() + b"\n"))
    (folder / "20230602121500.gkg.csv.zip").write_bytes(
        zipped(record(5, V2Themes="INFO_RUMOR,1", SourceCommonName="caf").encode().replace(b"caf", b"caf\xe9") + b"\n"))
    (folder / "20230603121500.gkg.csv.zip").write_bytes(b"not a zip")
    (folder / "20230604121500.gkg.csv.zip").write_bytes(zipped(b"cut short" * 50)[:40])
    return str(folder)


def test_scan(spark, tmp_path):
    lines = A.archive_lines(A.read_archives(spark, land(tmp_path / "in"))).cache()
    good = A.well_formed(lines)
    assert {r.GKGRECORDID for r in good.collect()} == {"id0", "id3", "id4", "id5"}
    assert {r.n_fields for r in A.malformed(lines).collect()} == {26, 28}
    assert sorted(r.path[-26:-12] for r in A.unreadable(lines).collect()) == ["20230603121500", "20230604121500"]
    kept = C.theme_filter(good).collect()
    assert {r.GKGRECORDID for r in kept} == {"id0", "id4", "id5"}
    assert [r.SourceCommonName for r in kept if r.GKGRECORDID == "id5"] == ["caf�"]


def test_quoted_fields(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    # a quote at the start of a field swallows the separator and the line end
    text = record(0, V2Tone='"a') + "\n" + record(1, DATE='b"') + "\n" + record(2, Extras='"x\ty"') + "\n"
    (folder / "a.zip").write_bytes(zipped(text.encode()))
    archives = A.read_archives(spark, str(folder))
    plain = A.well_formed(A.archive_lines(archives))
    assert {r.GKGRECORDID for r in plain.collect()} == {"id0", "id1"}
    legacy = A.archive_lines(archives, legacy_quotes=True)
    assert [(r.GKGRECORDID, r.Extras) for r in A.well_formed(legacy).collect()] == [("id2", "x\ty")]


def test_plain_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "20230601121500.csv").write_text(record(0) + "\n" + record(1, 20) + "\n")
    lines = A.text_lines(spark, str(folder))
    assert [r.GKGRECORDID for r in A.well_formed(lines).collect()] == ["id0"]
    assert [r.n_fields for r in A.malformed(lines).collect()] == [20]


def test_raw_files_keep_every_character(spark, scratch):
    rows = [{"Extras": 'say "hi", then\nleave', "AllNames": " padded "}, {"Extras": "x" * 300_000},
            {"Extras": "back\\slash", "AllNames": '"'}]
    df = raw(spark, rows)
    for fmt in ("parquet", "csv"):
        FS.write_raw(df, scratch(fmt), fmt=fmt)
        back = FS.read_raw(spark, scratch(fmt), fmt).na.fill("").orderBy("GKGRECORDID").collect()
        assert [(r.Extras, r.AllNames, r.day) for r in back] == [
            (r["Extras"], r.get("AllNames", ""), "20230601") for r in rows], fmt


def test_append_adds_only_new_days(spark):
    from newsgraph.operators.manifest import append_new_days, rows_per_day
    have = raw(spark, [{"DATE": "20230601000000"}]).drop("_pos")
    more = raw(spark, [{"DATE": "20230601000000"}, {"DATE": "20230602000000"}]).drop("_pos")
    assert {(r.day, r.n) for r in rows_per_day(append_new_days(have, more)).collect()} == {
        ("20230601", 1), ("20230602", 1)}


def test_packed_files_do_not_grow_with_the_day(spark, tmp_path):
    """Many files for a large day, each below the stated size, and every record once on the way back."""
    from pyspark.sql import functions as F
    rows = raw(spark, [{"Extras": "x" * 200, "AllNames": f"n{i}"} for i in range(3_000)]).withColumn(
        "day", F.when(F.col("_pos") % 100 == 0, "20230602").when(F.col("_pos") != 7, "20230601"))
    files = A.pack_archives(rows, F.col("day"), file_bytes=20_000).cache()
    sizes = {}
    for r in files.collect():
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            assert z.getinfo("records.csv").file_size < 40_000
        assert r.name not in sizes and (r.name[:14].isdigit() or r.name.startswith("None"))
        sizes[r.name] = r.name[:8]
    assert list(sizes.values()).count("20230601") > 20
    assert A.land(files, str(tmp_path / "in")) == len(sizes)
    back = A.well_formed(A.archive_lines(A.read_archives(spark, str(tmp_path / "in"), "121500")))
    assert sorted(r.AllNames for r in back.collect()) == sorted(f"n{i}" for i in range(3_000))


def test_a_broken_part_takes_its_day_along(spark, tmp_path):
    """A resume reads all files of a failed day again, so none of them may have left records."""
    from newsgraph.plans import flows
    folder = tmp_path / "in"
    folder.mkdir()
    part = lambda i: zipped((record(i, V2Themes="INFO_HOAX,1", DATE="20230601121500") + "\n").encode())
    for i in range(3):
        (folder / f"20230601121500.{i:06d}.gkg.csv.zip").write_bytes(part(i) if i else b"broken")
    args = (spark, str(folder), str(tmp_path / "raw"), str(tmp_path / "log"), "2023-06-01", "2023-06-01")
    assert [(r.rows_matched, r.status) for r in flows.extract(*args).collect()] == [(0, "failed")]
    (folder / "20230601121500.000000.gkg.csv.zip").write_bytes(part(0))
    assert [(r.rows_matched, r.status) for r in flows.extract(*args, resume=True).collect()] == [(3, "ok")]
    assert sorted(r.GKGRECORDID for r in spark.read.parquet(str(tmp_path / "raw")).collect()) == ["id0", "id1", "id2"]
