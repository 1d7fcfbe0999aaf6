"""Archive files: zip members of tab-separated records."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections.abc import Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgraph.functions.parse import mentions_any, text
from newsgraph.operators.manifest import file_stamp
from newsgraph.schema import RAW_COLUMNS

LINES_PER_BATCH = 10_000
#: Text of one packed file, about.
FILE_BYTES = 16 << 20


def read_archives(spark: SparkSession, path: str, daily_time: str | None = None) -> DataFrame:
    """Landed zip files as (path, content); one file is one row, split over tasks by size.

    ``daily_time`` (HHMMSS) keeps the files of that time of day; others are not
    even opened. Spark leaves files of no bytes out.
    """
    names = f"*{daily_time}.*zip" if daily_time else "*.zip"
    return (spark.read.format("binaryFile").option("pathGlobFilter", names)
            .option("recursiveFileLookup", True).load(path).select("path", "content"))


def _unzip(legacy_quotes: bool):
    def lines(batches):
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
                        reader = io.TextIOWrapper(member, encoding="utf-8", errors="replace",
                                                  newline="" if legacy_quotes else None)
                        rows = csv.reader(reader, delimiter="\t") if legacy_quotes else reader
                        yield from _chunks(path, rows, legacy_quotes)
                except (zipfile.BadZipFile, zlib.error, EOFError, IndexError, csv.Error,
                        RuntimeError, NotImplementedError):
                    yield pd.DataFrame({"path": [path], "line_no": [-1], "line": [None]})
    return lines


def _chunks(path, rows, split):
    held, start = [], 0
    for row in rows:
        # records parsed here travel with a separator that the text cannot hold
        held.append("\x1f".join(x.replace("\x1f", " ") for x in row) if split else row.rstrip("\n"))
        if len(held) == LINES_PER_BATCH:
            yield _frame(path, start, held)
            start, held = start + len(held), []
    if held:
        yield _frame(path, start, held)


def _frame(path, start, held):
    return pd.DataFrame({"path": path, "line_no": range(start, start + len(held)), "line": held})


def archive_lines(archives: DataFrame, legacy_quotes: bool = False) -> DataFrame:
    """(path, line_no, fields) for every line; an unreadable file gives one row with null fields."""
    lines = archives.select("path", "content").mapInPandas(
        _unzip(legacy_quotes), "path string, line_no long, line string")
    separator = "\x1f" if legacy_quotes else "\t"
    return lines.select("path", "line_no", F.split("line", separator, -1).alias("fields"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same for landed plain files, read in splits; a file's place in the order is its name."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        # grows along a block, as one task reads it from front to back
        F.monotonically_increasing_id().alias("line_no"),
        F.split("value", "\t", -1).alias("fields"))


def well_formed(lines: DataFrame) -> DataFrame:
    """Lines with 27 fields as named columns, with file and line as order."""
    order = [c for c in ("path", "block", "line_no") if c in lines.columns]
    return (lines.where(F.size("fields") == len(RAW_COLUMNS))
            .select(*order, *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(RAW_COLUMNS)]))


def malformed(lines: DataFrame) -> DataFrame:
    """Lines whose number of fields is not 27, with that number."""
    order = [c for c in ("path", "block", "line_no") if c in lines.columns]
    return (lines.where(F.col("fields").isNotNull() & (F.size("fields") != len(RAW_COLUMNS)))
            .select(*order, F.size("fields").cast("long").alias("n_fields"),
                    F.array_join("fields", "\t").alias("line")))


def _matching(lines: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Well-formed records that mention a code, and what has no fields, marked ``broken``."""
    named = lines.select("*", *[F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(RAW_COLUMNS)])
    broken = F.col("fields").isNull()
    match = (F.size("fields") == len(RAW_COLUMNS)) & mentions_any(
        text("Themes"), text("V2Themes"), list(codes))
    return named.where(broken | match).withColumn("broken", broken).drop("fields")


def matching_or_broken(lines: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Well-formed records that mention a code, and one row marked ``broken`` per unreadable file.

    A file may turn out broken after its first lines; ``of_sound_files`` drops those.
    """
    return _matching(lines, codes)


def matching_or_marked(scanned: DataFrame, codes: Sequence[str], legacy_quotes: bool = False) -> DataFrame:
    """The same for ``scan_archives``, with stamp and state: the last row of every file stays."""
    fields = F.split("line", "\x1f" if legacy_quotes else "\t", -1)
    found = _matching(scanned.select("path", "stamp", "line_no", "state", fields.alias("fields")), codes)
    return found.withColumn("broken", F.col("state") == "broken")


def file_set(path: Column) -> Column:
    """What stands or falls together: the files of one stamp, or a file whose name has none."""
    stamp = file_stamp(path)
    return F.when(stamp != "", stamp).otherwise(path)


def of_sound_files(found: DataFrame) -> DataFrame:
    """The records of files without a ``broken`` row: a broken file gives nothing.

    Neither do the other files of its stamp, as a resume reads them all again.
    """
    named = found.withColumn("_set", file_set(F.col("path")))
    return named.where("NOT broken").join(named.where("broken").select("_set").distinct(), "_set", "left_anti").drop("_set")


def unreadable(lines: DataFrame) -> DataFrame:
    """Files that could not be unzipped."""
    return lines.where("fields IS NULL").select("path")


def pack_archives(raw: DataFrame, day: Column, daily_time: str = "121500", row: str = "_pos",
                  file_bytes: int = FILE_BYTES) -> DataFrame:
    """Records as zip files, (name, content), of one ``day`` (yyyyMMdd) each: the inverse of the scan.

    A day has as many files as its text needs at ``file_bytes`` each, so no file grows with the
    data. They share the stamp of the day and differ in a part number behind it. ``row`` is a column
    without repeats; its hash deals the records out, so a task that runs again makes the same files.
    """
    def pack(group):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, z.open("records.csv", "w", force_zip64=True) as member:
            for x in group["line"]:
                member.write(f"{x}\n".encode())
        name = f"{group['day'].iloc[0]}{daily_time}.{group['part'].iloc[0]:06d}.gkg.csv.zip"
        return pd.DataFrame({"name": [name], "content": [out.getvalue()]})

    lines = raw.select(day.alias("day"), F.xxhash64(row).alias("hash"),
                       F.array_join(F.array(*RAW_COLUMNS), "\t", "").alias("line"))
    parts = lines.groupBy(F.col("day").alias("of")).agg(
        F.ceil(F.sum(F.octet_length("line") + 1) / file_bytes).alias("parts"))
    dealt = lines.join(parts, F.col("day").eqNullSafe(F.col("of"))).select(
        "day", F.pmod("hash", "parts").alias("part"), "line")
    return dealt.groupBy("day", "part").applyInPandas(pack, "name string, content binary")


def land(files: DataFrame, folder: str) -> int:
    """Writes each (name, content) row as a file of ``folder``, from the tasks; returns their number."""
    uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def write(batches):
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                with system.open_output_stream(f"{path}/{name}") as out:
                    out.write(bytes(content))
            yield batch[["name"]]

    return files.select("name", "content").mapInPandas(write, "name string").count()
