"""Landed archives as a Spark data source, for batch reads and streams.

An archive is unpacked while it is read: neither its bytes nor its text are ever held whole.
Conditions on ``stamp`` reach the file names, so files of other stamps are not opened.

Rows are (path, stamp, line_no, line, state). ``state`` is ``line`` for a line of a member; each
file ends in one row more, without a line: ``end`` if it could be read to its end, ``broken`` if not.
A file that turns out broken late has given lines before.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Sequence
from datetime import datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, LessThan, LessThanOrEqual,
)

NAME = "news_archives"
SCHEMA = "path string, stamp string, line_no long, line string, state string"
ARROW = pa.schema([("path", pa.string()), ("stamp", pa.string()), ("line_no", pa.int64()),
                   ("line", pa.string()), ("state", pa.string())])
#: Lines and characters of one batch.
BATCH_LINES, BATCH_CHARS = 2_000, 4 << 20
#: Archives smaller than this share a task, up to this size (packed) together.
TASK_BYTES = 4 << 20
#: What a damaged archive raises; the last is a place before its start. Errors of the store are not among them.
UNREADABLE = (zipfile.BadZipFile, zlib.error, EOFError, IndexError, csv.Error, RuntimeError, NotImplementedError,
              pa.ArrowInvalid)


class Archives(InputPartition):
    """The archives of one task."""

    def __init__(self, files: Sequence[tuple[str, str]]):
        self.files = list(files)


def _system(path: str):
    """(file system, path in it, what stands before such a path in names)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/"), "file:"
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.strip("/"), "file:"
    # the scheme Spark users write for the same store
    system, inner = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    at = path.find(inner.strip("/"))
    return system, inner.rstrip("/"), path[:at] if inner.startswith("/") is False else path[:at - 1]


def stamp_of(name: str) -> str:
    """As ``manifest.file_stamp``: the first 14 digits of a file's name, or nothing."""
    found = re.search(r"[0-9]{14}", name)
    return found.group() if found else ""


def landed_files(path: str, daily_time: str, wanted) -> list[tuple[str, str, int]]:
    """(path, stamp, size) of the zip files below ``path`` whose stamp is ``wanted``, by stamp and name."""
    system, inner, _ = _system(path)
    found = []
    for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
        stamp = stamp_of(info.base_name)
        if (info.type == fs.FileType.File and info.base_name.endswith("zip") and not info.base_name.startswith(("_", "."))
                and (not daily_time or stamp.endswith(daily_time)) and wanted(stamp)):
            found.append((info.path, stamp, info.size or 0))
    return sorted(found, key=lambda f: (f[1], f[0]))


def in_tasks(files: list[tuple[str, str, int]], task_bytes: int) -> list[Archives]:
    out, held, size = [], [], 0
    for path, stamp, n in files:
        if held and size + n > task_bytes:
            out.append(Archives(held))
            held, size = [], 0
        held.append((path, stamp))
        size += n
    return out + [Archives(held)] if held else out


def _batch(name, stamp, start, lines):
    n = len(lines)
    return pa.record_batch([pa.array([name] * n), pa.array([stamp] * n), pa.array(range(start, start + n), pa.int64()),
                            pa.array(lines, pa.string()), pa.array(["line"] * n)], schema=ARROW)


def unpacked(system, path: str, name: str, stamp: str, legacy_quotes: bool):
    """The batches of one archive, inflated as they are taken, and its last row."""
    csv.field_size_limit(2**31 - 1)
    held, chars, start, state = [], 0, 0, "end"
    try:
        with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z, z.open(z.namelist()[0]) as member:
            text = io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline="" if legacy_quotes else None)
            for row in csv.reader(text, delimiter="\t") if legacy_quotes else text:
                # records parsed here travel with a separator that the text cannot hold
                held.append("\x1f".join(x.replace("\x1f", " ") for x in row) if legacy_quotes else row.rstrip("\n"))
                chars += len(held[-1])
                if len(held) == BATCH_LINES or chars >= BATCH_CHARS:
                    yield _batch(name, stamp, start, held)
                    held, chars, start = [], 0, start + len(held)
    except UNREADABLE:
        state = "broken"
    if held:
        yield _batch(name, stamp, start, held)
    yield pa.record_batch([[name], [stamp], pa.array([-1], pa.int64()), pa.array([None], pa.string()), [state]], schema=ARROW)


class _Options:
    def __init__(self, options):
        self.path = options["path"]
        self.daily_time = options.get("dailyTime", "")
        self.legacy_quotes = options.get("legacyQuotes", "false").lower() == "true"
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.window_days = int(options.get("windowDays", 3))

    def read(self, partition: Archives):
        system, _, before = _system(self.path)
        for path, stamp in partition.files:
            yield from unpacked(system, path, before + path, stamp, self.legacy_quotes)


#: Conditions on a stamp that a file name can answer.
TESTS = {EqualTo: lambda s, v: s == v, In: lambda s, v: s in v, GreaterThan: lambda s, v: s > v,
         GreaterThanOrEqual: lambda s, v: s >= v, LessThan: lambda s, v: s < v, LessThanOrEqual: lambda s, v: s <= v}


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.options = _Options(options)
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and f.attribute == ("stamp",):
                self.tests.append((TESTS[type(f)], frozenset(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def partitions(self):
        o = self.options
        files = landed_files(o.path, o.daily_time, lambda s: all(test(s, v) for test, v in self.tests))
        return in_tasks(files, o.task_bytes) or [Archives([])]

    def read(self, partition):
        return self.options.read(partition)


class ArchiveStream(DataSourceStreamReader):
    """Archives as they land, each once.

    An offset is a stamp and the names of the files seen after it: ``windowDays`` before the
    newest stamp, so that a file may land that much later than its neighbours and is still read, while
    an offset holds the names of that window only. What lands later still is left to a batch resume.
    """

    def __init__(self, options):
        self.options = _Options(options)
        self.through = ""

    def initialOffset(self):
        return {"through": "", "seen": []}

    def latestOffset(self):
        # files up to the last border are settled, all newer ones are listed
        files = landed_files(self.options.path, self.options.daily_time, lambda s: s > self.through)
        if files:
            newest = datetime.strptime(files[-1][1][:8], "%Y%m%d") - timedelta(days=self.options.window_days)
            self.through = max(self.through, newest.strftime("%Y%m%d") + "000000")
        return {"through": self.through, "seen": [self._name(p) for p, s, _ in files if s > self.through]}

    def _name(self, path):
        return path[len(_system(self.options.path)[1]) + 1:]

    def partitions(self, start, end):
        self.through = max(self.through, start["through"])
        before, now = set(start["seen"]), set(end["seen"])
        files = landed_files(self.options.path, self.options.daily_time, lambda s: s > start["through"])
        due = [f for f in files if self._name(f[0]) not in before and (f[1] <= end["through"] or self._name(f[0]) in now)]
        return in_tasks(due, self.options.task_bytes) or [Archives([])]

    def read(self, partition):
        return self.options.read(partition)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)

    def streamReader(self, schema):
        return ArchiveStream(self.options)


def _options(reader, daily_time, legacy_quotes, extra):
    return (reader.format(NAME).option("dailyTime", daily_time or "").option("legacyQuotes", str(legacy_quotes).lower())
            .options(**extra))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def scan_archives(spark: SparkSession, path: str, daily_time: str | None = None, legacy_quotes: bool = False,
                  **options) -> DataFrame:
    """Lines of the archives below ``path``, (path, stamp, line_no, line, state).

    ``daily_time`` (HHMMSS) keeps the files of that time of day. A condition on ``stamp`` picks files by name.
    Files without 14 digits in their name have an empty stamp.
    """
    register(spark)
    return _options(spark.read, daily_time, legacy_quotes, options).load(path)


def stream_archives(spark: SparkSession, path: str, daily_time: str | None = None, legacy_quotes: bool = False,
                    **options) -> DataFrame:
    """The same as a stream; see ``ArchiveStream`` for files that land late (``windowDays``)."""
    register(spark)
    return _options(spark.readStream, daily_time, legacy_quotes, options).load(path)


def fields_of(lines: DataFrame, legacy_quotes: bool = False) -> DataFrame:
    """(path, line_no, fields) for every line, and for every broken file one row with null fields."""
    separator = "\x1f" if legacy_quotes else "\t"
    return lines.where("state <> 'end'").select("path", "line_no", F.split("line", separator, -1).alias("fields"))
