"""Readers and writers of raw records, events, articles, manifests and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsgraph.operators.clean import themes_text
from newsgraph.schema import ARTICLE_SCHEMA, FETCH_SCHEMA, MANIFEST_SCHEMA, RAW_COLUMNS, RAW_SCHEMA

# comma CSV with doubled quotes, fields of any length, line ends kept inside quotes
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True,
               "maxCharsPerColumn": -1, "emptyValue": "", "nullValue": None,
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: StructType, line_ends: bool = True) -> DataFrame:
    """Without ``line_ends`` in fields, large files are read in splits."""
    options = {k: v for k, v in CSV_OPTIONS.items() if v is not None} | {"multiLine": line_ends}
    return spark.read.options(**options).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.options(header=True, quote='"', escape='"', emptyValue="",
                     ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                     ).mode(mode).csv(path)


def write_raw(raw: DataFrame, path: str, mode: str = "append", fmt: str = "parquet",
              order: Sequence[str] = ()) -> None:
    """Records unmodified, in one folder per day; ``order`` columns are kept beside them.

    The rebalance hint gives a day with much data several tasks and joins small
    days, so neither file sizes nor tasks follow the size of a day.
    """
    out = raw.select(*RAW_COLUMNS, *order).withColumn("day", F.substring("DATE", 1, 8))
    writer = out.hint("rebalance", F.col("day")).write.mode(mode).partitionBy("day")
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', emptyValue="",
                                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(fmt).save(path)


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", order: str = "") -> DataFrame:
    """Raw records by header name, with the folder's ``day`` for pruning.

    ``order`` declares extra columns, as in ``"path string, line_no long"``.
    """
    extra = StructType.fromDDL(order).fields if order else []
    schema = StructType([*RAW_SCHEMA.fields, *extra]).add("day", "string")
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def write_raw_by_stamp(raw: DataFrame, path: str, stamp: Column, order: Sequence[str] = ()) -> None:
    """Records in one folder per file stamp; those of the stamps at hand are replaced, others stay.

    So a write that is repeated after a stop leaves each record once.
    """
    out = raw.select(*RAW_COLUMNS, *order, F.substring("DATE", 1, 8).alias("day"), stamp.alias("stamp"))
    (out.hint("rebalance", F.col("stamp")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("stamp").parquet(path))


def read_raw_by_stamp(spark: SparkSession, path: str, order: str = "") -> DataFrame:
    """Raw records with their ``day`` and ``stamp``; a condition on ``stamp`` prunes folders."""
    extra = StructType.fromDDL(order).fields if order else []
    return spark.read.schema(StructType([*RAW_SCHEMA.fields, *extra]).add("day", "string").add("stamp", "string")).parquet(path)


COMMITS = "timestamp_queried string, rows_matched long"


def write_commits(commits: DataFrame, raw: str) -> None:
    """Notes that the records of these stamps are in ``raw``, all of them; beside them, where readers of records do not look."""
    commits.select("timestamp_queried", F.col("rows_matched").cast("long")).coalesce(1).write.mode("append").parquet(f"{raw}/_commits")


def read_commits(spark: SparkSession, raw: str) -> DataFrame:
    """Stamps whose records are in ``raw``; a repeated note counts once."""
    return (spark.read.schema(COMMITS).parquet(f"{raw}/_commits")
            .groupBy("timestamp_queried").agg(F.max("rows_matched").alias("rows_matched")))


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of this table, if it is there."""
    system, where = _folder(spark, path)
    system.delete(where, True)


def drop_uncommitted(spark: SparkSession, raw: str, committed: Sequence[str]) -> None:
    """Removes the folders of stamps that a run wrote and did not note: it stopped in between."""
    system, where = _folder(spark, raw)
    if not system.exists(where):
        return
    known = {f"stamp={s}" for s in committed}
    for status in system.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("stamp=") and name not in known:
            system.delete(status.getPath(), True)


def write_events(events: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Cleaned events, one folder per month; flat files get the themes as one string."""
    out = themes_text(events) if fmt == "csv" else events
    writer = out.hint("rebalance", F.col("Year_Month")).write.mode(mode).partitionBy("Year_Month")
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"', emptyValue="")
    writer.format(fmt).save(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    # folder names may be read back as dates
    return df.withColumn("Year_Month", F.substring(F.col("Year_Month").cast("string"), 1, 7))


def write_articles(articles: DataFrame, path: str, mode: str = "overwrite") -> None:
    articles.select(*ARTICLE_SCHEMA.names).write.mode(mode).json(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One text per record: an append that was repeated after a stop counts once."""
    return spark.read.schema(ARTICLE_SCHEMA).json(path).groupBy("Record_ID").agg(F.max("text").alias("text"))


def write_fetch_manifest(manifest: DataFrame, path: str, mode: str = "append") -> None:
    write_csv(manifest.select(*FETCH_SCHEMA.names), path, mode)


def read_fetch_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, FETCH_SCHEMA)


def write_manifest(manifest: DataFrame, path: str, mode: str = "append") -> None:
    write_csv(manifest.select(*MANIFEST_SCHEMA.names), path, mode)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per date, the newest: a day that was mended has a row for each run that tried it."""
    values = [c for c in MANIFEST_SCHEMA.names if c != "date"]
    rows = read_csv(spark, path, MANIFEST_SCHEMA, line_ends=False).select(
        "*", F.struct("_metadata.file_modification_time", "_metadata.file_name").alias("_written"))
    return rows.groupBy("date").agg(F.max_by(F.struct(*values), "_written").alias("v")).select("date", "v.*")


def export_results(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Every result table as Parquet and as CSV."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        write_csv(df.sparkSession.read.parquet(f"{folder}/{name}.parquet"), f"{folder}/{name}.csv")
