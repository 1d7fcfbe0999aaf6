"""The feed as streams: ingest, dedupe, daily counts, manifest.

Every job keeps its progress in a checkpoint folder and drains what has landed
(``availableNow``), so a restart goes on where the last run stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from newsgraph.operators.clean import theme_filter
from newsgraph.sources.archive import well_formed
from newsgraph.sources.archive_source import fields_of, stream_archives
from newsgraph.streaming.deltas import BATCH, COMPACT_EVERY, DeltaTable

def landed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
           files_per_batch: int | None = None, **options) -> DataFrame:
    """A stream over files as they land; ``files_per_batch`` bounds a batch."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def landed_archives(spark: SparkSession, path: str, daily_time: str | None = "121500",
                    codes: list[str] | None = None, **options) -> DataFrame:
    """Matching records of zip archives as they land, with path and line as order.

    ``daily_time`` keeps the files of each day whose name carries that time; others are not opened.
    ``windowDays`` says how many days a file may land after a newer one.
    """
    lines = well_formed(fields_of(stream_archives(spark, path, daily_time, **options)))
    return theme_filter(lines, codes) if codes else theme_filter(lines)


def utc(c: Column) -> Column:
    """TIMESTAMP_NTZ read as UTC, whatever the session zone; watermarks need this type."""
    return F.concat(c.cast("string"), F.lit("Z")).cast("timestamp")


def utc_day(c: Column) -> Column:
    days = F.floor(F.unix_seconds(c) / 86400).cast("int")
    return F.date_from_unix_date(days).cast("string")


def drain(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None],
          mode: str = "append") -> StreamingQuery:
    """Processes all that has landed, batch by batch, and returns the finished query."""
    run = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).foreachBatch(write).start())
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return run


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends every landed row once; the sink's log makes replayed batches harmless."""
    run = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(out))
    run.awaitTermination()
    return run


def deduped(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """First arrival per key; copies count as such within ``delay`` of each other.

    Copies must be equal, as arrival order decides which one stays. State older
    than the delay is dropped.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows per UTC day. Rows later than ``delay`` are dropped with the day's state."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"))
            .agg(F.count(F.lit(1)).alias("n")).select(utc_day(F.col("window.start")).alias("day"), "n"))


def upsert_by_batch(out: str, key: str = "day", compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """A sink for update mode that keeps the newest row per key; a replayed batch changes nothing."""
    return DeltaTable(out, lambda rows: _newest(rows, key), compact_every).write


def _newest(rows: DataFrame, key: str) -> DataFrame:
    values = [c for c in rows.columns if c != key]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*values), BATCH).alias("v"))
            .select(key, *[F.col(f"v.{c}") for c in values]))


def latest(spark: SparkSession, out: str, key: str = "day") -> DataFrame:
    """Newest value per key of a stream in update mode."""
    return _newest(DeltaTable(out).read(spark), key).drop(BATCH)


def manifest_sink(out: str, day: Column, compact_every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """Adds up the rows of each batch by day; a replayed batch changes nothing."""
    table = DeltaTable(out, lambda rows: rows.groupBy("day").agg(F.sum("n").alias("n"), F.max(BATCH).alias(BATCH)), compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")), batch_id)
    return write


def stream_manifest(spark: SparkSession, out: str) -> DataFrame:
    """Rows per day over all batches so far."""
    return DeltaTable(out).read(spark).groupBy("day").agg(F.sum("n").alias("n"))
