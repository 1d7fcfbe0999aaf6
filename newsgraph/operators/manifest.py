"""Which days were read, what they gave, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

URL_TEMPLATE = "https://archive.example.org/{ts}.gkg.csv.zip"


def source_url(ts: Column, template: str = URL_TEMPLATE) -> Column:
    before, after = template.split("{ts}")
    return F.concat(F.lit(before), ts, F.lit(after))


def sampled_days(span: DataFrame, start: str = "start", end: str = "end",
                 daily_time: str = "121500", template: str = URL_TEMPLATE) -> DataFrame:
    """One row per day of the inclusive ``[start, end]`` range held by each row of ``span``."""
    day = F.explode(F.sequence(F.col(start).cast("date"), F.col(end).cast("date"),
                               F.expr("interval 1 day"))).alias("day")
    days = span.select(day)
    stamp = F.concat(F.date_format("day", "yyyyMMdd"), F.lit(daily_time))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("date"),
                       stamp.alias("timestamp_queried"),
                       source_url(stamp, template).alias("source_url"))


def rows_per_day(raw: DataFrame, day: Column | None = None) -> DataFrame:
    """Records per day, by the first eight characters of DATE or by ``day`` (yyyyMMdd)."""
    day = F.substring("DATE", 1, 8) if day is None else day
    return raw.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def file_stamp(path: Column) -> Column:
    """The 14 digits in a file's name; its first eight are the day the file was queried for."""
    return F.regexp_extract(path, r"([0-9]{14})[^/]*$", 1)


def iso_day(day8: Column) -> Column:
    return F.concat_ws("-", F.substring(day8, 1, 4), F.substring(day8, 5, 2), F.substring(day8, 7, 2))


def extraction_manifest(days: DataFrame, matched: DataFrame, failed: DataFrame | None = None,
                        day: Column | None = None) -> DataFrame:
    """One row per sampled day with its matched rows, zero included.

    Rows belong to the day of their DATE, or to ``day``, as to that of the file they come from.
    With ``failed`` (a ``date`` column) the manifest also says whether the day
    was read, so that a resume can tell a failure from a true zero.
    """
    counts = rows_per_day(matched, day).select(iso_day(F.col("day")).alias("date"), "n")
    out = days.join(counts, "date", "left").select(
        *days.columns, F.coalesce("n", F.lit(0)).cast("long").alias("rows_matched"))
    if failed is None:
        return out
    # a day without a file, or with one that could not be read
    marks = failed.select("date").distinct().withColumn("_failed", F.lit(True))
    return out.join(marks, "date", "left").select(
        *out.columns, F.when(F.col("_failed"), "failed").otherwise("ok").alias("status"))


def days_to_do(days: DataFrame, manifest: DataFrame, legacy: bool = False) -> DataFrame:
    """Days not yet in the manifest. Failed days are due again unless ``legacy``."""
    done = manifest
    if not legacy and "status" in manifest.columns:
        done = manifest.where("status = 'ok'")
    return days.join(done.select("date"), "date", "left_anti")


def records_to_do(rows: DataFrame, attempts: DataFrame, limit: int = 0,
                  order: str = "_pos", key: str = "Record_ID") -> DataFrame:
    """Rows not yet attempted; a limit counts from the head of the input, before the skip."""
    head = rows.orderBy(order).limit(limit) if limit else rows
    return head.join(attempts.select(key), key, "left_anti")


def repair_manifest(manifest: DataFrame, raw: DataFrame, daily_time: str = "121500",
                    template: str = URL_TEMPLATE, day: Column | None = None) -> DataFrame:
    """Counts found in the raw records replace manifest entries; other days stay as they are.

    A ``status`` stays too, so failed days are still due; days found in the records are ok.
    """
    counts = rows_per_day(raw, day)
    status = [F.when(F.col("_n").isNotNull(), "ok").otherwise(F.col("status")).alias("status")] \
        if "status" in manifest.columns else []
    stamp = F.concat("day", F.lit(daily_time))
    found = counts.select(
        iso_day(F.col("day")).alias("date"), stamp.alias("_ts"),
        source_url(stamp, template).alias("_url"), F.col("n").alias("_n"))
    return manifest.join(found, "date", "full_outer").select(
        "date",
        F.coalesce("_ts", "timestamp_queried").alias("timestamp_queried"),
        F.coalesce("_url", "source_url").alias("source_url"),
        F.coalesce("_n", "rows_matched").alias("rows_matched"), *status,
    ).orderBy("date")


def append_new_days(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing records plus those of days not present yet, so no day counts twice."""
    have = existing.select(F.substring("DATE", 1, 8).alias("_day")).distinct()
    new = (incoming.withColumn("_day", F.substring("DATE", 1, 8))
           .join(have, "_day", "left_anti").drop("_day"))
    return existing.unionByName(new)
