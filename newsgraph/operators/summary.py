"""Theme, tone and profile summaries of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions.geo import unit_vector
from newsgraph.operators.quantiles import exact_quantiles
from newsgraph.session import cut_lineage


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def theme_counts(events: DataFrame, *by: str) -> DataFrame:
    """Events per theme, or per theme within ``by``. Counted in part before the shuffle."""
    return (events.select(*by, F.explode("Themes").alias("theme"))
            .groupBy(*by, "theme").agg(F.count(F.lit(1)).alias("count")))


def theme_frequency(events: DataFrame, top: int | None = 20) -> DataFrame:
    """Most frequent themes; equal counts come in code order."""
    counts = theme_counts(events).withColumnRenamed("theme", "Theme_Tokens")
    ordered = counts.orderBy(F.desc("count"), "Theme_Tokens")
    return ordered if top is None else ordered.limit(top)


def dominant_theme(events: DataFrame, by: str = "Country") -> DataFrame:
    """The most frequent theme per group; equal counts fall to the first code."""
    order = F.struct(-F.col("count"), F.col("theme"))
    best = theme_counts(events, by).groupBy(by).agg(
        F.min_by(F.struct("theme", "count"), order).alias("best"))
    return best.select(by, "best.theme", "best.count")


def dataset_profile(events: DataFrame, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return events.agg(
        F.count(F.lit(1)).alias("rows"),
        distinct("Country").alias("countries"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"))


def tone_histogram(events: DataFrame, low: float = -10.0, high: float = 10.0, bins: int = 20,
                   column: str = "Tone_Overall") -> DataFrame:
    """Events per equal-width bin; bin 0 lies below ``low`` and bin ``bins + 1`` at or above ``high``."""
    width = (high - low) / bins
    bin_of = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins))
    return (events.where(F.col(column).isNotNull()).groupBy(bin_of.cast("long").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(low) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"), "n"))


def tone_summary(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each tone column."""
    events = cut_lineage(events.select(*columns))
    quartiles = exact_quantiles(events, columns, [0.25, 0.5, 0.75])
    stats = events.agg(*[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("sd"),
                 F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns])
    rows = [F.struct(
        F.lit(c).alias("measure"), F.col(c)["n"].alias("n"),
        rounded(F.col(c)["mean"]).alias("mean"), rounded(F.col(c)["sd"]).alias("sd"),
        F.col(c)["min"].alias("min"),
        *[rounded(F.lit(q).cast("double")).alias(name)
          for name, q in zip(("q1", "median", "q3"), quartiles[c] or [None] * 3)],
        F.col(c)["max"].alias("max")) for c in columns]
    return stats.select(F.inline(F.array(*rows)))


def tone_by(events: DataFrame, by: str, column: str = "Tone_Overall") -> DataFrame:
    return events.groupBy(by).agg(
        F.count(column).alias("n"), rounded(F.avg(column)).alias("mean_tone"),
        rounded(F.stddev(column)).alias("sd_tone"))


def topic_tone(events: DataFrame, topics: DataFrame, key: str = "Record_ID", digits: int = 2) -> DataFrame:
    """Mean of four tone columns per topic label; events without a topic take no part.

    Means are rounded half to even after scaling, as data frames in Python do.
    """
    joined = events.join(topics.select(key, "Topic_Label"), key, "left")
    names = ["Tone_Overall", "Tone_Positive", "Tone_Negative", "Tone_Polarity"]
    return (joined.where(F.col("Topic_Label").isNotNull()).groupBy("Topic_Label")
            .agg(*[(F.rint(F.avg(c) * 10 ** digits) / 10 ** digits + 0.0).alias(c) for c in names]))


def country_totals(events: DataFrame) -> DataFrame:
    """Events, mean tone and mean position per country.

    The position is that of the mean direction from the centre of the Earth, so a
    country on both sides of the date line does not land on the far side of the globe.
    """
    x, y, z = unit_vector(F.col("Latitude"), F.col("Longitude"))
    return events.groupBy("Country").agg(
        F.count(F.lit(1)).alias("n_events"), rounded(F.avg("Tone_Overall")).alias("mean_tone"),
        F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.avg(z).alias("_z"),
    ).select("Country", "n_events", "mean_tone",
             rounded(F.degrees(F.atan2("_z", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2)))).alias("Latitude"),
             rounded(F.degrees(F.atan2("_y", "_x"))).alias("Longitude"))


def event_points(events: DataFrame) -> DataFrame:
    """Different coordinates with the number of events at each."""
    return (events.select((F.col("Latitude") + 0.0).alias("Latitude"),
                          (F.col("Longitude") + 0.0).alias("Longitude"))
            .groupBy("Latitude", "Longitude").agg(F.count(F.lit(1)).alias("n_events")))
