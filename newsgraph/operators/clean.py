"""Raw records to events: parse, drop with a reason, dedupe, impute, sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from newsgraph.functions import parse as P
from newsgraph.operators.quantiles import exact_quantiles
from newsgraph.schema import (
    CONTEXT_CODES, COUNTRY_ALIASES, FILTER_CODES, REQUIRED_COLUMNS, TONE_COLUMNS,
)
from newsgraph.session import cut_lineage

EVENT_COLUMNS = [
    "Record_ID", "Date", "Year", "Month", "Year_Month", "Source", "Source_URL",
    "Country", "Location_Type", "Latitude", "Longitude", "Themes", "Theme_Count",
    *TONE_COLUMNS,
]


def theme_filter(raw: DataFrame, codes: Sequence[str] = FILTER_CODES, mode: str = "substring",
                 ) -> DataFrame:
    """Keep records that mention a code, anywhere in the text or as a whole token."""
    v1, v2 = P.text("Themes"), P.text("V2Themes")
    if mode == "substring":
        return raw.where(P.mentions_any(v1, v2, list(codes)))
    if mode == "token":
        return raw.where(P.has_any_theme(P.theme_list(v2), list(codes))
                         | P.has_any_theme(P.theme_list(v1), list(codes)))
    raise ValueError(f"unknown mode {mode!r}")


def with_calendar(df: DataFrame, date: str = "Date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "Year": F.year(d), "Month": F.month(d), "Year_Month": P.year_month(d)})


def drop_reason() -> Column:
    """Why a raw record must go, or null: date first, then themes, then location."""
    themes = P.packed_themes(P.text("V2Themes"), P.text("Themes"))
    return (F.when(P.record_date(P.text("DATE")).isNull(), "bad_date")
            .when(~themes.rlike(P.THEMES_PRESENT), "no_themes")
            .when(~P.text("V2Locations").rlike(P.LOCATION_USABLE), "no_location"))


def parse_events(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Event columns of every raw record, usable or not."""
    parsed = raw.select(
        *keep,
        F.col("GKGRECORDID").alias("Record_ID"),
        P.record_date(P.text("DATE")).alias("Date"),
        F.col("SourceCommonName").alias("Source"),
        F.col("DocumentIdentifier").alias("Source_URL"),
        P.theme_list(P.packed_themes(P.text("V2Themes"), P.text("Themes"))).alias("Themes"),
        P.location_parts(P.text("V2Locations")).alias("_place"),
        P.tone_fields(P.text("V2Tone")).alias("_tone"),
    ).withColumns(P.coordinates(F.col("_place")))
    return parsed.withColumns({
        "Year": F.year("Date"), "Month": F.month("Date"),
        "Year_Month": P.year_month(F.col("Date")),
        **P.first_location(F.col("_place"), F.col("_lat"), F.col("_lon")),
        "Theme_Count": F.size("Themes"),
        **{name: P.tone_value(F.col("_tone"), i) for i, name in enumerate(TONE_COLUMNS)},
    }).select(*keep, *EVENT_COLUMNS)


def dedupe_first(df: DataFrame, key: str = "Record_ID", order: Sequence[str] = ("_pos",)) -> DataFrame:
    """The first row per key in ``order``.

    Spark limits each key to one row per task before the shuffle, so a key that
    holds a large share of all rows does not travel to one task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def clean_events(raw: DataFrame, order: Sequence[str] = ("_pos",)) -> DataFrame:
    """Valid records, one per Record_ID: invalid copies go before the choice is made."""
    valid = parse_events(raw.where(drop_reason().isNull()), keep=order)
    return dedupe_first(valid, "Record_ID", order).select(*EVENT_COLUMNS)


def drop_report(raw: DataFrame) -> DataFrame:
    """Rows read, dropped by reason, removed as copies, and left; one row per measure."""
    judged = raw.select(F.coalesce("GKGRECORDID", F.lit("")).alias("id"),
                        drop_reason().alias("reason"))
    kept = F.col("reason").isNull()
    totals = judged.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        *[F.count_if(F.col("reason") == r).alias(r)
          for r in ("bad_date", "no_themes", "no_location")],
        F.count_if(kept).alias("kept"),
        F.count_distinct(F.when(kept, F.col("id"))).alias("final_rows"),
    ).withColumn("duplicates", F.col("kept") - F.col("final_rows"))
    measures = ["raw_rows", "bad_date", "no_themes", "no_location", "duplicates", "final_rows"]
    return totals.select(F.stack(
        F.lit(len(measures)), *[x for m in measures for x in (F.lit(m), F.col(m))]
    ).alias("measure", "n"))


#: What a raw record needs to be judged and parsed.
RECORD_COLUMNS = ["GKGRECORDID", "DATE", "SourceCommonName", "DocumentIdentifier", "Themes", "V2Themes", "V2Locations", "V2Tone"]
REASONS = ["bad_date", "no_themes", "no_location"]


def clean_observed(raw: DataFrame, order: Sequence[str] = ("_pos",)) -> tuple[DataFrame, Observation, Observation]:
    """``clean_events`` with two observations, of records as judged and of events as left.

    They are filled while the events are written, so the report needs no pass of its own.
    """
    judged, left = Observation(), Observation()
    reason = F.col("_reason")
    seen = raw.select(*dict.fromkeys([*order, *RECORD_COLUMNS]), drop_reason().alias("_reason")).observe(
        judged, F.count(F.lit(1)).alias("raw_rows"), *[F.count_if(reason == r).alias(r) for r in REASONS],
        F.count_if(reason.isNull()).alias("kept"))
    valid = parse_events(seen.where(reason.isNull()), keep=order)
    events = dedupe_first(valid, "Record_ID", order).select(*EVENT_COLUMNS).observe(left, F.count(F.lit(1)).alias("final_rows"))
    return events, judged, left


def observed_report(judged: dict, left: dict) -> list[tuple[str, int]]:
    """The rows of ``drop_report`` from what was observed."""
    final = left["final_rows"]
    return [("raw_rows", judged["raw_rows"]), *[(r, judged[r]) for r in REASONS], ("duplicates", judged["kept"] - final),
            ("final_rows", final)]


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """(column, present, n_null, n_blank) per required column, over all rows.

    An absent column is null in every row; texts of nothing but blanks count as blank.
    """
    sums = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(required):
        value = F.col(c) if c in df.columns else F.lit(None).cast("string")
        sums += [F.count_if(value.isNull()).alias(f"n{i}"), F.count_if(F.btrim(value.cast("string")) == "").alias(f"b{i}")]
    one = df.agg(*sums)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in df.columns).alias("present"),
                              F.col(f"n{i}").alias("n_null"), F.col(f"b{i}").alias("n_blank"))
                     for i, c in enumerate(required)])
    return one.select(F.inline(rows))


def standardise_country(df: DataFrame, aliases: Mapping[str, str] = COUNTRY_ALIASES,
                        column: str = "Country") -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return df.withColumn(column, F.coalesce(F.try_element_at(names, F.col(column)), F.col(column)))


def impute_medians(df: DataFrame, columns: Sequence[str] = TONE_COLUMNS) -> DataFrame:
    """Fill gaps with the exact median of the column; columns not present are skipped."""
    present = [c for c in columns if c in df.columns]
    medians = {c: q[0] for c, q in exact_quantiles(df, present, [0.5]).items() if q is not None}
    return df.fillna(medians) if medians else df


def pilot_clean(df: DataFrame, order: Sequence[str] = ("_pos",)) -> DataFrame:
    """Dedupe, keep flagged rows, drop gaps, impute tone, standardise names, derive calendar."""
    out = dedupe_first(df, "Record_ID", order)
    if "Misinfo_Flag" in df.columns:
        out = out.where("Misinfo_Flag = 1")
    out = out.dropna(subset=["Latitude", "Longitude", "Themes"])
    out = impute_medians(cut_lineage(out))
    if "Country" in df.columns:
        out = standardise_country(out)
    return with_calendar(out) if "Date" in df.columns else out


def seeded_sample(df: DataFrame, n: int = 50, seed: int = 42, key: str = "Record_ID") -> DataFrame:
    """``n`` rows picked by a seeded hash of the key, sorted by key."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    return df.orderBy(mark, key).limit(n).orderBy(key)


def context_flags(events: DataFrame, codes: Mapping[str, Sequence[str]] = CONTEXT_CODES) -> DataFrame:
    """0/1 columns ``<name>_Context``: the event carries a theme of that set."""
    return events.withColumns({
        f"{name}_Context": P.has_any_theme(F.col("Themes"), list(found)).cast("int")
        for name, found in codes.items()})


def themes_text(events: DataFrame, separator: str = ";") -> DataFrame:
    """Theme arrays as one string, for flat files."""
    return events.withColumn("Themes", F.array_join("Themes", separator))
