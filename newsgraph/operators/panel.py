"""Country x month panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsgraph.operators.clean import context_flags


def country_month_panel(events: DataFrame, codes=None, zero_fill: bool = False,
                        digits: int | None = None) -> DataFrame:
    """Event count, share of events per context, mean tone and number of sources per cell.

    Cells without events are absent; ``zero_fill`` adds them between the first
    and the last month seen, with a count of zero.
    """
    flagged = context_flags(events, codes) if codes is not None else context_flags(events)
    names = [c for c in flagged.columns if c.endswith("_Context")]

    def mean(c):
        m = F.avg(c)
        return m if digits is None else F.round(m, digits) + F.lit(0.0)

    panel = flagged.groupBy("Country", "Year_Month").agg(
        F.count(F.lit(1)).alias("Misinfo_Event_Count"),
        *[mean(c).alias(c.replace("_Context", "_Prop")) for c in names],
        mean("Tone_Overall").alias("Tone_Overall_Mean"),
        F.count_distinct("Source").alias("Source_Diversity"),
    )
    return _with_empty_cells(panel) if zero_fill else panel


def _with_empty_cells(panel: DataFrame) -> DataFrame:
    span = panel.agg(F.min("Year_Month").alias("a"), F.max("Year_Month").alias("b")).first()
    if span.a is None:
        return panel
    months = F.sequence(F.lit(f"{span.a}-01").cast("date"), F.lit(f"{span.b}-01").cast("date"),
                        F.expr("interval 1 month"))
    cells = (panel.select("Country").distinct()
             .select("Country", F.explode(months).alias("_month"))
             .select("Country", F.date_format("_month", "yyyy-MM").alias("Year_Month")))
    return (cells.join(panel, ["Country", "Year_Month"], "left")
            .fillna(0, subset=["Misinfo_Event_Count", "Source_Diversity"])
            .select(*panel.columns))
