"""The stages from landed files to result tables, joined by folders.

Each stage reads what the one before has written, so it can be run again alone.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from newsgraph.operators import (
    clean as C, manifest as M, pages as PG, regress as R, spatial as SP, summary as S, topics as T,
)
from newsgraph.operators.panel import country_month_panel
from newsgraph.schema import CONTEXT_CODES, FILTER_CODES, MANIFEST_SCHEMA, REQUIRED_COLUMNS, TONE_COLUMNS
from newsgraph.session import cut_lineage, scratch_path, ship_package
from newsgraph.sources import archive as A, archive_source as AS, files as FS

ORDER = "path string, line_no long"
ORDER_COLUMNS = ["path", "line_no"]


def _present(read, *args) -> DataFrame | None:
    """What is stored, or None where nothing has been stored yet."""
    try:
        return read(*args)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def extract(spark: SparkSession, landing: str, raw: str, manifest: str, start: str, end: str,
            daily_time: str = "121500", codes: Sequence[str] = FILTER_CODES, resume: bool = False,
            legacy: bool = False, legacy_quotes: bool = False) -> DataFrame:
    """Matching records of one stamp per day into ``raw``; returns this run's manifest rows.

    Three writes follow each other: the records, one folder per file stamp; a note of the stamps
    whose records are complete; the manifest. A run may stop before, between or in any of them, and one
    with ``resume`` then leaves what a run without a stop leaves: folders without a note go, noted
    stamps that the manifest lacks get their row, and what is read again replaces its folder.

    With ``resume``, days are due that the manifest lacks, and those whose file was missing or
    broken, unless ``legacy``. A broken file gives no record. Rows count for the day of their
    file. ``legacy_quotes`` reads quotes in archives as quoting. A run that matches nothing warns.
    """
    ship_package(spark)
    span = spark.createDataFrame([(start, end)], "start string, end string")
    days = cut_lineage(M.sampled_days(span, daily_time=daily_time))
    rescued = None
    if resume:
        known = _present(lambda: FS.read_manifest(spark, manifest))
        noted = _present(lambda: FS.read_commits(spark, raw))
        if known is not None:
            days = M.days_to_do(days, known, legacy)
        if noted is not None:
            noted = cut_lineage(noted)
            rescued = cut_lineage(days.join(noted, "timestamp_queried").select(
                "date", "timestamp_queried", "source_url", "rows_matched", F.lit("ok").alias("status")))
            days = days.join(rescued.select("date"), "date", "left_anti")
        days = cut_lineage(days)
        # one stamp per day
        FS.drop_uncommitted(spark, raw, [r[0] for r in noted.select("timestamp_queried").collect()] if noted is not None else [])
    else:  # notes first: what has no note counts for nothing
        FS.drop_folder(spark, f"{raw}/_commits")
        FS.write_manifest(spark.createDataFrame([], MANIFEST_SCHEMA), manifest, "overwrite")
        FS.drop_folder(spark, raw)

    # one pass over the archives due: matches, and a row without fields per file, sound or broken
    due = [r[0] for r in days.select("timestamp_queried").collect()]  # one per day
    lines = AS.scan_archives(spark, landing, daily_time, legacy_quotes).where(F.col("stamp").isin(due))
    staged = scratch_path(spark, "matched")
    A.matching_or_marked(lines, codes, legacy_quotes).write.parquet(staged)
    found = spark.read.parquet(staged)
    matched = A.of_sound_files(found.where("state <> 'end'"))
    FS.write_raw_by_stamp(matched, raw, M.file_stamp(F.col("path")), ORDER_COLUMNS)

    marked = lambda state: found.where(F.col("state") == state).select(F.col("stamp").alias("timestamp_queried"))
    sound = marked("end").join(marked("broken"), "timestamp_queried", "left_anti")
    failed = days.join(sound, "timestamp_queried", "left_anti")
    rows = cut_lineage(M.extraction_manifest(days, matched, failed, F.substring(M.file_stamp(F.col("path")), 1, 8)))
    FS.write_commits(rows.where("status = 'ok'"), raw)
    rows = cut_lineage(rows.unionByName(rescued) if rescued is not None else rows)
    FS.write_manifest(rows, manifest, "append")
    if not rows.agg(F.sum("rows_matched")).first()[0]:
        warnings.warn(f"no record of {start} to {end} mentions a code", stacklevel=2)
    return rows


def repair(spark: SparkSession, raw: str, manifest: str, daily_time: str = "121500") -> DataFrame:
    """The manifest rewritten with what the raw records hold; failed days stay due."""
    records = FS.read_raw_by_stamp(spark, raw, ORDER)
    fixed = cut_lineage(M.repair_manifest(
        FS.read_manifest(spark, manifest), records, daily_time, day=F.substring(M.file_stamp(F.col("path")), 1, 8)))
    FS.write_manifest(fixed, manifest, "overwrite")
    return fixed


def pilot(spark: SparkSession, prepared: DataFrame, cleaned: str, sample: str, n: int = 50, seed: int = 42,
          required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """A prepared event table, checked, cleaned and sampled into two tables; returns the check."""
    gaps = cut_lineage(C.missing_columns(prepared, required))
    absent = [r["column"] for r in gaps.where("NOT present").collect()]
    if absent:
        raise ValueError(f"required columns are missing: {', '.join(absent)}")
    C.pilot_clean(prepared).write.mode("overwrite").parquet(cleaned)
    C.seeded_sample(spark.read.parquet(cleaned), n, seed).write.mode("overwrite").parquet(sample)
    return gaps


def clean(spark: SparkSession, raw: str, events: str, flat: str | None = None) -> DataFrame:
    """Raw records into ``events``, and as a flat file into ``flat``; returns the drop report.

    The report is observed by the pass that writes. A stage that ran again after a lost executor
    may count twice; the counts are held against the stored tables, whose sizes are in their
    footers, and records are judged again only where they differ.
    """
    records = FS.read_raw_by_stamp(spark, raw, ORDER)
    cleaned, judged, left = C.clean_observed(records, ORDER_COLUMNS)
    FS.write_events(cleaned, events)
    stored = FS.read_events(spark, events)
    if flat:
        FS.write_events(stored.select(*C.EVENT_COLUMNS), flat, fmt="csv")
    report = C.observed_report(judged.get, left.get)
    counts = dict(report)
    if counts["raw_rows"] != records.count() or counts["final_rows"] != stored.count():
        return C.drop_report(records)
    return spark.createDataFrame(report, "measure string, n long")


def collect_articles(spark: SparkSession, fetched: DataFrame, rules: DataFrame, articles: str,
                     manifest: str, limit: int = 0, resume: bool = False) -> DataFrame:
    """Landed fetches into article texts and a log of every attempt; returns the tallies."""
    rows = fetched
    attempts = _present(lambda: FS.read_fetch_manifest(spark, manifest)) if resume else None
    if attempts is not None:
        rows = M.records_to_do(rows, attempts, limit)
    elif limit:
        rows = rows.orderBy("_pos").limit(limit)
    staged = scratch_path(spark, "outcomes")
    PG.fetch_outcome(PG.with_permission(rows, rules)).write.parquet(staged)
    outcomes = spark.read.parquet(staged)
    mode = "append" if resume else "overwrite"
    FS.write_articles(PG.article_texts(outcomes), articles, mode)
    FS.write_fetch_manifest(PG.fetch_manifest(outcomes), manifest, mode)
    return PG.status_counts(PG.fetch_manifest(outcomes))


def topics(spark: SparkSession, articles: str, events: str, results: str, ks: Sequence[int] = (5, 10, 15),
           min_docs: int = 5, max_share: float = 0.5, max_terms: int = 10_000, iterations: int = 20) -> DataFrame:
    """Topics of the collected articles, met with their events; returns the tone per topic.

    Every event stays: one without text, or whose text has no term of the vocabulary, has no topic.
    """
    staged = scratch_path(spark, "tokens")
    T.tokens(FS.read_articles(spark, articles)).write.parquet(staged)
    docs = spark.read.parquet(staged)
    vocabulary = T.vocabulary(docs, min_docs, max_share, max_terms).orderBy("index")
    terms = [r["term"] for r in vocabulary.collect()]  # at most max_terms
    scores, model = T.select_k(docs, terms, ks, iterations=iterations)
    labels = T.dominant_topic(model, T.term_vectors(docs, terms)).select("Record_ID", "Topic_Label")
    labelled = cut_lineage(FS.read_events(spark, events).join(labels, "Record_ID", "left"))
    tone = S.topic_tone(labelled.drop("Topic_Label"), labelled.select("Record_ID", "Topic_Label"), "Record_ID")
    FS.export_results({"topic_vs_tone": tone, "topic_scores": scores, "topic_terms": T.topic_top_terms(model, terms),
                       "event_topics": labelled.select("Record_ID", "Topic_Label")}, results)
    return spark.read.parquet(f"{results}/topic_vs_tone.parquet")


def analyse(spark: SparkSession, events: str, results: str, eps_km: float = 200.0, min_samples: int = 10,
            top_themes: int = 20, context_codes: Mapping[str, Sequence[str]] = CONTEXT_CODES) -> None:
    """Theme, tone, space and panel tables of stored events, with the count models."""
    stored = FS.read_events(spark, events)
    points = cut_lineage(S.event_points(stored))
    panel = cut_lineage(country_month_panel(stored, codes=context_codes))
    tables = {
        "country_month_panel": panel,
        "theme_frequencies": S.theme_frequency(stored, top_themes),
        "dominant_themes": S.dominant_theme(stored),
        "tone_summary": S.tone_summary(stored, TONE_COLUMNS),
        "tone_by_country": S.tone_by(stored, "Country"),
        "tone_by_location_type": S.tone_by(stored, "Location_Type"),
        "clusters": SP.dbscan(points, eps_km, min_samples),
        "hotspots": SP.kde_hotspots(SP.kde_grid(points)),
    }
    units = cut_lineage(S.country_totals(stored))
    weights = cut_lineage(SP.nearest_weights(units))
    tables["morans_i"] = SP.morans_i(units, weights, "n_events").unionByName(
        SP.morans_i(units, weights, "mean_tone"))
    poisson = R.poisson(panel)
    tables["poisson_irr"] = R.irr_table(poisson, spark)
    tables["overdispersion"] = R.overdispersion(panel, poisson)
    tables["negative_binomial_irr"] = R.irr_table(R.negative_binomial(panel), spark)
    FS.export_results(tables, results)
