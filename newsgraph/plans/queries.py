"""Named queries over the given tables: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.functions import parse as P
from newsgraph.functions.plan import once
from newsgraph.functions.text import paragraph_text, word_count
from newsgraph.operators import (
    clean as C, manifest as M, pages as PG, regress as R, spatial as SP, summary as S, topics as T,
)
from newsgraph.operators.panel import country_month_panel
from newsgraph.operators.summary import rounded
from newsgraph.plans import flows, views as V
from newsgraph.schema import FILTER_CODES, RAW_COLUMNS, TONE_COLUMNS
from newsgraph.session import cut_lineage, scratch_path
from newsgraph.sources import archive as A, archive_source as AS, files as FS
from newsgraph.streaming import feed as ST

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_events(V.gkg(spark, sf_dir))


def day_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day of ``events``."""
    return V.table(spark, sf_dir, "events").agg(
        F.min("ts").cast("date").alias("start"), F.max("ts").cast("date").alias("end"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived records with DATE on the event's own day, as a daily feed would have it."""
    own = V.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("_pos"), F.date_format("ts", "yyyyMMddHHmmss").alias("_own"))
    return V.gkg(spark, sf_dir).join(own, "_pos").withColumn("DATE", F.col("_own")).drop("_own")


# ---- scans, sources, sinks -------------------------------------------------

@query
def gkg_archive_scan(spark, sf_dir):
    folder = scratch_path(spark, "landing")
    A.land(A.pack_archives(V.gkg(spark, sf_dir), F.concat(F.lit("202306"), F.lpad(F.col("_pos") % 28 + 1, 2, "0"))), folder)
    kept = C.theme_filter(A.well_formed(AS.fields_of(AS.scan_archives(spark, folder, "121500"))))
    return kept.select("GKGRECORDID", "DATE", "SourceCommonName", "DocumentIdentifier",
                       "Themes", "V2Themes", "V2Locations", "V2Tone")


@query
def extract_resume(spark, sf_dir):
    """A broken archive mended before a resume, a run that stopped after its records, and a file with records of the day before."""
    folder, raw, log = (scratch_path(spark, n) for n in ("landing", "raw", "manifest"))
    span = day_span(spark, sf_dir).first()
    day = F.substring("DATE", 1, 8)
    # records of the 3rd lie in the file of the 4th
    file_day = F.when(F.substring("DATE", 7, 2) == "03", F.concat(F.substring("DATE", 1, 6), F.lit("04"))).otherwise(day)
    files = cut_lineage(A.pack_archives(feed(spark, sf_dir), file_day))
    middle = F.expr("cast(length(content) / 2 as int)")
    flipped = F.concat(F.substring("content", F.lit(1), middle), F.unhex(F.lit("0000000000")),
                       F.substring("content", middle + 6, F.length("content")))
    fifth = F.substring("name", 7, 2) == "05"
    A.land(files.withColumn("content", F.when(fifth, flipped).otherwise(F.col("content"))), folder)
    args = (spark, folder, raw, log, str(span.start), str(span.end))
    flows.extract(*args)
    mended = files.where(fifth)
    A.land(mended, folder)
    # a run that stopped right after it had written their records
    lines = A.archive_lines(mended.select(F.col("name").alias("path"), "content"))
    FS.write_raw_by_stamp(A.matching_or_broken(lines, FILTER_CODES), raw, M.file_stamp(F.col("path")), flows.ORDER_COLUMNS)
    flows.extract(*args, resume=True)
    held = FS.read_raw_by_stamp(spark, raw, flows.ORDER).select(
        M.iso_day(F.substring(M.file_stamp(F.col("path")), 1, 8)).alias("date"))
    latest = FS.read_manifest(spark, log).select("date", "rows_matched", "status")
    return latest.join(held.groupBy("date").agg(F.count(F.lit(1)).alias("raw_rows")), "date", "left").fillna(0, ["raw_rows"])


@query
def sampled_days(spark, sf_dir):
    return M.sampled_days(day_span(spark, sf_dir))


@query
def malformed_rows(spark, sf_dir):
    gkg = V.gkg(spark, sf_dir)
    fields = F.array(*RAW_COLUMNS)
    broken = (F.when(F.col("_pos") % 11 == 0, F.slice(fields, 1, 26))
              .when(F.col("_pos") % 13 == 0, F.array_append(fields, F.lit("extra")))
              .otherwise(fields))
    line = gkg.select(F.col("_pos").alias("line_no"), F.array_join(broken, "\t").alias("line"))
    lines = line.select("line_no", F.split("line", "\t", -1).alias("fields"))
    return A.malformed(lines).select("line_no", "n_fields")


@query
def raw_sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "raw")
    FS.write_raw(C.theme_filter(V.gkg(spark, sf_dir)), path)
    back = FS.read_raw(spark, path)
    return back.select("day", "GKGRECORDID", "DATE", "SourceCommonName", "DocumentIdentifier",
                       "Themes", "V2Themes", "V2Locations", "V2Tone")


@query
def raw_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "raw-csv")
    FS.write_raw(C.theme_filter(V.gkg(spark, sf_dir)), path, "overwrite", "csv")
    back = FS.read_raw(spark, path, "csv").na.fill("")
    return back.select("day", "GKGRECORDID", "DATE", "Themes", "V2Themes", "V2Locations", "V2Tone")


@query
def extraction_manifest(spark, sf_dir):
    days = M.sampled_days(day_span(spark, sf_dir))
    return M.extraction_manifest(days, C.theme_filter(feed(spark, sf_dir)))


@query
def clean_sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "events")
    FS.write_events(events_of(spark, sf_dir), path)
    back = FS.read_events(spark, path)
    return C.themes_text(back).select(
        "Record_ID", "Date", "Year_Month", "Country", "Latitude", "Longitude", "Themes", "Tone_Overall")


@query
def article_jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "articles")
    FS.write_articles(PG.article_texts(PG.fetch_outcome(V.fetch_rows(spark, sf_dir))), path)
    return FS.read_articles(spark, path)


@query
def fetch_manifest(spark, sf_dir):
    path = scratch_path(spark, "fetches")
    rows = PG.with_permission(V.fetch_rows(spark, sf_dir), V.robots_rules(spark))
    FS.write_fetch_manifest(PG.fetch_manifest(PG.fetch_outcome(rows)), path)
    return FS.read_fetch_manifest(spark, path).na.fill("")


@query
def export_results(spark, sf_dir):
    folder = scratch_path(spark, "results")
    panel = country_month_panel(events_of(spark, sf_dir), digits=6)
    FS.export_results({"country_month_panel": panel}, folder)
    return FS.read_csv(spark, f"{folder}/country_month_panel.csv", panel.schema).na.fill("")


# ---- projections, filters, predicates --------------------------------------

@query
def theme_filter(spark, sf_dir):
    return C.theme_filter(V.gkg(spark, sf_dir)).select("_pos", "GKGRECORDID", "Themes", "V2Themes")


@query
def theme_filter_token(spark, sf_dir):
    kept = C.theme_filter(V.gkg(spark, sf_dir), ["SURVEILLANCE", "ELECTION"], "token")
    return kept.select("_pos", "Themes", "V2Themes")


@query
def parse_date(spark, sf_dir):
    return V.gkg(spark, sf_dir).select("_pos", P.record_date(P.text("DATE")).alias("Date"))


@query
def parse_themes(spark, sf_dir):
    parsed = C.parse_events(V.gkg(spark, sf_dir), ["_pos"])
    return C.themes_text(parsed).select("_pos", "Themes", "Theme_Count")


@query
def parse_location(spark, sf_dir):
    return C.parse_events(V.gkg(spark, sf_dir), ["_pos"]).select(
        "_pos", "Country", "Location_Type", "Latitude", "Longitude")


@query
def parse_tone(spark, sf_dir):
    return C.parse_events(V.gkg(spark, sf_dir), ["_pos"]).select("_pos", *TONE_COLUMNS)


@query
def clean_events(spark, sf_dir):
    return C.themes_text(events_of(spark, sf_dir))


@query
def clean_drop_report(spark, sf_dir):
    return C.drop_report(V.gkg(spark, sf_dir))


@query
def calendar_fields(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return C.with_calendar(orders, "o_orderdate").drop("o_orderdate")


@query
def missing_columns(spark, sf_dir):
    gkg = V.gkg(spark, sf_dir).withColumn("V2Tone", F.when(F.col("V2Tone") != "", F.col("V2Tone")))
    return C.missing_columns(gkg, ["GKGRECORDID", "Themes", "V2Themes", "V2Locations", "V2Tone", "Country"])


@query
def median_impute(spark, sf_dir):
    tones = C.parse_events(V.gkg(spark, sf_dir), ["_pos"]).select("_pos", *TONE_COLUMNS)
    return C.impute_medians(cut_lineage(tones))  # parsed once for counts, quantiles and fill


@query
def country_standardise(spark, sf_dir):
    nation = V.table(spark, sf_dir, "nation").select(
        "n_nationkey", F.initcap("n_name").alias("Country"))
    return C.standardise_country(nation, {
        "United States": "USA", "United Kingdom": "UK", "Russia": "Russian Federation"})


def pilot_events(spark, sf_dir):
    parsed = C.parse_events(V.gkg(spark, sf_dir), ["_pos"])
    flag = F.when(F.col("_pos") % 10 == 3, 0).otherwise(1)
    themes = F.array_join("Themes", ";")
    return parsed.withColumns({"Misinfo_Flag": flag, "Themes": F.when(themes != "", themes)})


PILOT_OUT = ["Record_ID", "Date", "Year", "Month", "Year_Month", "Country", "Latitude",
             "Longitude", "Themes", "Misinfo_Flag", *TONE_COLUMNS]


@query
def pilot_clean(spark, sf_dir):
    return C.pilot_clean(pilot_events(spark, sf_dir)).select(*PILOT_OUT)


@query
def context_flags(spark, sf_dir):
    return C.context_flags(events_of(spark, sf_dir)).select(
        "Record_ID", "Political_Context", "Economic_Context", "Health_Context")


@query
def fetch_outcome(spark, sf_dir):
    return PG.fetch_outcome(V.fetch_rows(spark, sf_dir)).select(
        "Record_ID", "url", "status", "word_count", "reason")


@query
def q_paragraph_text(spark, sf_dir):
    pages = V.table(spark, sf_dir, "pages").select("page_id", "html")
    return pages.select("page_id", paragraph_text(F.col("html")).alias("text"))


@query
def q_word_count(spark, sf_dir):
    n = word_count(F.col("text"))
    return V.documents(spark, sf_dir).select("doc_id", once(n).alias("word_count")).withColumn(
        "long_enough", F.col("word_count") >= PG.MIN_WORDS)


@query
def robots_allowed(spark, sf_dir):
    """Page addresses as they are, with characters a strict parser refuses, and with a port."""
    pages = V.table(spark, sf_dir, "pages").selectExpr("page_id", """CASE page_id % 6
        WHEN 1 THEN concat(url, '|b') WHEN 2 THEN concat(url, ' c') WHEN 3 THEN concat(url, '{d}')
        WHEN 4 THEN concat('http://under_score.example.org/', page_id)
        WHEN 5 THEN regexp_replace(url, '^([a-z]+://[^/?#]*)', '$1:8080') ELSE url END AS url""")
    return PG.with_permission(pages, V.robots_rules(spark))


# ---- joins, resume, repair -------------------------------------------------

@query
def resume_days(spark, sf_dir):
    """Days of which the first half of the month was read, every fifth one without success."""
    days = M.sampled_days(day_span(spark, sf_dir))
    dom = F.substring("date", 9, 2).cast("int")
    done = days.where(dom <= 15).select(
        "date", F.when(dom % 5 == 0, "failed").otherwise("ok").alias("status"))
    return M.days_to_do(days, done)


@query
def resume_records(spark, sf_dir):
    """Documents without a label yet."""
    documents = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("Record_ID"))
    attempts = V.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("Record_ID"))
    return M.records_to_do(documents, attempts).select("Record_ID")


@query
def limit_then_resume(spark, sf_dir):
    rows = V.fetch_rows(spark, sf_dir)
    attempts = rows.where("http_status = 404 OR content_type = 'application/pdf'")
    return M.records_to_do(rows, attempts, limit=100).select("Record_ID", "url")


@query
def manifest_repair(spark, sf_dir):
    """A manifest with one too many row for even days and a day far outside the raw records."""
    days = M.sampled_days(day_span(spark, sf_dir))
    raw = C.theme_filter(feed(spark, sf_dir)).where(F.substring("DATE", 7, 2) > "10")
    stale = days.where(F.substring("date", 9, 2).cast("int") % 2 == 0)
    stale = stale.withColumn("status", F.when(F.substring("date", 9, 2) == "08", "failed").otherwise("ok"))
    return M.repair_manifest(stale.withColumn("rows_matched", F.lit(7).cast("long")), raw)


@query
def events_with_text(spark, sf_dir):
    """Events with the text of the document of their number; two in three have none or another's place."""
    texts = V.documents(spark, sf_dir).selectExpr("doc_id * 3 AS _pos", "text")
    valid = C.parse_events(V.gkg(spark, sf_dir).where(C.drop_reason().isNull()), ["_pos"])
    events = C.dedupe_first(valid, "Record_ID").select("_pos", "Record_ID")
    return PG.events_with_text(events, texts, "_pos").select(
        "Record_ID", F.col("text").isNotNull().alias("has_text"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def incremental_append(spark, sf_dir):
    """The first twenty days on disk, then the whole feed appended: no day doubles."""
    path = scratch_path(spark, "raw")
    all_rows = feed(spark, sf_dir).select(*RAW_COLUMNS)
    FS.write_raw(all_rows.where(F.substring("DATE", 7, 2) <= "20"), path, "overwrite")
    have = FS.read_raw(spark, path).select(*RAW_COLUMNS)
    return M.rows_per_day(M.append_new_days(have, all_rows))


# ---- aggregations ----------------------------------------------------------

@query
def rows_per_day(spark, sf_dir):
    return M.rows_per_day(V.gkg(spark, sf_dir))


@query
def fetch_status_counts(spark, sf_dir):
    rows = PG.with_permission(V.fetch_rows(spark, sf_dir), V.robots_rules(spark))
    return PG.status_counts(PG.fetch_manifest(PG.fetch_outcome(rows)), by_reason=True)


@query
def theme_frequency(spark, sf_dir):
    return S.theme_frequency(events_of(spark, sf_dir), 20)


@query
def dataset_profile(spark, sf_dir):
    return S.dataset_profile(events_of(spark, sf_dir))


@query
def dominant_theme_country(spark, sf_dir):
    return S.dominant_theme(events_of(spark, sf_dir))


@query
def tone_histogram(spark, sf_dir):
    """Bounds inside the range of the data, so both open bins are met."""
    return S.tone_histogram(events_of(spark, sf_dir), -5.0, 2.0, 14)


@query
def tone_summary(spark, sf_dir):
    return S.tone_summary(events_of(spark, sf_dir), TONE_COLUMNS)


@query
def tone_by_location_type(spark, sf_dir):
    return S.tone_by(events_of(spark, sf_dir), "Location_Type")


@query
def tone_by_country(spark, sf_dir):
    return S.tone_by(events_of(spark, sf_dir), "Country")


@query
def topic_tone(spark, sf_dir):
    """Every event meets a document by number; the topic follows from the document's source."""
    documents = V.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("_doc"),
        F.concat(F.lit("Topic "), F.ascii(F.substring("source", 4, 1)) % 5).alias("Topic_Label"))
    count = documents.agg((F.max("_doc") + 1).alias("n"))
    parsed = C.parse_events(V.gkg(spark, sf_dir), ["_pos"]).join(F.broadcast(count)).withColumn(
        "_doc", F.col("_pos") % F.col("n"))
    return S.topic_tone(parsed, documents, "_doc")


@query
def q_country_month_panel(spark, sf_dir):
    return country_month_panel(events_of(spark, sf_dir), digits=6)


@query
def country_month_panel_zero_fill(spark, sf_dir):
    """Of events with a single theme, few enough to leave cells empty."""
    rare = events_of(spark, sf_dir).where("Theme_Count = 1")
    return country_month_panel(rare, zero_fill=True, digits=6)


@query
def country_totals(spark, sf_dir):
    return S.country_totals(events_of(spark, sf_dir))


@query
def event_points(spark, sf_dir):
    return S.event_points(events_of(spark, sf_dir))


# ---- order and samples -----------------------------------------------------

@query
def dedupe_first(spark, sf_dir):
    return C.dedupe_first(V.gkg(spark, sf_dir), "GKGRECORDID").select("_pos", "GKGRECORDID")


@query
def pilot_sample(spark, sf_dir):
    return C.seeded_sample(C.pilot_clean(pilot_events(spark, sf_dir)), 50, 42).select(*PILOT_OUT)


# ---- space -----------------------------------------------------------------

EPS_KM = 170.0
MIN_SAMPLES = 120


def points_of(spark, sf_dir):
    return cut_lineage(S.event_points(events_of(spark, sf_dir)))


@query
def eps_neighbours(spark, sf_dir):
    pairs = SP.eps_neighbours(points_of(spark, sf_dir), 400.0)
    return pairs.withColumn("km", rounded(F.col("km")))


@query
def k_distance(spark, sf_dir):
    found = SP.k_distance(points_of(spark, sf_dir), 150)
    return found.withColumn("k_distance_km", rounded(F.col("k_distance_km")))


@query
def k_distance_curve(spark, sf_dir):
    curve = SP.k_distance_curve(SP.k_distance(points_of(spark, sf_dir), 150), 20)
    return curve.withColumn("k_distance_km", rounded(F.col("k_distance_km")))


@query
def dbscan(spark, sf_dir):
    return SP.dbscan(points_of(spark, sf_dir), EPS_KM, MIN_SAMPLES)


@query
def kde_grid(spark, sf_dir):
    grid = SP.kde_grid(points_of(spark, sf_dir), step_deg=3.0, bandwidth_km=250.0)
    return grid.withColumn("density", rounded(F.col("density") * 1e6)).where("density > 0")


@query
def kde_hotspots(spark, sf_dir):
    top = SP.kde_hotspots(SP.kde_grid(points_of(spark, sf_dir), step_deg=3.0, bandwidth_km=250.0), 10)
    return top.withColumn("density", rounded(F.col("density") * 1e6))


def units_of(spark, sf_dir):
    return cut_lineage(S.country_totals(events_of(spark, sf_dir).where("Country != ''")))


@query
def morans_i(spark, sf_dir):
    units = units_of(spark, sf_dir)
    weights = cut_lineage(SP.nearest_weights(units))
    return SP.morans_i(units, weights, "n_events").unionByName(
        SP.morans_i(units, weights, "mean_tone"))


@query
def morans_permutation(spark, sf_dir):
    units = units_of(spark, sf_dir)
    values = SP.morans_permutation(units, SP.nearest_weights(units), "n_events", 99)
    return values.select("perm", rounded(F.col("I")).alias("I"))


# ---- count regression ------------------------------------------------------

def panel_of(spark, sf_dir):
    """The panel with one 0/1 covariate, for which the fits have a closed form."""
    panel = country_month_panel(events_of(spark, sf_dir), digits=6)
    return cut_lineage(panel.withColumn("Mostly_Political", (F.col("Political_Prop") > 0.5).cast("int")))


ONE = ["Mostly_Political"]


@query
def poisson_fit(spark, sf_dir):
    fit = R.poisson(panel_of(spark, sf_dir), covariates=ONE)
    return R.fit_row(fit, spark).select("term", rounded(F.col("coef")).alias("coef"),
                                        rounded(F.col("se")).alias("se"))


def _scores(panel, fit, weight, digits=4):
    data = R.complete_cases(panel, R.OUTCOME, fit.terms[1:])
    sums = data.agg(*[F.round(F.sum(weight * (F.col(t) if i else F.lit(1.0))), digits).alias(t)
                      for i, t in enumerate(fit.terms)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), (F.col(t) + 0.0).alias("score"))
                                          for t in fit.terms])))


@query
def poisson_fit_full(spark, sf_dir):
    """Score equations of the fit: per term the sum of expected counts times the covariate."""
    panel = panel_of(spark, sf_dir)
    fit = R.poisson(panel)
    return _scores(panel, fit, R.mean_of(fit))


@query
def overdispersion(spark, sf_dir):
    panel = panel_of(spark, sf_dir)
    found = R.overdispersion(panel, R.poisson(panel, covariates=ONE))
    return found.select("n", "df", *[rounded(F.col(c)).alias(c) for c in (
        "pearson_chi2", "pearson_ratio", "variance_to_mean", "aux_alpha", "aux_t")])


@query
def negbin_fit(spark, sf_dir):
    fit = R.negative_binomial(panel_of(spark, sf_dir), covariates=ONE)
    return R.fit_row(fit, spark).select(
        "term", rounded(F.col("coef")).alias("coef"), rounded(F.col("se"), 5).alias("se"),
        rounded(F.col("alpha"), 5).alias("alpha"), "at_boundary",
        rounded(F.col("log_likelihood"), 5).alias("log_likelihood"))


@query
def negbin_fit_full(spark, sf_dir):
    """Score equations of the fit: residuals weighted by the variance it states sum to nothing."""
    panel = panel_of(spark, sf_dir)
    fit = R.negative_binomial(panel)
    mu = R.mean_of(fit)
    return _scores(panel, fit, (F.col("y") - mu) / (1 + fit.alpha * mu), 3)


@query
def irr_table(spark, sf_dir):
    return R.irr_table(R.poisson(panel_of(spark, sf_dir), covariates=ONE), spark)


# ---- topics ----------------------------------------------------------------

VOCABULARY = {"min_docs": 5, "max_share": 0.5, "max_terms": 2000}
TERM_SETS = {0: ["tion", "ing", "ble", "ther"], 1: ["thon", "thth", "than", "que", "absent"],
             2: ["ther", "thth", "erin", "anea", "des"]}


def tokens_of(spark, sf_dir):
    return T.tokens(V.documents(spark, sf_dir), "doc_id")


def landed_tokens(spark, sf_dir):
    """Tokens of all documents as a table, for jobs that read them many times."""
    path = scratch_path(spark, "tokens")
    tokens_of(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def terms_of(docs):
    """The vocabulary in index order; its size is bounded by ``max_terms``."""
    return [r["term"] for r in T.vocabulary(docs, **VOCABULARY).orderBy("index").collect()]


@query
def tokens(spark, sf_dir):
    return tokens_of(spark, sf_dir).select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n"))


@query
def lemmatised_tokens(spark, sf_dir):
    docs = landed_tokens(spark, sf_dir)
    forms = docs.select(F.explode("tokens").alias("form")).where("form LIKE '%ing'").distinct()
    lemmas = forms.withColumn("lemma", F.regexp_replace("form", "ing$", ""))
    return T.lemmatise(docs, lemmas, "doc_id").select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"))


@query
def vocabulary(spark, sf_dir):
    return T.vocabulary(landed_tokens(spark, sf_dir), **VOCABULARY)


@query
def doc_term_matrix(spark, sf_dir):
    docs = landed_tokens(spark, sf_dir)
    return T.doc_term_matrix(docs, T.vocabulary(docs, **VOCABULARY), "doc_id")


@query
def coherence_cv(spark, sf_dir):
    scores = T.coherence_cv(landed_tokens(spark, sf_dir), TERM_SETS, key="doc_id")
    return scores.withColumn("coherence", rounded(F.col("coherence")))


#: A number of passes and steps that does not depend on rounding, so that SQL can follow them.
LDA_FIT = {"iterations": 6, "inner": 5, "tolerance": 0.0}


def lda_of(spark, sf_dir, k=5):
    docs = landed_tokens(spark, sf_dir)
    terms = terms_of(docs)
    vectors = T.term_vectors(docs, terms).select("doc_id", "features")
    return T.fit_lda(vectors, k, **LDA_FIT), vectors, terms


@query
def lda_topics(spark, sf_dir):
    """The weight of every term in every topic."""
    model, _, terms = lda_of(spark, sf_dir)
    return T.topic_top_terms(model, terms, len(terms)).select("topic", "term", F.round("weight", 7).alias("weight"))


@query
def topic_top_terms(spark, sf_dir):
    model, _, terms = lda_of(spark, sf_dir)
    return T.topic_top_terms(model, terms, 10).withColumn("weight", F.round("weight", 7))


@query
def dominant_topic(spark, sf_dir):
    model, vectors, _ = lda_of(spark, sf_dir)
    found = T.dominant_topic(model, vectors, "doc_id")
    return found.withColumns({"share": F.round("share", 6), "total": F.round("total", 6)})


@query
def select_k(spark, sf_dir):
    """Coherence per number of topics, and which one is chosen."""
    docs = landed_tokens(spark, sf_dir)
    table, _ = T.select_k(docs, terms_of(docs), [2, 3, 5], key="doc_id")
    return table.withColumn("coherence", rounded(F.col("coherence")))


# ---- streams ---------------------------------------------------------------

DELAY = "60 days"  # longer than the month the events span: files land in any order


def land_events(spark, sf_dir, copies=False):
    """``events`` split into files; with ``copies`` every third event is delivered again."""
    path = scratch_path(spark, "landing")
    events = V.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    events.repartition(4, "event_id").write.parquet(path)
    if copies:
        events.where("event_id % 3 = 0").repartition(2, "event_id").write.mode("append").parquet(path)
    return path, events.schema


@query
def stream_ingest(spark, sf_dir):
    path, schema = land_events(spark, sf_dir)
    out, marks = scratch_path(spark, "ingested"), scratch_path(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        ST.ingest(ST.landed(spark, path, schema, files_per_batch=2), out, marks)
    return spark.read.parquet(out).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("ts").alias("last_ts"))


@query
def stream_archive_scan(spark, sf_dir):
    """Archives of the derived records in two deliveries, the later one with earlier days, and a restart between them."""
    folder, out, marks = (scratch_path(spark, n) for n in ("landing", "ingested", "progress"))
    number = F.col("_pos") % 28 + 1
    files = cut_lineage(A.pack_archives(V.gkg(spark, sf_dir), F.concat(F.lit("202306"), F.lpad(number, 2, "0"))))
    odd = F.substring("name", 7, 2).cast("int") % 2 == 1
    for part in (~odd, odd):
        A.land(files.where(part), folder)
        ST.ingest(ST.landed_archives(spark, folder, windowDays="31"), out, marks)
    return spark.read.parquet(out).select("GKGRECORDID", "DATE", "SourceCommonName", "DocumentIdentifier",
                                          "Themes", "V2Themes", "V2Locations", "V2Tone")


@query
def stream_daily_counts(spark, sf_dir):
    path, schema = land_events(spark, sf_dir)
    out = scratch_path(spark, "daily")
    stream = ST.landed(spark, path, schema, files_per_batch=2).withColumn("time", ST.utc(F.col("ts")))
    ST.drain(ST.daily_counts(stream, "time", DELAY), scratch_path(spark, "progress"),
             ST.upsert_by_batch(out), "update")
    return ST.latest(spark, out)


@query
def stream_dedupe(spark, sf_dir):
    path, schema = land_events(spark, sf_dir, copies=True)
    out = scratch_path(spark, "deduped")
    stream = ST.landed(spark, path, schema, files_per_batch=3).withColumn("time", ST.utc(F.col("ts")))
    ST.ingest(ST.deduped(stream, "event_id", "time", DELAY), out, scratch_path(spark, "progress"))
    return spark.read.parquet(out).select("event_id", "ts", "event_type")


@query
def stream_manifest(spark, sf_dir):
    path, schema = land_events(spark, sf_dir)
    out = scratch_path(spark, "manifest")
    ST.drain(ST.landed(spark, path, schema, files_per_batch=2), scratch_path(spark, "progress"),
             ST.manifest_sink(out, F.col("ts").cast("date").cast("string")))
    return ST.stream_manifest(spark, out)
