"""SQL counterparts of the named queries, for an independent engine."""

from __future__ import annotations

from html.entities import name2codepoint

from newsgraph.functions.text import PADDED_DECIMAL, SPACE_CLASS
from newsgraph.operators import pages as PG
from newsgraph.operators.manifest import URL_TEMPLATE
from newsgraph.plans.views import ROBOTS_RULES, VIEW_CODES
from newsgraph.schema import (
    CONTEXT_CODES, COUNTRY_ALIASES, FILTER_CODES, RAW_COLUMNS, TONE_COLUMNS,
)


MEAN_LATITUDE = """round(degrees(atan2(avg(sin(radians(Latitude))),
    sqrt(power(avg(cos(radians(Latitude)) * cos(radians(Longitude))), 2)
         + power(avg(cos(radians(Latitude)) * sin(radians(Longitude))), 2)))), 6)"""
MEAN_LONGITUDE = """round(degrees(atan2(avg(cos(radians(Latitude)) * sin(radians(Longitude))),
    avg(cos(radians(Latitude)) * cos(radians(Longitude))))), 6)"""


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listing(codes) -> str:
    return "[" + ", ".join(map(quote, codes)) + "]"


def code(x: str) -> str:
    return f"codes[(({x}) % {len(VIEW_CODES)}) + 1]"


GKG_TEXT = {
    "GKGRECORDID": "strftime(t, '%Y%m%d') || '121500-' || k",
    "DATE": "CASE WHEN id % 37 = 0 THEN 'bad' ELSE strftime(t, '%Y%m%d%H%M%S') END",
    "SourceCommonName": "src",
    "DocumentIdentifier": "'https://' || src || '/' || event_type || '/' || id",
    "Themes": f"CASE WHEN id % 23 = 0 THEN {code('id')} ELSE '' END",
    "V2Themes": f"""CASE WHEN id % 41 = 0 OR id % 23 = 0 THEN '' WHEN id % 43 = 0 THEN ';;'
        ELSE {code('7 * id')} || ',12;' || {code('5 * id + user_id')} || ',240; '
             || {code('user_id')} || ',391;' END""",
    "V2Locations": """CASE WHEN id % 53 = 0 THEN ''
        WHEN id % 29 = 0 THEN '1#' || n_name || '#XX##10.5'
        WHEN id % 31 = 0 THEN '4#City, ' || n_name || '#XX#XX01#n/a#20.5#1'
        WHEN id % 47 = 0 THEN '3#City, #XX#XX01#10.5#20.5#1'
        WHEN id % 3 = 0 THEN '1#' || n_name || '#XX##' || (4 * nk - 48) || '.25#'
             || (13 * nk - 160) || '.5#F'
        ELSE '4#City' || (id % 4) || ', State, ' || n_name || '#XX#XX01#'
             || (4 * nk - 48 + id % 4) || '.75#' || (13 * nk - 160 + id % 4)
             || '.125#77;1#Elsewhere#YY##1#2#3' END""",
    "V2Tone": """CASE WHEN id % 59 = 0 THEN '' WHEN id % 61 = 0 THEN '1.5,2.5,3'
        WHEN id % 67 = 0 THEN '1.5,x,3,4,5,6,100' WHEN id % 71 = 0 THEN '-1.5,,3,4,5,6,100'
        ELSE (id % 13 - 9) || '.25,' || (id % 5) || '.5,' || (id % 7 + 1) || '.125,'
             || (id % 5 + id % 7 + 1) || '.625,' || (user_id % 20) || '.0,' || (user_id % 4)
             || '.75,' || (200 + id % 500) END""",
}

GKG = f"""
base AS (
    SELECT event_id AS id, user_id, event_type, n_name, n_nationkey AS nk, ts,
           CASE WHEN event_id % 20 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS k
    FROM events JOIN nation ON n_nationkey = user_id % 25),
dated AS (
    SELECT *, ts + to_months(CAST(k % 24 AS INTEGER)) AS t,
           'src' || (user_id % 17) || '.example.com' AS src, {listing(VIEW_CODES)} AS codes
    FROM base),
gkg AS (
    SELECT id AS _pos, CAST(ts AS DATE) AS own_day, strftime(ts, '%Y%m%d%H%M%S') AS own_stamp,
           {", ".join(f"{GKG_TEXT.get(c, quote(''))} AS {c}" for c in RAW_COLUMNS)}
    FROM dated)"""

# white space as text, for trimming
SPACES = "||".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13, 160))
SUBSTRING_HIT = "regexp_matches(Themes || ';' || V2Themes, " + quote("|".join(FILTER_CODES)) + ")"


def number(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, {quote(PADDED_DECIMAL)}) THEN CAST(trim({x}) AS DOUBLE) END"


TONES = ", ".join(
    f"CASE WHEN tone_ok THEN {number(f'tone[{i + 1}]')} END AS {name}"
    for i, name in enumerate(TONE_COLUMNS))

PARSED = GKG + f""",
split_up AS (
    SELECT *,
        CASE WHEN regexp_matches(left(DATE, 14), '^[0-9]{{14}}$')
             THEN try_strptime(left(DATE, 14), '%Y%m%d%H%M%S') END AS day,
        list_filter(list_transform(
            string_split(CASE WHEN V2Themes <> '' THEN V2Themes ELSE Themes END, ';'),
            lambda c: trim(split_part(c, ',', 1), {SPACES})), lambda c: c <> '') AS tokens,
        string_split(split_part(V2Locations, ';', 1), '#') AS place,
        string_split(V2Tone, ',') AS tone
    FROM gkg),
measured AS (
    SELECT *, {number('place[5]')} AS lat, {number('place[6]')} AS lon,
        len(tone) >= 6 AND len(list_filter(tone[1:6], lambda x:
            x <> '' AND NOT regexp_full_match(x, {quote(PADDED_DECIMAL)}))) = 0 AS tone_ok
    FROM split_up),
parsed AS (
    SELECT _pos, own_day, GKGRECORDID AS Record_ID, day AS Date,
        CAST(year(day) AS INTEGER) AS Year, CAST(month(day) AS INTEGER) AS Month,
        strftime(day, '%Y-%m') AS Year_Month,
        SourceCommonName AS Source, DocumentIdentifier AS Source_URL,
        CASE WHEN len(place) >= 6 AND place[2] <> '' THEN
            CASE WHEN place[1] = '1' THEN trim(place[2], {SPACES})
                 ELSE trim(string_split(place[2], ',')[-1], {SPACES}) END END AS Country,
        CASE WHEN len(place) >= 6 THEN place[1] END AS Location_Type,
        CASE WHEN len(place) >= 6 AND (place[5] = '' OR lat IS NOT NULL)
              AND (place[6] = '' OR lon IS NOT NULL) THEN lat END AS Latitude,
        CASE WHEN len(place) >= 6 AND (place[5] = '' OR lat IS NOT NULL)
              AND (place[6] = '' OR lon IS NOT NULL) THEN lon END AS Longitude,
        list_filter(tokens, lambda c, i: list_position(tokens, c) = i) AS theme_list,
        {TONES}
    FROM measured),
judged AS (
    SELECT *, array_to_string(theme_list, ';') AS Themes,
        CAST(len(theme_list) AS INTEGER) AS Theme_Count,
        CASE WHEN Date IS NULL THEN 'bad_date' WHEN len(theme_list) = 0 THEN 'no_themes'
             WHEN Latitude IS NULL OR Longitude IS NULL OR Country IS NULL THEN 'no_location'
        END AS reason
    FROM parsed)"""

CLEAN = PARSED + """,
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY Record_ID ORDER BY _pos) AS copy
    FROM judged WHERE reason IS NULL),
clean AS (SELECT * EXCLUDE (copy, reason) FROM ranked WHERE copy = 1)"""

EVENT_OUT = ", ".join([
    "Record_ID", "Date", "Year", "Month", "Year_Month", "Source", "Source_URL", "Country",
    "Location_Type", "Latitude", "Longitude", "Themes", "Theme_Count", *TONE_COLUMNS])

FLAGGED = CLEAN + """,
flagged AS (
    SELECT *, """ + ", ".join(
    f"CAST(list_has_any(theme_list, {listing(codes)}) AS INTEGER) AS {name}_Context"
    for name, codes in CONTEXT_CODES.items()) + """
    FROM clean)"""

PANEL = FLAGGED + """,
panel AS (
    SELECT Country, Year_Month, count(*) AS Misinfo_Event_Count,
        round(avg(Political_Context), 6) AS Political_Prop,
        round(avg(Economic_Context), 6) AS Economic_Prop,
        round(avg(Health_Context), 6) AS Health_Prop,
        round(avg(Tone_Overall), 6) + 0.0 AS Tone_Overall_Mean,
        count(DISTINCT Source) AS Source_Diversity
    FROM flagged GROUP BY ALL)"""

DAYS = f"""
span AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events),
days AS (
    SELECT strftime(d, '%Y-%m-%d') AS date, strftime(d, '%Y%m%d') || '121500' AS timestamp_queried,
        replace({quote(URL_TEMPLATE)}, '{{ts}}', strftime(d, '%Y%m%d') || '121500') AS source_url
    FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP),
                                        INTERVAL 1 DAY)) AS d FROM span))"""

RULES = "rules(host, allow, prefix) AS (VALUES " + ", ".join(
    f"({quote(h)}, {str(a).lower()}, {quote(p)})" for h, a, p in ROBOTS_RULES) + ")"


# written out anew, so that a slip in the implementation's own patterns shows
SCRIPTS = (r"(?is)<(?:script[ \t\n\r\f>].*?(?:</script[^>]*>|\z)|style[ \t\n\r\f>].*?(?:</style[^>]*>|\z)"
           r"|!--.*?(?:-->|\z))")
GAPS = r"(?is)</p[ \t\n\r\f]*>.*?(<p[ \t\n\r\f>/]|\z)"
MARKUP = r"</?[a-zA-Z][^>]*>|<[!?][^>]*>"
NAMES = "map([" + ", ".join(map(quote, [*name2codepoint, "apos"])) + "], [" + ", ".join(
    f"chr({c})" for c in [*name2codepoint.values(), 39]) + "])"


def undo_entities(x: str) -> str:
    """Entities found one by one; what comes out is not looked at again."""
    name = "regexp_extract(p, '^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);', 1)"
    number = (f"CASE WHEN {name} LIKE '#x%' OR {name} LIKE '#X%' THEN CAST('0x' || {name}[3:] AS BIGINT) "
              f"WHEN {name} LIKE '#%' THEN CAST({name}[2:] AS BIGINT) END")
    char = (f"CASE WHEN {name} LIKE '#%' THEN CASE WHEN {number} BETWEEN 1 AND 1114111 AND NOT {number} BETWEEN 55296 AND 57343 "
            f"THEN chr(CAST({number} AS INTEGER)) ELSE chr(65533) END ELSE ({NAMES})[{name}] END")
    whole = f"coalesce({char} || p[length({name}) + 2:], '&' || p)"
    return (f"(string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], "
            f"lambda p: {whole}), ''))")


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, {quote(f'[{SPACE_CLASS}]+')}, ' ', 'g'), ' ')"


def extracted(html: str) -> str:
    shown = f"regexp_replace({html}, {quote(SCRIPTS)}, ' ', 'g')"
    inside = f"regexp_replace('</p>' || {shown}, {quote(GAPS)}, ' \\1', 'g')"
    return squeezed(undo_entities(f"regexp_replace({inside}, {quote(MARKUP)}, ' ', 'g')"))


def words(x: str) -> str:
    return f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


FETCHES = f"""
fetches AS (
    SELECT page_id AS _pos, CAST(page_id AS VARCHAR) AS Record_ID,
        CASE WHEN page_id % 29 = 0 THEN '' ELSE url END AS url,
        CASE WHEN page_id % 23 = 0 THEN 'timed out' END AS fetch_error,
        CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS http_status,
        CASE WHEN page_id % 19 = 0 THEN 'application/pdf'
             ELSE 'text/html; charset=utf-8' END AS content_type,
        html
    FROM pages)"""


def located(source: str) -> str:
    return f"""
targets AS (
    SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
        regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS target
    FROM {source}),
permitted AS (
    SELECT t.* EXCLUDE (host, target),
        coalesce((SELECT arg_max(r.allow, length(r.prefix) * 2 + CAST(r.allow AS INTEGER))
                  FROM rules r WHERE r.host = t.host AND starts_with(t.target, r.prefix)),
                 true) AS allowed
    FROM targets t)"""


def outcomes(source: str, allowed: str) -> str:
    return f"""
texts AS (SELECT *, {extracted('html')} AS body FROM {source}),
counted AS (SELECT *, CAST({words('body')} AS BIGINT) AS n FROM texts),
outcome AS (
    SELECT _pos, Record_ID, url,
        CASE WHEN url = '' THEN 'error' WHEN NOT {allowed} THEN 'disallowed'
             WHEN fetch_error IS NOT NULL OR http_status <> 200
               OR content_type NOT LIKE '%html%' OR n < 50 THEN 'error' ELSE 'ok' END AS status,
        CASE WHEN url = '' OR NOT {allowed} OR fetch_error IS NOT NULL OR http_status <> 200
               OR content_type NOT LIKE '%html%' THEN 0 ELSE n END AS word_count,
        CASE WHEN url = '' THEN {quote(PG.NO_URL)} WHEN NOT {allowed} THEN {quote(PG.DISALLOWED)}
             WHEN fetch_error IS NOT NULL THEN fetch_error
             WHEN http_status <> 200 THEN {quote(PG.NOT_OK)} || http_status
             WHEN content_type NOT LIKE '%html%' THEN {quote(PG.NOT_HTML)} || content_type
             WHEN n < 50 THEN {quote(PG.SHORT_BEFORE)} || n || {quote(PG.SHORT_AFTER)}
             ELSE '' END AS reason,
        body AS text
    FROM counted)"""


PERMITTED_OUTCOMES = f"WITH {RULES}, {FETCHES}, {located('fetches')}, {outcomes('permitted', 'allowed')}"

MEDIANS = ", ".join(f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in TONE_COLUMNS)

PILOT = PARSED + f""",
firsts AS (SELECT *, row_number() OVER (PARTITION BY Record_ID ORDER BY _pos) AS copy FROM judged),
flag AS (
    SELECT * FROM (SELECT *, CASE WHEN _pos % 10 = 3 THEN 0 ELSE 1 END AS Misinfo_Flag
                   FROM firsts WHERE copy = 1)
    WHERE Misinfo_Flag = 1 AND Latitude IS NOT NULL AND Longitude IS NOT NULL AND Themes <> ''),
pilot AS (
    SELECT Record_ID, Date, Year, Month, Year_Month,
        CASE {" ".join(f"WHEN Country = {quote(a)} THEN {quote(b)}" for a, b in COUNTRY_ALIASES.items())}
             ELSE Country END AS Country,
        Latitude, Longitude, Themes, Misinfo_Flag, {MEDIANS}
    FROM flag)"""

ORACLES: dict[str, str] = {
    "gkg_archive_scan": f"""WITH {GKG} SELECT GKGRECORDID, DATE, SourceCommonName,
        DocumentIdentifier, Themes, V2Themes, V2Locations, V2Tone FROM gkg WHERE {SUBSTRING_HIT}""",
    "extract_resume": f"""WITH {GKG}, {DAYS},
        placed AS (SELECT *, strftime(CASE WHEN day(own_day) = 3 THEN own_day + 1 ELSE own_day END, '%Y-%m-%d') AS file_day FROM gkg),
        found AS (SELECT file_day, count(*) FILTER ({SUBSTRING_HIT}) AS n FROM placed GROUP BY 1)
        SELECT d.date, coalesce(n, 0) AS rows_matched, CASE WHEN n IS NULL THEN 'failed' ELSE 'ok' END AS status,
               coalesce(n, 0) AS raw_rows FROM days d LEFT JOIN found f ON f.file_day = d.date""",
    "sampled_days": f"WITH {DAYS} SELECT * FROM days",
    "malformed_rows": """SELECT event_id AS line_no,
        CAST(CASE WHEN event_id % 11 = 0 THEN 26 ELSE 28 END AS BIGINT) AS n_fields
        FROM events JOIN nation ON n_nationkey = user_id % 25
        WHERE event_id % 11 = 0 OR event_id % 13 = 0""",
    "raw_sink_roundtrip": f"""WITH {GKG} SELECT left(DATE, 8) AS day, GKGRECORDID, DATE,
        SourceCommonName, DocumentIdentifier, Themes, V2Themes, V2Locations, V2Tone
        FROM gkg WHERE {SUBSTRING_HIT}""",
    "raw_csv_roundtrip": f"""WITH {GKG} SELECT left(DATE, 8) AS day, GKGRECORDID, DATE,
        Themes, V2Themes, V2Locations, V2Tone FROM gkg WHERE {SUBSTRING_HIT}""",
    "extraction_manifest": f"""WITH {GKG}, {DAYS} SELECT date, timestamp_queried, source_url,
        CAST(count(_pos) AS BIGINT) AS rows_matched
        FROM days LEFT JOIN (SELECT _pos, own_day FROM gkg WHERE {SUBSTRING_HIT}) g
             ON date = strftime(own_day, '%Y-%m-%d') GROUP BY ALL""",
    "clean_sink_roundtrip": f"""WITH {CLEAN} SELECT Record_ID, Date, Year_Month, Country,
        Latitude, Longitude, Themes, Tone_Overall FROM clean""",
    "article_jsonl_roundtrip": f"""WITH {FETCHES}, {outcomes('fetches', 'true')}
        SELECT Record_ID, text FROM outcome WHERE status = 'ok'""",
    "fetch_manifest": f"""{PERMITTED_OUTCOMES}
        SELECT Record_ID, url, status, word_count, reason FROM outcome""",
    "export_results": f"WITH {PANEL} SELECT * FROM panel",

    "theme_filter": f"""WITH {GKG} SELECT _pos, GKGRECORDID, Themes, V2Themes
        FROM gkg WHERE {SUBSTRING_HIT}""",
    "theme_filter_token": f"""WITH {GKG} SELECT _pos, Themes, V2Themes FROM gkg
        WHERE list_has_any(list_transform(string_split(Themes || ';' || V2Themes, ';'),
            lambda c: trim(split_part(c, ',', 1), {SPACES})), ['SURVEILLANCE', 'ELECTION'])""",
    "parse_date": f"WITH {PARSED} SELECT _pos, Date FROM parsed",
    "parse_themes": f"WITH {PARSED} SELECT _pos, Themes, Theme_Count FROM judged",
    "parse_location": f"""WITH {PARSED} SELECT _pos, Country, Location_Type, Latitude, Longitude
        FROM parsed""",
    "parse_tone": f"WITH {PARSED} SELECT _pos, {', '.join(TONE_COLUMNS)} FROM parsed",
    "clean_events": f"WITH {CLEAN} SELECT {EVENT_OUT} FROM clean",
    "clean_drop_report": f"""WITH {CLEAN} SELECT 'raw_rows' AS measure, count(*) AS n FROM judged
        UNION ALL SELECT r, (SELECT count(*) FROM judged WHERE reason = r)
            FROM (SELECT unnest(['bad_date', 'no_themes', 'no_location']) AS r)
        UNION ALL SELECT 'duplicates', (SELECT count(*) FROM ranked) - (SELECT count(*) FROM clean)
        UNION ALL SELECT 'final_rows', count(*) FROM clean""",
    "calendar_fields": """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS Year,
        CAST(month(o_orderdate) AS INTEGER) AS Month, strftime(o_orderdate, '%Y-%m') AS Year_Month
        FROM orders""",
    "missing_columns": f"""WITH {GKG} """ + " UNION ALL ".join(
        f"""SELECT {quote(c)} AS "column", true AS present, count(*) FILTER ({x} IS NULL) AS n_null,
        count(*) FILTER (trim({x}, ' ') = '') AS n_blank FROM gkg""" for c, x in (
            ("GKGRECORDID", "GKGRECORDID"), ("Themes", "Themes"), ("V2Themes", "V2Themes"),
            ("V2Locations", "V2Locations"), ("V2Tone", "nullif(V2Tone, '')"))) + """
        UNION ALL SELECT 'Country', false, count(*), 0 FROM gkg""",
    "median_impute": f"WITH {PARSED} SELECT _pos, {MEDIANS} FROM parsed",
    "country_standardise": """SELECT n_nationkey, CASE c WHEN 'United States' THEN 'USA'
            WHEN 'United Kingdom' THEN 'UK' WHEN 'Russia' THEN 'Russian Federation'
            ELSE c END AS Country
        FROM (SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '),
            lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS c FROM nation)""",
    "pilot_clean": f"WITH {PILOT} SELECT * FROM pilot",
    "context_flags": f"""WITH {FLAGGED} SELECT Record_ID, Political_Context, Economic_Context,
        Health_Context FROM flagged""",
    "fetch_outcome": f"""WITH {FETCHES}, {outcomes('fetches', 'true')}
        SELECT Record_ID, url, status, word_count, reason FROM outcome""",
    "paragraph_text": f"SELECT page_id, {extracted('html')} AS text FROM pages",
    "word_count": f"""SELECT doc_id, CAST({words(squeezed('text'))} AS BIGINT) AS word_count,
        {words(squeezed('text'))} >= 50 AS long_enough FROM documents""",
    "robots_allowed": f"""WITH {RULES}, {located("""(SELECT page_id, CASE page_id % 6
            WHEN 1 THEN url || '|b' WHEN 2 THEN url || ' c' WHEN 3 THEN url || '{d}'
            WHEN 4 THEN 'http://under_score.example.org/' || page_id
            WHEN 5 THEN regexp_replace(url, '^([a-z]+://[^/?#]*)', '\\1:8080') ELSE url END AS url FROM pages)""")}
        SELECT * FROM permitted""",

    "resume_days": f"""WITH {DAYS} SELECT * FROM days WHERE CAST(date[9:10] AS INTEGER) > 15
        OR CAST(date[9:10] AS INTEGER) % 5 = 0""",
    "resume_records": """SELECT CAST(doc_id AS VARCHAR) AS Record_ID FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "limit_then_resume": f"""WITH {FETCHES} SELECT Record_ID, url
        FROM (SELECT * FROM fetches ORDER BY _pos LIMIT 100)
        WHERE http_status <> 404 AND content_type <> 'application/pdf'""",
    "manifest_repair": f"""WITH {GKG}, {DAYS},
        found AS (SELECT strftime(own_day, '%Y-%m-%d') AS date, count(*) AS n FROM gkg
                  WHERE {SUBSTRING_HIT} AND day(own_day) > 10 GROUP BY 1),
        stale AS (SELECT * FROM days WHERE CAST(date[9:10] AS INTEGER) % 2 = 0)
        SELECT coalesce(f.date, s.date) AS date,
            replace(coalesce(f.date, s.date), '-', '') || '121500' AS timestamp_queried,
            replace({quote(URL_TEMPLATE)}, '{{ts}}',
                    replace(coalesce(f.date, s.date), '-', '') || '121500') AS source_url,
            CAST(coalesce(f.n, 7) AS BIGINT) AS rows_matched,
            CASE WHEN f.n IS NULL AND right(s.date, 2) = '08' THEN 'failed' ELSE 'ok' END AS status
        FROM stale s FULL JOIN found f ON s.date = f.date""",
    "events_with_text": f"""WITH {CLEAN} SELECT Record_ID, text IS NOT NULL AS has_text, md5(text) AS text_md5
        FROM clean LEFT JOIN documents ON doc_id * 3 = _pos""",
    "incremental_append": """SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS n
        FROM events JOIN nation ON n_nationkey = user_id % 25 GROUP BY 1""",

    "rows_per_day": f"WITH {GKG} SELECT left(DATE, 8) AS day, count(*) AS n FROM gkg GROUP BY 1",
    "fetch_status_counts": f"""{PERMITTED_OUTCOMES}
        SELECT status, regexp_replace(reason, '[0-9]+', '#', 'g') AS reason, count(*) AS n
        FROM outcome GROUP BY ALL""",
    "theme_frequency": f"""WITH {CLEAN} SELECT Theme_Tokens, count(*) AS "count"
        FROM (SELECT unnest(theme_list) AS Theme_Tokens FROM clean)
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "dataset_profile": f"""WITH {CLEAN} SELECT count(*) AS rows, count(DISTINCT Country) AS countries,
        min(Date) AS first_date, max(Date) AS last_date FROM clean""",
    "dominant_theme_country": f"""WITH {CLEAN} SELECT Country, theme, n AS "count" FROM (
        SELECT Country, theme, count(*) AS n,
            row_number() OVER (PARTITION BY Country ORDER BY count(*) DESC, theme) AS rank
        FROM (SELECT Country, unnest(theme_list) AS theme FROM clean) GROUP BY 1, 2)
        WHERE rank = 1""",
    "tone_histogram": f"""WITH {CLEAN} SELECT bin, -5.0 + (bin - 1) * 0.5::DOUBLE AS bin_start, count(*) AS n
        FROM (SELECT CAST(CASE WHEN Tone_Overall < -5 THEN 0 WHEN Tone_Overall >= 2 THEN 15
                  ELSE floor((Tone_Overall + 5) * 2) + 1 END AS BIGINT) AS bin
              FROM clean WHERE Tone_Overall IS NOT NULL) GROUP BY 1""",
    "tone_summary": f"WITH {CLEAN} " + " UNION ALL ".join(
        f"""SELECT {quote(c)} AS measure, count({c}) AS n, round(avg({c}), 6) + 0.0 AS mean,
        round(stddev_samp({c}), 6) + 0.0 AS sd, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
        round(quantile_cont({c}, 0.75), 6) AS q3, max({c}) AS max FROM clean"""
        for c in TONE_COLUMNS),
    "topic_tone": f"""WITH {PARSED} SELECT Topic_Label, """ + ", ".join(
        f"round_even(avg({c}) * 100, 0) / 100 + 0.0 AS {c}" for c in TONE_COLUMNS[:4]) + """
        FROM parsed JOIN (SELECT doc_id, 'Topic ' || (ascii(source[4:4]) % 5) AS Topic_Label
                          FROM documents) ON doc_id = _pos % (SELECT max(doc_id) + 1 FROM documents) GROUP BY 1""",
    "country_month_panel": f"WITH {PANEL} SELECT * FROM panel",
    "country_month_panel_zero_fill": f"""WITH {PANEL.replace("FROM flagged GROUP",
        "FROM flagged WHERE Theme_Count = 1 GROUP")}, months AS (
            SELECT unnest(generate_series(CAST(min(Year_Month) || '-01' AS TIMESTAMP),
                CAST(max(Year_Month) || '-01' AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM panel),
        cells AS (SELECT Country, strftime(m, '%Y-%m') AS Year_Month
                  FROM (SELECT DISTINCT Country FROM panel), months)
        SELECT c.Country, c.Year_Month, coalesce(Misinfo_Event_Count, 0) AS Misinfo_Event_Count,
            Political_Prop, Economic_Prop, Health_Prop, Tone_Overall_Mean,
            coalesce(Source_Diversity, 0) AS Source_Diversity
        FROM cells c LEFT JOIN panel p ON p.Country = c.Country AND p.Year_Month = c.Year_Month""",
    "country_totals": f"""WITH {CLEAN} SELECT Country, count(*) AS n_events,
        round(avg(Tone_Overall), 6) + 0.0 AS mean_tone, {MEAN_LATITUDE} + 0.0 AS Latitude,
        {MEAN_LONGITUDE} + 0.0 AS Longitude FROM clean GROUP BY 1""",
    "event_points": f"""WITH {CLEAN} SELECT Latitude, Longitude, count(*) AS n_events
        FROM clean GROUP BY 1, 2""",

    "dedupe_first": f"WITH {GKG} SELECT min(_pos) AS _pos, GKGRECORDID FROM gkg GROUP BY 2",
    "pilot_sample": f"""WITH {PILOT} SELECT * FROM pilot
        ORDER BY md5('42:' || Record_ID), Record_ID LIMIT 50""",
}
for name, by in (("tone_by_location_type", "Location_Type"), ("tone_by_country", "Country")):
    ORACLES[name] = f"""WITH {CLEAN} SELECT {by}, count(Tone_Overall) AS n,
        round(avg(Tone_Overall), 6) + 0.0 AS mean_tone,
        round(stddev_samp(Tone_Overall), 6) + 0.0 AS sd_tone FROM clean GROUP BY 1"""

# ---- space -----------------------------------------------------------------

EARTH_KM = 6371.0088


def km(a: str, b: str) -> str:
    """Great-circle distance; ``a`` and ``b`` have columns lat and lon."""
    return f"""(2 * {EARTH_KM} * asin(least(1.0, sqrt(
        power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat))
        * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"""


POINTS = CLEAN + """,
pts AS (SELECT Latitude AS lat, Longitude AS lon, count(*) AS w FROM clean GROUP BY 1, 2)"""

K_DISTANCE = POINTS + f""",
dist AS (SELECT a.lat, a.lon, b.w, {km('a', 'b')} AS km FROM pts a, pts b),
run AS (SELECT lat, lon, km, sum(w) OVER (PARTITION BY lat, lon ORDER BY km
            RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS events FROM dist),
kd AS (SELECT lat AS Latitude, lon AS Longitude, min(km) AS k_distance_km
       FROM run WHERE events >= 150 GROUP BY 1, 2)"""

KDE = POINTS + f""",
grid AS (SELECT -90 + (i + 0.5) * 3.0::DOUBLE AS lat, -180 + (j + 0.5) * 3.0::DOUBLE AS lon
         FROM range(60) r(i), range(120) c(j)),
kde AS (
    SELECT g.lat AS Grid_Latitude, g.lon AS Grid_Longitude,
        round(1e6 * sum(p.w * exp(-power({km('p', 'g')}, 2) / (2 * 250.0 * 250.0)))
              / (2 * pi() * 250.0 * 250.0 * (SELECT sum(w) FROM pts)), 6) AS density
    FROM grid g, pts p GROUP BY 1, 2 HAVING density > 0)"""

DBSCAN = POINTS + f""",
near AS (SELECT a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, b.w
         FROM pts a, pts b WHERE {km('a', 'b')} <= 170.0),
core AS (SELECT alat AS lat, alon AS lon FROM near GROUP BY 1, 2 HAVING sum(w) >= 120),
links AS (SELECT n.* FROM near n JOIN core a ON a.lat = alat AND a.lon = alon
                             JOIN core b ON b.lat = blat AND b.lon = blon),
reach(lat, lon, rlat, rlon) AS (
    SELECT lat, lon, lat, lon FROM core
    UNION SELECT r.lat, r.lon, l.blat, l.blon FROM reach r JOIN links l
          ON l.alat = r.rlat AND l.alon = r.rlon),
roots AS (SELECT lat, lon, min({{'a': rlat, 'b': rlon}}) AS root FROM reach GROUP BY 1, 2),
numbers AS (SELECT lat, lon, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM roots)"""

UNITS = CLEAN + f""",
units AS (SELECT Country AS u, count(*) AS n_events, round(avg(Tone_Overall), 6) AS mean_tone,
              {MEAN_LATITUDE} AS lat, {MEAN_LONGITUDE} AS lon
          FROM clean WHERE Country <> '' GROUP BY 1)"""

MORAN = UNITS + f""",
ranks AS (SELECT a.u, b.u AS v, row_number() OVER (PARTITION BY a.u ORDER BY {km('a', 'b')}, b.u) AS r
          FROM units a, units b WHERE a.u <> b.u),
weights AS (SELECT u, v, 0.25 AS weight FROM ranks WHERE r <= 4),
measures AS (SELECT unnest(['n_events', 'mean_tone']) AS measure),
vals AS (SELECT measure, u, CASE measure WHEN 'n_events' THEN n_events ELSE mean_tone END AS x
         FROM units, measures),
centred AS (SELECT measure, u, x - avg(x) OVER (PARTITION BY measure) AS z FROM vals),
orders AS (SELECT measure, perm, z, row_number() OVER (PARTITION BY measure, perm
               ORDER BY CASE WHEN perm = 0 THEN u ELSE md5('42:' || perm || ':' || u) END, u) AS r
           FROM centred, range(100) p(perm)),
seats AS (SELECT u, row_number() OVER (ORDER BY u) AS r FROM units),
placed AS (SELECT measure, perm, u, z FROM orders JOIN seats USING (r)),
crossed AS (SELECT a.measure, a.perm, sum(weight * a.z * b.z) AS c
            FROM placed a JOIN weights w ON w.u = a.u
            JOIN placed b ON b.measure = a.measure AND b.perm = a.perm AND b.u = w.v GROUP BY 1, 2),
spread AS (SELECT measure, perm, sum(z * z) AS ss, count(*) AS n FROM placed GROUP BY 1, 2),
moran AS (SELECT measure, perm, n, c / ss AS i FROM crossed JOIN spread USING (measure, perm))"""

ORACLES |= {
    "eps_neighbours": f"""WITH {POINTS} SELECT a.lat AS Latitude, a.lon AS Longitude,
        b.lat AS Other_Latitude, b.lon AS Other_Longitude, round({km('a', 'b')}, 6) AS km
        FROM pts a, pts b WHERE (a.lat < b.lat OR (a.lat = b.lat AND a.lon < b.lon))
        AND {km('a', 'b')} <= 400""",
    "k_distance": f"""WITH {K_DISTANCE} SELECT Latitude, Longitude,
        round(k_distance_km, 6) AS k_distance_km FROM kd""",
    "k_distance_curve": f"""WITH {K_DISTANCE}
        SELECT i / 20.0::DOUBLE AS share, round(v[i + 1], 6) AS k_distance_km
        FROM (SELECT quantile_cont(k_distance_km, [""" + ", ".join(f"{i}/20.0" for i in range(21)) + """]) AS v
              FROM kd), range(21) r(i)""",
    "dbscan": f"""WITH RECURSIVE {DBSCAN}
        SELECT p.lat AS Latitude, p.lon AS Longitude, p.w AS n_events, c.lat IS NOT NULL AS is_core,
            coalesce(c.cluster, (SELECT min(x.cluster) FROM near n JOIN numbers x
                ON x.lat = n.blat AND x.lon = n.blon WHERE n.alat = p.lat AND n.alon = p.lon),
                -1) AS cluster
        FROM pts p LEFT JOIN numbers c ON c.lat = p.lat AND c.lon = p.lon""",
    "kde_grid": f"WITH {KDE} SELECT * FROM kde",
    "kde_hotspots": f"""WITH {KDE} SELECT * FROM kde
        ORDER BY density DESC, Grid_Latitude, Grid_Longitude LIMIT 10""",
    "morans_i": f"""WITH {MORAN} SELECT o.measure, o.n, round(o.i, 6) + 0.0 AS I,
        round(-1.0 / (o.n - 1), 6) AS expected,
        round((least(s.larger, 99 - s.larger) + 1) / 100.0::DOUBLE, 6) AS p_sim
        FROM moran o JOIN (SELECT p.measure, count(*) FILTER (WHERE round(p.i, 12) >= round(q.i, 12)) AS larger
            FROM moran p JOIN moran q ON q.measure = p.measure AND q.perm = 0
            WHERE p.perm > 0 GROUP BY 1) s ON s.measure = o.measure WHERE o.perm = 0""",
    "morans_permutation": f"""WITH {MORAN} SELECT CAST(perm AS INTEGER) AS perm, round(i, 6) + 0.0 AS I
        FROM moran WHERE measure = 'n_events'""",
}

# ---- count regression ------------------------------------------------------

FIT = PANEL + """,
cells AS (SELECT Misinfo_Event_Count AS y, CAST(Political_Prop > 0.5 AS INTEGER) AS g FROM panel),
means AS (SELECT g, avg(y) AS mu, sum(y) AS total, count(*) AS n FROM cells GROUP BY g),
a AS (SELECT * FROM means WHERE g = 0),
b AS (SELECT * FROM means WHERE g = 1),
coefs AS (
    SELECT 'Intercept' AS term, ln(a.mu) AS coef, sqrt(1.0 / a.total) AS se FROM a
    UNION ALL SELECT 'Mostly_Political', ln(b.mu / a.mu), sqrt(1.0 / a.total + 1.0 / b.total) FROM a, b)"""

# integral of the normal density from 0 to |z| by Simpson's rule with 400 strips
P_VALUE = """greatest(0.0, 1 - 2 * (SELECT sum(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-power(abs(coef / se) * i / 400.0, 2) / 2)) * abs(coef / se) / 1200.0 / sqrt(2 * pi())
    FROM range(401) r(i)))"""


def nb_likelihood(t: str) -> str:
    """Log-likelihood at alpha = exp(t), over counts grouped by value."""
    r = f"exp(-({t}))"
    return f"""(SELECT sum(w * (lgamma(y + {r}) - lgamma({r}) - lgamma(y + 1)
        + {r} * ln({r} / ({r} + mu)) + y * ln(mu / ({r} + mu)))) FROM grouped)"""


NEGBIN = FIT + f""",
grouped AS (SELECT CAST(y AS DOUBLE) AS y, mu, count(*) AS w FROM cells JOIN means USING (g) GROUP BY 1, 2),
search(step, lo, hi) AS (
    SELECT 0, -12.0::DOUBLE, 3.0::DOUBLE
    UNION ALL SELECT step + 1,
        CASE WHEN {nb_likelihood('lo + (hi - lo) / 3')} < {nb_likelihood('hi - (hi - lo) / 3')}
             THEN lo + (hi - lo) / 3 ELSE lo END,
        CASE WHEN {nb_likelihood('lo + (hi - lo) / 3')} < {nb_likelihood('hi - (hi - lo) / 3')}
             THEN hi ELSE hi - (hi - lo) / 3 END
    FROM search WHERE step < 45),
rise AS (SELECT sum(w * (power(y - mu, 2) - y)) <= 0 AS none,
             sum(w * (y * ln(mu) - mu - lgamma(y + 1))) AS poisson FROM grouped),
best AS (SELECT (lo + hi) / 2 AS t, CASE WHEN none THEN 0.0 ELSE exp((lo + hi) / 2) END AS alpha,
             none, poisson FROM search, rise WHERE step = 45),
info AS (SELECT g, n * mu / (1 + alpha * mu) AS v FROM means, best)"""

# ---- topics ----------------------------------------------------------------

from newsgraph.operators.topics import STOP_WORDS, WORD  # noqa: E402
from newsgraph.plans.queries import LDA_FIT, TERM_SETS  # noqa: E402

TOKENS = f"""
docs AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), {quote(WORD)}),
    lambda w: length(w) >= 3 AND NOT list_contains({listing(STOP_WORDS)}, w)) AS tokens FROM documents),
vocab AS (
    SELECT term, docs, row_number() OVER (ORDER BY docs DESC, term) - 1 AS "index" FROM (
        SELECT term, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM docs)
        GROUP BY 1)
    WHERE docs >= 5 AND docs <= 0.5 * (SELECT count(*) FROM docs)
    QUALIFY row_number() OVER (ORDER BY docs DESC, term) <= 2000)"""

LDA_TOPICS = 5


def _digamma(x: str) -> str:
    z = f"({x} + 6.0)"
    series = "".join(f" - 1.0 / ({x} + {i})" for i in range(6))
    return (f"(ln({z}) - 0.5 / {z} - 1.0 / (12 * {z} ** 2) + 1.0 / (120 * {z} ** 4) - 1.0 / (252 * {z} ** 6)"
            f" + 1.0 / (240 * {z} ** 8){series})")


def _total(name: str, k: int = LDA_TOPICS) -> str:
    return " + ".join(f"{name}{t}" for t in range(k))


def _lda(k: int, passes: int, inner: int, seed: int = 42) -> str:
    """Passes of variational LDA as one step after another: counts of terms, then of documents."""
    def each(form: str) -> str:
        return ", ".join(form.format(t=t) for t in range(k))

    start = []
    for t in range(k):
        x = f'(("index" * {k} + {t + 1 + seed}) * 1640531527 % 2147483648)'
        for shift, factor in ((15, 1123411259), (13, 1633244958)):
            x = f"(xor({x}, {x} >> {shift}) * {factor} % 2147483648)"
        start.append(f"0.5 + {x} / 2147483648.0::DOUBLE AS l{t}")
    steps = [
        """cells AS MATERIALIZED (SELECT doc_id, "index", count(*)::DOUBLE AS n
            FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) JOIN vocab USING (term) GROUP BY 1, 2)""",
        "lengths AS MATERIALIZED (SELECT doc_id, sum(n) AS n FROM cells GROUP BY 1)",
        f'terms0 AS MATERIALIZED (SELECT "index", {", ".join(start)} FROM vocab)',
    ]
    for p in range(passes + 1):
        logs = ", ".join(f"exp({_digamma(f'l{t}')} - w{t}) AS e{t}" for t in range(k))
        whole = ", ".join(f"{_digamma(f's{t}')} AS w{t}" for t in range(k))
        steps.append(f"""topics{p} AS MATERIALIZED (SELECT "index", {logs} FROM terms{p},
            (SELECT {whole} FROM (SELECT {each('sum(l{t}) AS s{t}')} FROM terms{p})))""")
        steps.append(f"""used{p} AS MATERIALIZED (SELECT * FROM cells JOIN topics{p} USING ("index"))""")
        steps.append(f"docs{p}_0 AS MATERIALIZED (SELECT doc_id, {each(f'1.0 / {k} + n / {k} AS g{{t}}')} FROM lengths)")
        mass = " + ".join(f"e{t} * h{t}" for t in range(k))
        for i in range(inner + 1):
            thetas = ", ".join(f"exp({_digamma(f'g{t}')} - {_digamma('(' + _total('g', k) + ')')}) AS h{t}" for t in range(k))
            steps.append(f"theta{p}_{i} AS MATERIALIZED (SELECT doc_id, {thetas} FROM docs{p}_{i})")
            if i < inner:
                steps.append(f"""docs{p}_{i + 1} AS MATERIALIZED (SELECT doc_id,
                    {each(f'1.0 / {k} + sum(n * e{{t}} * h{{t}} / ({mass})) AS g{{t}}')}
                    FROM used{p} JOIN theta{p}_{i} USING (doc_id) GROUP BY 1)""")
        steps.append(f"""terms{p + 1} AS MATERIALIZED (SELECT "index",
            {each(f'1.0 / {k} + sum(n * e{{t}} * h{{t}} / ({mass})) AS l{{t}}')}
            FROM used{p} JOIN theta{p}_{inner} USING (doc_id) GROUP BY 1)""")
    steps.append("weights AS (" + " UNION ALL ".join(
        f'SELECT {t}::INTEGER AS topic, term, l{t} / sum(l{t}) OVER () AS weight FROM terms{passes} JOIN vocab USING ("index")'
        for t in range(k)) + ")")
    steps.append(f"final AS (SELECT * FROM docs{passes}_{inner})")
    return ",\n".join(steps)


TOPICS = TOKENS + ",\n" + _lda(LDA_TOPICS, LDA_FIT["iterations"], LDA_FIT["inner"])

COHERENCE = TOKENS + """,
sets(topic, term) AS (VALUES """ + ", ".join(
    f"({t}, {quote(w)})" for t, ws in TERM_SETS.items() for w in ws) + """),
placed AS (SELECT doc_id, len(tokens) AS n, greatest(len(tokens) - 110, 0) AS last,
               unnest(tokens) AS term, unnest(range(len(tokens))) AS p FROM docs),
presence AS (
    SELECT DISTINCT doc_id, term, unnest(range(greatest(p - 109, 0), least(p, last) + 1)) AS s
    FROM placed WHERE term IN (SELECT term FROM sets)),
total AS (SELECT sum(greatest(len(tokens) - 110, 0) + 1)::DOUBLE AS w FROM docs WHERE len(tokens) > 0),
singles AS (SELECT term, count(*) / (SELECT w FROM total) AS p FROM presence GROUP BY 1),
pairs AS (SELECT x.topic, x.term AS a, y.term AS b FROM sets x JOIN sets y USING (topic)),
joint AS (SELECT x.term AS a, y.term AS b, count(*) / (SELECT w FROM total) AS p
          FROM presence x JOIN presence y USING (doc_id, s) GROUP BY 1, 2),
npmi AS (
    SELECT topic, pairs.a, pairs.b, CASE WHEN sa.p IS NULL OR sb.p IS NULL THEN 0.0
        ELSE ln((coalesce(j.p, 0) + 1e-12) / (sa.p * sb.p)) / -ln(coalesce(j.p, 0) + 1e-12) END AS m
    FROM pairs LEFT JOIN joint j ON j.a = pairs.a AND j.b = pairs.b
    LEFT JOIN singles sa ON sa.term = pairs.a LEFT JOIN singles sb ON sb.term = pairs.b),
whole AS (SELECT topic, b, sum(m) AS m FROM npmi GROUP BY 1, 2),
lengths AS (SELECT topic, sqrt(sum(m * m)) AS l FROM whole GROUP BY 1),
cosines AS (SELECT n.topic, n.a, CASE WHEN sum(n.m * n.m) = 0 THEN 0
                ELSE sum(n.m * w.m) / sqrt(sum(n.m * n.m)) / any_value(l) END AS c
            FROM npmi n JOIN whole w ON w.topic = n.topic AND w.b = n.b
            JOIN lengths ON lengths.topic = n.topic GROUP BY 1, 2)"""

ORACLES |= {
    "poisson_fit": f"""WITH {FIT} SELECT term, round(coef, 6) AS coef, round(se, 6) AS se FROM coefs""",
    "poisson_fit_full": f"""WITH {PANEL} SELECT unnest(['Intercept', 'Political_Prop', 'Economic_Prop', 'Health_Prop',
            'Tone_Overall_Mean']) AS term, unnest([round(sum(n), 4), round(sum(n * p), 4) + 0.0, round(sum(n * e), 4) + 0.0, round(sum(n * h), 4) + 0.0, round(sum(n * t), 4) + 0.0]) AS score
        FROM (SELECT Misinfo_Event_Count::DOUBLE AS n, Political_Prop AS p, Economic_Prop AS e, Health_Prop AS h,
                     Tone_Overall_Mean AS t FROM panel WHERE Tone_Overall_Mean IS NOT NULL)""",
    "negbin_fit_full": f"""WITH {PANEL} SELECT unnest(['Intercept', 'Political_Prop', 'Economic_Prop', 'Health_Prop',
            'Tone_Overall_Mean']) AS term, 0.0::DOUBLE AS score FROM (SELECT count(*) FROM panel)""",
    "lda_topics": f"""WITH {TOPICS}
        SELECT topic, term, round(weight, 7) AS weight FROM weights""",
    "topic_top_terms": f"""WITH {TOPICS}
        SELECT topic, rank, term, round(weight, 7) AS weight FROM (
            SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term)::INTEGER AS rank
            FROM weights) WHERE rank <= 10""",
    "dominant_topic": f"""WITH {TOPICS},
        shares AS (SELECT doc_id, {", ".join(f"g{t} / ({_total('g')}) AS p{t}" for t in range(LDA_TOPICS))} FROM final),
        best AS (SELECT *, greatest({", ".join(f"p{t}" for t in range(LDA_TOPICS))}) AS share FROM shares)
        SELECT d.doc_id, CASE {" ".join(f"WHEN round(p{t}, 9) = round(share, 9) THEN 'Topic {t}'" for t in range(LDA_TOPICS))}
                   END AS Topic_Label, round(share, 6) AS share,
               CASE WHEN share IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS total
        FROM docs d LEFT JOIN best USING (doc_id)""",
    "overdispersion": f"""WITH {FIT},
        fitted AS (SELECT y, mu, (power(y - mu, 2) - y) / mu AS z FROM cells JOIN means USING (g)),
        sums AS (SELECT count(*) AS n, sum(power(y - mu, 2) / mu) AS x2, var_samp(y) / avg(y) AS vm,
            sum(mu * mu) AS mm, sum(mu * z) AS mz, sum(z * z) AS zz FROM fitted)
        SELECT n, n - 2 AS df, round(x2, 6) AS pearson_chi2, round(x2 / (n - 2), 6) AS pearson_ratio,
            round(vm, 6) AS variance_to_mean, round(mz / mm, 6) AS aux_alpha,
            round(mz / mm / sqrt((zz - mz * mz / mm) / (n - 1) / mm), 6) AS aux_t FROM sums""",
    "negbin_fit": f"""WITH RECURSIVE {NEGBIN}
        SELECT term, round(coef, 6) AS coef,
            round(CASE term WHEN 'Intercept' THEN sqrt(1 / (SELECT v FROM info WHERE g = 0))
                  ELSE sqrt((SELECT sum(1 / v) FROM info)) END, 5) AS se,
            round((SELECT alpha FROM best), 5) AS alpha, (SELECT none FROM best) AS at_boundary,
            round((SELECT CASE WHEN none THEN poisson ELSE {nb_likelihood('t')} END FROM best), 5)
                AS log_likelihood FROM coefs""",
    "irr_table": f"""WITH {FIT} SELECT term, round(coef, 3) AS coef, round(exp(coef), 3) AS IRR,
        round(exp(coef - 1.959963984540054 * se), 3) AS IRR_ci_lower,
        round(exp(coef + 1.959963984540054 * se), 3) AS IRR_ci_upper,
        round({P_VALUE}, 3) AS p_value FROM coefs""",
    "tokens": f"""WITH {TOKENS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens,
        CAST(len(tokens) AS BIGINT) AS n FROM docs""",
    "lemmatised_tokens": f"""WITH {TOKENS} SELECT doc_id, array_to_string(list_transform(tokens,
        lambda w: regexp_replace(w, 'ing$', '')), ' ') AS tokens FROM docs""",
    "vocabulary": f"WITH {TOKENS} SELECT * FROM vocab",
    "doc_term_matrix": f"""WITH {TOKENS} SELECT doc_id, "index", count(*) AS n
        FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) JOIN vocab USING (term) GROUP BY 1, 2""",
    "coherence_cv": f"""WITH {COHERENCE} SELECT topic, round(avg(c), 6) AS coherence
        FROM cosines GROUP BY 1""",
}

# ---- streams: what has been drained equals the batch result ----------------

ORACLES |= {
    "stream_ingest": """SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(ts) AS last_ts
        FROM events GROUP BY 1""",
    "stream_archive_scan": f"""WITH {GKG} SELECT GKGRECORDID, DATE, SourceCommonName,
        DocumentIdentifier, Themes, V2Themes, V2Locations, V2Tone FROM gkg WHERE {SUBSTRING_HIT}""",
    "stream_dedupe": "SELECT event_id, ts, event_type FROM events",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "stream_manifest": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
}
