"""Views over the given tables, shaped like the records the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.schema import FILTER_CODES, RAW_COLUMNS

# Codes the derived records cycle through: the filter list, then others.
VIEW_CODES = FILTER_CODES + [
    "ELECTION", "ELECTION_FRAUD", "GENERAL_GOVERNMENT", "EPU_POLICY", "ECON_INFLATION",
    "ECON_BANKRUPTCY", "WB_HEALTH", "WB_MEDIA", "TAX_FNCACT_POLITICIAN",
    "TAX_FNCACT_JOURNALIST", "SOC_POINTSOFINTEREST", "PROTEST",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` joined with ``nation`` as 27 packed text columns, plus ``_pos`` (row order)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = e.join(n, n.n_nationkey == F.pmod(e.user_id, F.lit(25)))
    codes = "array(" + ",".join(f"'{c}'" for c in VIEW_CODES) + ")"
    code = lambda x: f"{codes}[cast(({x}) % {len(VIEW_CODES)} as int)]"
    base = base.selectExpr(
        "event_id AS id", "user_id", "event_type", "n_name", "n_nationkey AS nk", "ts",
        "CASE WHEN event_id % 20 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS k",
    ).selectExpr("*", "ts + make_interval(0, cast(k % 24 as int)) AS t",
                 "concat('src', user_id % 17, '.example.com') AS src")
    filled = {
        "GKGRECORDID": "concat(date_format(t, 'yyyyMMdd'), '121500-', k)",
        "DATE": "CASE WHEN id % 37 = 0 THEN 'bad' ELSE date_format(t, 'yyyyMMddHHmmss') END",
        "SourceCommonName": "src",
        "DocumentIdentifier": "concat('https://', src, '/', event_type, '/', id)",
        "Themes": f"CASE WHEN id % 23 = 0 THEN {code('id')} ELSE '' END",
        "V2Themes": f"""CASE WHEN id % 41 = 0 OR id % 23 = 0 THEN '' WHEN id % 43 = 0 THEN ';;'
            ELSE concat({code('7 * id')}, ',12;', {code('5 * id + user_id')}, ',240; ',
                        {code('user_id')}, ',391;') END""",
        "V2Locations": """CASE WHEN id % 53 = 0 THEN ''
            WHEN id % 29 = 0 THEN concat('1#', n_name, '#XX##10.5')
            WHEN id % 31 = 0 THEN concat('4#City, ', n_name, '#XX#XX01#n/a#20.5#1')
            WHEN id % 47 = 0 THEN '3#City, #XX#XX01#10.5#20.5#1'
            WHEN id % 3 = 0 THEN concat('1#', n_name, '#XX##', 4 * nk - 48, '.25#',
                                        13 * nk - 160, '.5#F')
            ELSE concat('4#City', id % 4, ', State, ', n_name, '#XX#XX01#',
                        4 * nk - 48 + id % 4, '.75#', 13 * nk - 160 + id % 4,
                        '.125#77;1#Elsewhere#YY##1#2#3') END""",
        "V2Tone": """CASE WHEN id % 59 = 0 THEN '' WHEN id % 61 = 0 THEN '1.5,2.5,3'
            WHEN id % 67 = 0 THEN '1.5,x,3,4,5,6,100'
            WHEN id % 71 = 0 THEN '-1.5,,3,4,5,6,100'
            ELSE concat(id % 13 - 9, '.25,', id % 5, '.5,', id % 7 + 1, '.125,',
                        id % 5 + id % 7 + 1, '.625,', user_id % 20, '.0,', user_id % 4,
                        '.75,', 200 + id % 500) END""",
    }
    return base.selectExpr(
        "id AS _pos", *[f"{filled[c]} AS {c}" if c in filled else f"'' AS {c}" for c in RAW_COLUMNS])


def fetch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as landed fetch results, with failures placed by page number."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id AS _pos", "cast(page_id AS string) AS Record_ID",
        "CASE WHEN page_id % 29 = 0 THEN '' ELSE url END AS url",
        "CASE WHEN page_id % 23 = 0 THEN 'timed out' END AS fetch_error",
        "CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS http_status",
        "CASE WHEN page_id % 19 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END"
        " AS content_type",
        "html")


ROBOTS_RULES = [
    ("thther.example.org", False, "/"),
    ("blog.tionsh.example.net", False, "/en/"),
    ("blog.tionsh.example.net", True, "/en/5"),
    ("spam-farm.example.org", True, "/"),
    ("under_score.example.org", False, "/"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def robots_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROBOTS_RULES, "host string, allow boolean, path_prefix string")
