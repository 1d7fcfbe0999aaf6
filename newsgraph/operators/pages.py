"""Landed article pages: permission, outcome, text, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsgraph.functions.plan import once
from newsgraph.functions.text import paragraph_text, squeezed_words

MIN_WORDS = 50

# The reasons a fetch is logged with.
NO_URL = "no Source_URL in input row"
DISALLOWED = "robots.txt disallows this path"
NOT_OK = "HTTP "
NOT_HTML = "non-HTML content-type: "
SHORT_BEFORE, SHORT_AFTER = "only ", " words extracted (likely paywall/stub/non-article page)"


# scheme, user, host (or an address in brackets), port, then path and query up to a fragment
_URL = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[^/?#]*)?([^#]*)"


def url_host(url: Column) -> Column:
    """The host in lower case, by cutting the text: an odd character does not hide it."""
    return F.lower(F.regexp_extract(url, _URL, 1))


def url_target(url: Column) -> Column:
    """Path and query, as robots rules see them."""
    target = F.regexp_extract(url, _URL, 2)
    return F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(F.lit("/"), target))


def with_permission(rows: DataFrame, rules: DataFrame, match: str = "longest") -> DataFrame:
    """Adds ``allowed``: the rule of the URL's host that applies, or true when none does.

    ``longest``: the longest matching prefix decides and an allow wins a tie.
    ``first``: the first match by ``position`` decides, a column the rules must have. Rules travel
    as one array per host, so every page meets one row and nothing is multiplied. Spark
    chooses the join by the size of the rules; where it shuffles, adaptive execution
    splits a host with very many pages.
    """
    rules = rules.where(F.length("path_prefix") > 0)
    if match == "first" and "position" not in rules.columns:
        raise ValueError("rules need a position to be matched in their order")
    rank = {"longest": -F.length("path_prefix"), "first": F.expr("position") if match == "first" else None}[match]
    fields = [rank.alias("o"), (~F.col("allow")).alias("deny")]
    by_host = (rules.groupBy(F.lower("host").alias("_host")).agg(
        F.array_sort(F.collect_list(F.struct(*fields, "path_prefix"))).alias("_rules")))
    target = F.col("_target")
    applying = F.filter("_rules", lambda r: F.startswith(target, r["path_prefix"]))
    return (rows.withColumns({"_host": url_host(F.col("url")),
                              "_target": url_target(F.col("url"))})
            .join(by_host, "_host", "left")
            .withColumn("allowed", ~F.coalesce(F.get(applying, F.lit(0))["deny"], F.lit(False)))
            .drop("_host", "_target", "_rules"))


def fetch_outcome(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Status, word count, reason and text of every landed fetch.

    Tests run in order: no URL, disallowed, request error, HTTP status, content
    type, too few words. Page text is only cut out of rows that reach the last test.
    """
    url = F.coalesce("url", F.lit(""))
    allowed = F.coalesce("allowed", F.lit(True)) if "allowed" in rows.columns else F.lit(True)
    early = (F.when(url == "", F.struct(F.lit("error").alias("status"), F.lit(NO_URL).alias("reason")))
             .when(~allowed, _outcome("disallowed", F.lit(DISALLOWED)))
             .when(F.col("fetch_error").isNotNull(), _outcome("error", F.col("fetch_error")))
             .when(~F.col("http_status").eqNullSafe(F.lit(200)),
                   _outcome("error", F.concat(F.lit(NOT_OK), F.col("http_status").cast("string"))))
             .when(~F.coalesce("content_type", F.lit("")).contains("html"),
                   _outcome("error", F.concat(F.lit(NOT_HTML), F.coalesce("content_type", F.lit(""))))))
    judged = rows.withColumn("_early", early)
    judged = judged.withColumn(
        "text", once(F.when(F.col("_early").isNull(), paragraph_text(F.col("html"))).otherwise("")))
    judged = judged.withColumn("word_count", squeezed_words(F.col("text")))
    short = F.col("word_count") < min_words
    return judged.select(
        *[c for c in ("_pos",) if c in rows.columns], "Record_ID", url.alias("url"),
        F.coalesce(F.col("_early")["status"], F.when(short, "error").otherwise("ok")).alias("status"),
        "word_count",
        F.coalesce(F.col("_early")["reason"], F.when(short, F.concat(
            F.lit(SHORT_BEFORE), F.col("word_count").cast("string"), F.lit(SHORT_AFTER),
        )).otherwise("")).alias("reason"),
        "text")


def _outcome(status: str, reason: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"))


def fetch_manifest(outcomes: DataFrame) -> DataFrame:
    return outcomes.select("Record_ID", "url", "status", "word_count", "reason")


def article_texts(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'ok'").select("Record_ID", "text")


def status_counts(manifest: DataFrame, by_reason: bool = False) -> DataFrame:
    """Attempts per status, and per reason with its numbers masked."""
    keys = [F.col("status")]
    if by_reason:
        keys.append(F.regexp_replace("reason", "[0-9]+", "#").alias("reason"))
    return manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def events_with_text(events: DataFrame, texts: DataFrame, key: str = "Record_ID") -> DataFrame:
    """All events, with text where there is any."""
    return events.join(texts, key, "left")
