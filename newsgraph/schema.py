"""Record layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# The 27 columns of an archive record, in file order.
RAW_COLUMNS = [
    "GKGRECORDID", "DATE", "SourceCollectionIdentifier", "SourceCommonName",
    "DocumentIdentifier", "Counts", "V2Counts", "Themes", "V2Themes",
    "Locations", "V2Locations", "Persons", "V2Persons", "Organizations",
    "V2Organizations", "V2Tone", "Dates", "GCAM", "SharingImage",
    "RelatedImages", "SocialImageEmbeds", "SocialVideoEmbeds", "Quotations",
    "AllNames", "Amounts", "TranslationInfo", "Extras",
]

# The theme codes a record must mention to be kept at extraction.
FILTER_CODES = [
    "INFO_HOAX", "INFO_RUMOR", "MEDIA_CENSORSHIP", "INTERNET_CENSORSHIP",
    "INTERNET_BLACKOUT", "CYBER_ATTACK", "SURVEILLANCE", "HATE_SPEECH",
    "FREESPEECH", "HEALTH_VACCINATION", "HEALTH_PANDEMIC",
]

# The six tone measures, in the order of the packed field.
TONE_COLUMNS = [
    "Tone_Overall", "Tone_Positive", "Tone_Negative",
    "Tone_Polarity", "Tone_Activity", "Tone_SelfGroup",
]

# Columns a prepared event table must have.
REQUIRED_COLUMNS = [
    "Record_ID", "Date", "Year", "Month", "Year_Month", "Country", "Latitude",
    "Longitude", "Themes", "Theme_Count", "Misinfo_Flag", "Tone_Overall",
    "Tone_Positive", "Tone_Negative", "Context_Category", "Tone_Category",
]

# Country spellings and the name each one stands for.
COUNTRY_ALIASES = {
    "United States": "USA",
    "United States of America": "USA",
    "U.S.": "USA",
    "UK": "United Kingdom",
    "Great Britain": "United Kingdom",
}

# Context code sets; arguments everywhere, these are the defaults.
CONTEXT_CODES = {
    "Political": ["ELECTION", "ELECTION_FRAUD", "GENERAL_GOVERNMENT", "EPU_POLICY",
                  "TAX_FNCACT_POLITICIAN"],
    "Economic": ["ECON_INFLATION", "ECON_BANKRUPTCY"],
    "Health": ["HEALTH_VACCINATION", "HEALTH_PANDEMIC", "WB_HEALTH"],
}

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("timestamp_queried", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("rows_matched", T.LongType()),
    T.StructField("status", T.StringType()),
])

FETCH_SCHEMA = T.StructType([
    T.StructField("Record_ID", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("word_count", T.LongType()),
    T.StructField("reason", T.StringType()),
])

ARTICLE_SCHEMA = T.StructType([
    T.StructField("Record_ID", T.StringType()),
    T.StructField("text", T.StringType()),
])
