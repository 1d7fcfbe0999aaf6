"""A training corpus from raw documents: five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.decontaminate import clean_documents
from newsgraph.llm.jaccard_join import one_of_each
from newsgraph.llm.language_id import UNKNOWN, predict, train
from newsgraph.llm.line_dedup import without_repeated_lines
from newsgraph.llm.packing import packing
from newsgraph.llm.repeats import stored
from newsgraph.llm.textkit import free_name
from newsgraph.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell, however surely; it is learnt from ``docs`` itself.

    Those without a letter go, null and empty texts too. A null ``lang`` becomes the predicted one; all
    else stays as it is, columns of any name and repeated rows included. Where no document
    has a label to learn from, all stay.
    """
    ship_package(spark)
    model = train(docs)
    if not model.languages:
        return docs
    names: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in ("lang_pred", "score"):
            names[c] = free_name([*docs.columns, *names.values()], f"{c}_")
    judged = predict(docs.withColumnsRenamed(names), model).filter(F.col("lang_pred") != UNKNOWN)
    judged = judged.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "score")
    return judged.withColumnsRenamed({own: c for c, own in names.items()}).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five documents hold stay in the last of them only.

    All rows and columns stay, null and empty texts and rows without an id as they are; rows that
    share an id count as one document.
    """
    ship_package(spark)
    return without_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Rows without an id or without words stay, and all rows that repeat a kept id.
    """
    ship_package(spark)
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts hold none."""
    ship_package(spark)
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of one length; a null or empty text is its end id.

    Repeated rows and rows without an id are packed like others; further columns go.
    """
    ship_package(spark)
    return packing(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies),
          ("decontaminate", decontaminate), ("pack", pack)]

#: Learnt weights and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
