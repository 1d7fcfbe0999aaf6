"""Operator 1, substring dedup: repeated 50-word passages stay in the smallest document only.

Not by k-mer edges, degrees and compaction through joins: runs of consecutive windows that share a
smallest k-mer (a minimiser) are paths, cut in the task that reads the document. Joins count their
anchors and hashes and settle those that do not branch; open ones are cut again with longer seeds,
and source coordinates verify every span (``repeats``). The windows have 50 words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from newsgraph.llm.repeats import Unit, removed, repeated_spans, sha256

#: k-mers of 20, then 40 words find and split paths of 50-word windows.
WORDS = Unit(words=True, window=50, seeds=(20, 40, 50), earlier=True)


def keep_words(text: bytes, ranges: list, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Words, removed words, and the kept words joined by one space."""
    gone = np.zeros(len(starts), bool)
    for low, high in ranges:
        gone[low:high] = True
    kept = b" ".join(text[i:j] for i, j in zip(starts[~gone].tolist(), ends[~gone].tolist()))
    return len(starts), int(gone.sum()), kept


def substring_dedup(docs: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, text (what is kept).

    A word goes if a window over it also starts in a document with a smaller id; windows are
    judged on the input. A null text has no words. A row without an id is kept as it is and
    removes nothing elsewhere. Rows that share an id do not remove each other's words. Other
    columns are ignored.
    """
    def finish(text, ranges, starts, ends):
        n_words, n_removed, kept = keep_words(text, ranges, starts, ends)
        return n_words, n_removed, kept

    return removed(docs, repeated_spans(docs, unit), unit, finish,
                   "n_words long, n_removed long, kept binary")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the deduplicated texts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def finish(text, ranges, starts, ends):
        n_words, n_removed, kept = keep_words(text, ranges, starts, ends)
        return n_words, n_removed, sha256(kept)

    return removed(docs, repeated_spans(docs, WORDS), WORDS, finish,
                   "n_words long, n_removed long, kept_sha256 string")
