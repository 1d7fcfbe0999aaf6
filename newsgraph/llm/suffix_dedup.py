"""Operator 3, suffix-array dedup: every byte of a 200-byte string that stands twice goes.

Refinement of common prefixes over shards (``repeats``): each task hashes the runs of its own
texts, blocks of equal prefixes are counted across all tasks, blocks of one suffix are final,
and only what is still open is refined with a longer prefix, 64, 160 and then 200 bytes.
Suffixes are never sorted again, and no suffix array or Burrows-Wheeler string is gathered.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from newsgraph.llm.repeats import Unit, removed, repeated_spans, sha256

BYTES = Unit(words=False, window=200, seeds=(64, 160, 200), earlier=False)


def keep_bytes(text: bytes, ranges: list, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs, and the remaining bytes."""
    at, kept = 0, []
    for low, high in ranges:
        kept.append(text[at:low])
        at = high
    kept.append(text[at:])
    rest = b"".join(kept)
    return len(text), len(text) - len(rest), len(ranges), rest


def suffix_dedup(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes).

    A byte goes if a string of ``unit.window`` bytes over it starts anywhere else too, in the
    same document or another; strings are judged on the input and do not cross documents. A
    null text is empty. A row without an id is kept as it is and removes nothing elsewhere. Each
    row counts, so a repeated row removes and is removed. Other columns are ignored.
    """
    return removed(docs, repeated_spans(docs, unit), unit, keep_bytes,
                   "n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what remains of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def finish(text, ranges, starts, ends):
        *counts, kept = keep_bytes(text, ranges, starts, ends)
        return *counts, sha256(kept)

    return removed(docs, repeated_spans(docs, BYTES), BYTES, finish,
                   "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
