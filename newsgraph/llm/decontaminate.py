"""Operator 7, benchmark decontamination: words of documents that repeat a benchmark passage.

The windows of all benchmark items (10 words each, normalised) are a hash set that every task
gets as a broadcast; token windows of the documents are looked up in it, and hits are verified
word by word. One scan of the documents, no shuffle. The set is broadcast in blocks of at most
``BLOCK_WINDOWS`` windows; if a benchmark has more, the documents are scanned once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.repeats import stored
from newsgraph.llm.textkit import ALNUM_WORD, Rolling, Slice, fold_case, free_name, slices, small, text_column

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: Most windows in one broadcast, about 40 MB with their words.
BLOCK_WINDOWS = 200_000

_BITS = 20


def _words(part: Slice) -> tuple[Slice, np.ndarray, np.ndarray, np.ndarray]:
    folded = Slice(part.first, fold_case(part.data), part.offsets)
    return folded, *folded.words(ALNUM_WORD)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: hash, n (words), words, items (ids as strings, null ids left out)."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            items = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                folded, start, end, first = _words(part)
                rolling = Rolling(folded.word_hashes(start, end))
                data = folded.data.tobytes()
                rows = []
                for i in range(part.size):
                    low, high = int(first[i]), int(first[i + 1])
                    n = min(window, high - low)
                    for at in range(low, high - n + 1) if n else ():
                        words = [data[a:b] for a, b in zip(start[at:at + n].tolist(), end[at:at + n].tolist())]
                        digest = rolling.of(np.array([at]), np.array([at + n])).view(np.int64)[0]
                        rows.append((int(digest), n, b" ".join(words), items[part.first + i]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                        names=["hash", "n", "words", "item"])

    return (benchmark.select(F.col("item_id").cast("string").alias("item"), text_column(benchmark))
            .mapInArrow(kernel, "hash long, n long, words binary, item string")
            .groupBy("hash", "n", "words").agg(F.collect_set("item").alias("items")))


def _scan(docs: DataFrame, block: list) -> DataFrame:
    """Adds the hits of one block: (start word, words) ranges and item ids."""
    spark = docs.sparkSession
    table: dict[int, list] = {}
    for row in block:
        table.setdefault(row.hash & (1 << 64) - 1, []).append((bytes(row.words), sorted(row["items"])))
    shared = spark.sparkContext.broadcast((sorted({r.n for r in block}), table))
    names = docs.columns
    hits_at, items_at, text_at = names.index("hits"), names.index("items"), names.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, known = shared.value
        keys = np.sort(np.fromiter(known, np.uint64, len(known)))
        maybe = np.zeros(1 << _BITS, bool)
        maybe[keys & np.uint64((1 << _BITS) - 1)] = True
        for batch in small(batches):
            hits = [x or [] for x in batch.column(hits_at).to_pylist()]
            items = [x or [] for x in batch.column(items_at).to_pylist()]
            for part in slices(batch.column(text_at)):
                folded, start, end, first = _words(part)
                data = folded.data
                rolling = Rolling(folded.word_hashes(start, end))
                for n in lengths:
                    digest = rolling.windows(n)
                    at = np.flatnonzero(maybe[digest & np.uint64((1 << _BITS) - 1)])
                    place = np.minimum(np.searchsorted(keys, digest[at]), len(keys) - 1)
                    at = at[keys[place] == digest[at]]
                    doc = np.searchsorted(first, at, "right") - 1
                    inside = at + n <= first[doc + 1]
                    for i, k in zip(at[inside].tolist(), doc[inside].tolist()):
                        words = b" ".join(data[a:b].tobytes() for a, b in
                                          zip(start[i:i + n].tolist(), end[i:i + n].tolist()))
                        for known_words, ids in known[int(digest[i])]:
                            if words == known_words:
                                hits[part.first + k].append({"start": i - int(first[k]), "n": n})
                                items[part.first + k].extend(ids)
            columns = list(batch.columns)
            columns[hits_at] = pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))
            columns[items_at] = pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(kernel, docs.schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with hits (array of start word, words) and items (ids of items met, sorted).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Null texts and
    items without words meet nothing; an item without an id marks words, but is not listed. Columns
    of ``docs`` named hits or items are replaced.
    """
    windows = stored(benchmark_windows(benchmark, window), "windows")
    blocks = -(-windows.count() // block_windows)
    found = docs.withColumn("hits", F.lit(None).cast("array<struct<start:bigint,n:bigint>>")).withColumn(
        "items", F.lit(None).cast("array<string>"))
    for block in range(blocks):
        # hashes are even, so a block is close to its share; twice the bound would be a failure of the hash
        part = windows.filter(F.pmod(F.col("hash"), F.lit(blocks)) == block) if blocks > 1 else windows
        found = _scan(found, part.collect())
        if block + 1 < blocks:
            found = stored(found, "hits")
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with the columns of ``docs``.

    Clean rows pass as they are, repeated rows and null texts included; an empty benchmark or
    an empty table removes nothing.
    """
    names: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in ("hits", "items"):
            names[c] = free_name([*docs.columns, *names.values()], f"{c}_")
    kept = benchmark_hits(docs.withColumnsRenamed(names), benchmark)
    kept = kept.filter(F.coalesce(F.size("hits"), F.lit(0)) <= 0).drop("hits", "items")
    return kept.withColumnsRenamed({own: c for c, own in names.items()})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, texts, hits, items = (batch.column(c) for c in ("doc_id", "text", "hits", "items"))
            hits, items = hits.to_pylist(), items.to_pylist()
            n_words, n_hit = [], []
            for part in slices(texts):
                first = _words(part)[3]
                n_words += np.diff(first).tolist()
                for i in range(part.size):
                    covered: set[int] = set()
                    for h in hits[part.first + i] or ():
                        covered.update(range(h["start"], h["start"] + h["n"]))
                    n_hit.append(len(covered))
            digests = [hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array([len(x or ()) for x in items], pa.int64()), pa.array(digests, pa.string()),
                 pa.array([n > 0 for n in n_hit], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(kernel, "doc_id long, n_words long, n_hit long, n_items long, "
                                    "items_sha256 string, contaminated boolean")
