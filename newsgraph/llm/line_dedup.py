"""Operator 4, line dedup: long lines that five documents hold stay in the last of them only.

Two Bloom filters over line hashes, one for once-seen and one for twice-seen lines, are built
per task, cut into slices, and merged slice by slice. The twice-seen filter, of fixed size, is
broadcast; only lines that it suspects are shuffled, as digests, for exact counts per line and
the choice of the document that keeps it. More lines than the filter is made for make more
suspects, never a different result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.repeats import packed_texts, sha256, stored, unpacked
from newsgraph.llm.textkit import SPACES, free_name, small, text_column

#: Shortest key that counts, in code points, and the documents that make it a repeated line.
MIN_CHARS, MIN_DOCS = 40, 5
#: Slices of each filter and bits of a slice: 16 MB a filter.
SLICES, SLICE_BITS = 2048, 1 << 16


def line_key(line: bytes) -> bytes | None:
    """The line stripped of ASCII white space, A-Z lower-cased; None if it is too short."""
    key = line.strip(SPACES)
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return key.lower()


def _hashes(text: bytes) -> dict[int, bytes]:
    """Hash to key, of the distinct long lines of a text."""
    keys = {key for line in set(text.split(b"\n")) if len(line) >= MIN_CHARS and (key := line_key(line))}
    return {xxhash.xxh3_64_intdigest(key): key for key in keys}


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slice of each hash, and the two bits it sets there, as an (n, 2) array."""
    bits = np.stack([hashes & np.uint64(SLICE_BITS - 1), hashes >> np.uint64(16) & np.uint64(SLICE_BITS - 1)], 1)
    return (hashes >> np.uint64(53)).astype(np.int64), bits.astype(np.int64)


class Filter:
    """A sliced Bloom filter; only slices that are used take memory."""

    def __init__(self, slices: dict[int, np.ndarray] | None = None):
        self.slices = slices or {}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        number, bits = _places(hashes)
        out = np.zeros(len(hashes), bool)
        for i, (s, (a, b)) in enumerate(zip(number.tolist(), bits.tolist())):
            own = self.slices.get(s)
            out[i] = own is not None and own[a >> 3] >> (a & 7) & 1 and own[b >> 3] >> (b & 7) & 1
        return out

    def add(self, hashes: np.ndarray) -> None:
        number, bits = _places(hashes)
        for s, pair in zip(number.tolist(), bits.tolist()):
            own = self.slices.get(s)
            if own is None:
                own = self.slices[s] = np.zeros(SLICE_BITS // 8, np.uint8)
            for bit in pair:
                own[bit >> 3] |= 1 << (bit & 7)


def seen_twice(docs: DataFrame) -> DataFrame:
    """The twice-seen filter: slice, bits; at most ``SLICES`` rows of 8 KB, compressed."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(), Filter()
        for batch in small(batches):
            found = [np.fromiter(_hashes(t), np.uint64) for t in batch.column(0).to_pylist() if t]
            if not found:
                continue
            hashes, counts = np.unique(np.concatenate(found), return_counts=True)
            twice.add(hashes[(counts > 1) | once.has(hashes)])
            once.add(hashes)
        none = np.zeros(SLICE_BITS // 8, np.uint8)
        for s, bits in once.slices.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([s]), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary()),
                 pa.array([zlib.compress(twice.slices.get(s, none).tobytes(), 1)], pa.binary())],
                names=["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
                if s in once:
                    twice[s] = twice[s] | b | once[s] & a
                    once[s] = once[s] | a
                else:
                    once[s], twice[s] = a, b
        for s, bits in twice.items():
            if bits.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s]), pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["slice", "bits"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (docs.filter(F.col("doc_id").isNotNull()).select(text_column(docs))
            .mapInArrow(build, "slice long, once binary, twice binary")
            .repartition(parts, "slice").mapInArrow(merge, "slice long, bits binary"))


def dropped_keys(docs: DataFrame) -> DataFrame:
    """Columns doc, drop: digests of the line keys that a document loses.

    A key goes if at least ``MIN_DOCS`` different ids hold it, from all but the largest of them.
    """
    twice = {r["slice"]: bytes(r.bits) for r in seen_twice(docs).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(twice)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter({s: np.frombuffer(zlib.decompress(b), np.uint8) for s, b in shared.value.items()})
        for batch in small(batches):
            found = [_hashes(t) if t else {} for t in batch.column(1).to_pylist()]
            hashes = np.fromiter((h for f in found for h in f), np.uint64)
            keys = [key for f in found for key in f.values()]
            doc = np.repeat(np.asarray(batch.column(0)), [len(f) for f in found])
            at = np.flatnonzero(known.has(hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at], pa.int64()), pa.array([_digest(keys[i]) for i in at.tolist()], pa.binary())],
                names=["doc", "key"])

    held = stored(docs.filter(F.col("doc_id").isNotNull())
                  .select(F.col("doc_id").cast("long").alias("doc"), text_column(docs))
                  .mapInArrow(suspects, "doc long, key binary"), "suspects")
    repeated = stored(held.groupBy("key").agg(F.countDistinct("doc").alias("docs"), F.max("doc").alias("keeper"))
                      .filter(F.col("docs") >= MIN_DOCS), "repeated")
    return (held.join(repeated, "key").filter(F.col("doc") != F.col("keeper"))
            .groupBy("doc").agg(F.collect_set("key").alias("drop")))


def kept_lines(text: bytes | None, drop: set[bytes]) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the text without them."""
    lines = (text or b"").split(b"\n")
    kept = [x for x in lines if not (drop and len(x) >= MIN_CHARS and (k := line_key(x)) and _digest(k) in drop)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def line_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept (binary).

    A null or empty text is one empty line. Rows without an id keep all lines and count for
    nothing. Rows that share an id count as one document. Other columns are ignored.
    """
    return _applied(docs, lambda kept: kept, "kept binary")


def _applied(docs: DataFrame, finish, field: str) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = [kept_lines(t, set(d or ())) for t, d in zip(unpacked(batch, 1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([finish(o[2]) for o in out], pa.string() if field.endswith("string") else pa.binary())], names=["doc_id", "n_lines", "n_dropped", field.split()[0]])

    return (packed_texts(docs, "doc_id").join(dropped_keys(docs), F.col("doc_id") == F.col("doc"), "left")
            .select("doc_id", "packed", "drop")
            .mapInArrow(kernel, f"doc_id long, n_lines long, n_dropped long, {field}"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text rewritten; documents that lose nothing, null texts included, stay as they are.

    ``n_chars``, if there is such a column, follows the new text. All rows and columns stay.
    """
    doc_name, drop_name = free_name(docs.columns, "doc_"), free_name(docs.columns, "drop_")
    drop = dropped_keys(docs).withColumnsRenamed({"doc": doc_name, "drop": drop_name})

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            text = batch.schema.get_field_index("text")
            lists = batch.column(batch.schema.get_field_index(drop_name)).to_pylist()
            new = [kept_lines(t.encode(), set(d))[2].decode() if d and t is not None else t
                   for t, d in zip(batch.column(text).to_pylist(), lists)]
            columns = list(batch.columns)
            columns[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    joined = docs.join(drop, docs["doc_id"] == drop[doc_name], "left").drop(doc_name)
    joined = joined.mapInArrow(rewrite, joined.schema).drop(drop_name)
    return joined.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else joined


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _applied(docs, sha256, "kept_sha256 string")


#: The same for DuckDB.
LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines
  WHERE length(key) >= 40 AND doc_id IS NOT NULL GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM lines l LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
