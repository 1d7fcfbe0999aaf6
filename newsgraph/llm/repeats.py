"""Where long passages of a corpus repeat: windows compacted into paths, refined by joins.

A *window* is a fixed number of consecutive symbols (words or bytes) of one document. The
smallest hash of the seeds (short runs) inside a window is its *anchor*: equal windows have
equal anchors, wherever they stand. Consecutive windows with one anchor, at one place, are a
*path*, the unit that travels; its windows all differ.

Each level of refinement does the same:

1. Paths: one row per path (anchor, hash of its content, coordinates).
2. Anchors met once are dropped. If all paths of an anchor are equal, the path does not
   branch, and is repeated as a whole.
3. Paths that branch are counted by content. What is still open is cut out of the texts by its
   source coordinates and goes to the next level, with longer seeds; at the last level the
   seed is the whole window.

At the end, repeated spans meet their texts again, and the hash of each span is checked
against the text at its coordinates before anything is removed.

All counts combine in part before a shuffle, so an anchor or path that a third of all
documents share costs a row per task. Windows are compared by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from newsgraph.llm.textkit import (PLAIN_WORD, Rolling, Slice, byte_symbols, merged, signed,
                                   sliding_min, slices, small, text_column)
from newsgraph.session import scratch_path


@dataclass(frozen=True)
class Unit:
    """What a window is made of, and the seed lengths of the levels; the last is the window.

    ``earlier``: a window counts as repeated where a smaller document holds it too;
    else wherever it stands at least twice.
    """

    words: bool
    window: int
    seeds: tuple[int, ...]
    earlier: bool

    def symbols(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash per symbol, first symbol per document (one more), start and end bytes."""
        if self.words:
            start, end, first = part.words(PLAIN_WORD)
            return part.word_hashes(start, end), first, start, end
        place = np.arange(len(part.data) + 1)
        return byte_symbols(part.data), part.offsets, place[:-1], place[1:]


PATHS = "anchor long, path long, doc long, base long, start long, n long, weight long"


def paths(source: DataFrame, unit: Unit, seed: int) -> DataFrame:
    """One row per path: ``n`` windows from symbol ``start`` of ``doc`` share ``anchor``.

    ``source``: doc, base (symbols of the document before this text), text, weight.
    """
    window = unit.window

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, bases, weights = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            for part in slices(batch.column(2)):
                symbols, first, _, _ = unit.symbols(part)
                if len(symbols) < window:
                    continue
                seeds = Rolling(symbols, 1).windows(seed)
                anchor = sliding_min(seeds, window - seed + 1)
                long = np.diff(first) >= window
                mark = np.zeros(len(anchor) + 1, np.int8)
                mark[first[:-1][long]] += 1
                mark[first[1:][long] - window + 1] -= 1
                valid = np.cumsum(mark[:-1], dtype=np.int8).view(bool)
                # a path ends where its anchor changes or stands once more, further right
                same = (anchor[1:] == anchor[:-1]) & (anchor[1:] != seeds[window - seed + 1:]) & valid[1:] & valid[:-1]
                begins, ends = valid.copy(), valid.copy()
                begins[1:] &= ~same
                ends[:-1] &= ~same
                start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
                doc = np.searchsorted(first, start, "right") - 1
                row = part.first + doc
                yield pa.RecordBatch.from_arrays(
                    [signed(anchor[start]), signed(Rolling(symbols).of(start, end + window - 1)),
                     pa.array(ids[row]), pa.array(bases[row]), pa.array(bases[row] + start - first[doc]),
                     pa.array(end - start), pa.array(weights[row])],
                    names=["anchor", "path", "doc", "base", "start", "n", "weight"])

    return source.select("doc", "base", "text", "weight").mapInArrow(kernel, PATHS)


def packed_texts(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys and ``packed``: each text compressed, so that a shuffle of texts stays small."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in small(batches):
            texts = [pack.compress(t) if t is not None else None for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())],
                                             names=[*keys, "packed"])

    return (docs.select(*[F.col(k).cast("long").alias(k) for k in keys], text_column(docs))
            .mapInArrow(kernel, ", ".join(f"{k} long" for k in keys) + ", packed binary"))


def unpacked(batch: pa.RecordBatch, column: int) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(t) if t is not None else b"" for t in batch.column(column).to_pylist()]


def _spans(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of arrays of (start, n, hash): lengths of the arrays, and the flat fields."""
    lists = batch.column(column)
    counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    flat = lists.flatten()
    field = lambda i: np.asarray(flat.field(i), np.int64)
    return counts, field(0), field(1), field(2).view(np.uint64)


def snippets(source: DataFrame, requests: DataFrame, unit: Unit) -> DataFrame:
    """The texts of the requested paths (doc, base, start, n, path, weight), as a new source."""
    wanted = requests.groupBy("doc", "base").agg(
        F.collect_list(F.struct("start", "n", F.col("path").alias("hash"), "weight")).alias("spans"))
    window = unit.window

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            ids, bases = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            counts, start, n, path = _spans(batch, 3)
            weight = np.asarray(batch.column(3).flatten().field(3), np.int64)
            limits = np.concatenate([[0], np.cumsum(counts)])
            for part in slices(pa.array(unpacked(batch, 2), pa.large_binary())):
                symbols, first, starts, ends = unit.symbols(part)
                own = slice(limits[part.first], limits[part.first + part.size])
                doc = np.repeat(np.arange(part.size), counts[part.first:part.first + part.size])
                at, length = start[own] - bases[part.first + doc] + first[doc], n[own] + window - 1
                right = at + length <= first[doc + 1]
                right &= Rolling(symbols).of(np.where(right, at, 0), np.where(right, at + length, 0)) == path[own]
                at, length, doc = at[right], length[right], doc[right]
                data = part.data.tobytes()
                texts = [data[i:j] for i, j in zip(starts[at].tolist(), ends[at + length - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part.first + doc]), pa.array(start[own][right]), pa.array(texts, pa.binary()),
                     pa.array(weight[own][right])], names=["doc", "base", "text", "weight"])

    return (wanted.join(packed_texts(source, "doc", "base"), ["doc", "base"])
            .select("doc", "base", "packed", "spans")
            .mapInArrow(kernel, "doc long, base long, text binary, weight long"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read again: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """Columns doc, start, n, hash: ``n`` repeated windows from symbol ``start`` on.

    Documents without an id take no part. Every repeated window lies in at least one span.
    """
    source = (docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
              .select(F.col("doc_id").cast("long").alias("doc"), F.lit(0).cast("long").alias("base"),
                      text_column(docs), F.lit(1).cast("long").alias("weight")))
    found = []
    for level, seed in enumerate(unit.seeds):
        occurrences = paths(source, unit, seed)
        mass = ([F.min("doc").alias("least"), F.max("doc").alias("most")] if unit.earlier
                else [F.sum("weight").alias("mass")])
        anchors = occurrences.groupBy("anchor").agg(F.min("path").alias("low"), F.max("path").alias("high"), *mass)
        anchors = (anchors.filter("least < most" if unit.earlier else "mass > 1")
                   .selectExpr("anchor", "low = high as single", *(["least"] if unit.earlier else [])))
        # a written table: the join may then deal the rows of a hot anchor to several tasks
        live = stored(occurrences.join(stored(anchors, f"anchors{level}"), "anchor"), f"paths{level}")
        whole = live.filter("single and least < doc" if unit.earlier else "single")
        branching = live.filter("not single").drop("single", "least")
        by_path = branching.groupBy("anchor", "path").agg(
            *([F.min("doc").alias("least")] if unit.earlier else
              [F.sum("weight").alias("mass"), F.min(F.struct("doc", "base", "start", "n")).alias("first")]))
        by_path = stored(by_path, f"contents{level}")
        settled = branching.join(by_path, ["anchor", "path"])
        span = ["doc", "start", "n", "path as hash"]
        found += [whole.selectExpr(*span),
                  settled.filter("least < doc" if unit.earlier else "mass > 1").selectExpr(*span)]
        if level + 1 < len(unit.seeds):
            if unit.earlier:  # every place in the smallest document is still open
                still = settled.filter("least = doc").select("doc", "base", "start", "n", "path", "weight")
            else:  # one place of each content; what is repeated already only shows it to others
                still = by_path.select("first.*", "path", F.least("mass", F.lit(2).cast("long")).alias("weight"))
            source = stored(snippets(source, still, unit), f"snippets{level}")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def removed(docs: DataFrame, spans: DataFrame, unit: Unit,
            finish: Callable[[bytes, list[tuple[int, int]], np.ndarray, np.ndarray], tuple],
            schema: str) -> DataFrame:
    """``finish(text, ranges, starts, ends)`` per document, over its verified repeated ranges.

    ``spans``: doc, start, n, hash. Ranges are in symbols, maximal and in order. A span counts
    if the text at its coordinates has its hash, so rows that share an id cannot mix up.
    """
    window = unit.window
    wanted = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "hash")).alias("spans"))
    fields = [f.split()[0] for f in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            if not len(batch):
                continue
            texts = unpacked(batch, 1)
            counts, start, n, digest = _spans(batch, 2)
            limits = np.concatenate([[0], np.cumsum(counts)])
            out: list[tuple] = []
            for part in slices(pa.array(texts, pa.large_binary())):
                symbols, first, starts, ends = unit.symbols(part)
                low, high = limits[part.first], limits[part.first + part.size]
                right = np.zeros(0, bool)
                if high > low:
                    doc = np.repeat(np.arange(part.size), counts[part.first:part.first + part.size])
                    at, length = start[low:high] + first[doc], n[low:high] + window - 1
                    right = at + length <= first[doc + 1]
                    safe = np.where(right, at, 0), np.where(right, at + length, 0)
                    right &= Rolling(symbols).of(*safe) == digest[low:high]
                for i in range(part.size):
                    k = part.first + i
                    mine = slice(limits[k], limits[k + 1])
                    ok = right[limits[k] - low:limits[k + 1] - low]
                    begin = start[mine][ok]
                    ranges = merged(list(zip(begin.tolist(), (begin + n[mine][ok] + window - 1).tolist())))
                    own = slice(first[i], first[i + 1])
                    out.append(finish(texts[k], ranges, starts[own] - part.offsets[i],
                                      ends[own] - part.offsets[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c) for c in zip(*out)],
                                             names=["doc_id", *fields])

    return (packed_texts(docs, "doc_id").join(wanted, F.col("doc_id") == F.col("doc"), "left")
            .select("doc_id", "packed", "spans").mapInArrow(kernel, f"doc_id long, {schema}"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
