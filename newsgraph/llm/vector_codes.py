"""Operator 11, vector code compression: product codes whose codebooks are learnt on tries of parts.

Vectors become integers and are cut into equal parts. The distinct parts of all vectors, with the
number of vectors that have them, are one sorted table; a range of it is a lexicographic trie. A
depth-first traversal carries the squared distances from all codebook entries to the prefix read so
far, so parts with a common prefix share what it costs; a leaf takes the nearest entry, and
adds its part, as often as it occurs, to the sums of that entry. Only those sums leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.repeats import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: A component x is floor(SCALE * x).
SCALE = 256
#: Leaves of the trie that are finished together, level by level.
LEAVES = 2048
#: Vectors that are looked at together.
ROWS = 4096
#: Rows of distinct parts in one range of the sorted table, about.
RANGE_ROWS = 500_000
#: Largest absolute integer component; squared distances then stay exact.
LARGEST = 1 << 24
#: Labels up to this number are sent to all tasks; more meet their vectors in a join.
LABELS_SENT = 100_000


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Whole numbers of the vectors, one row each; one that is shorter than ``width`` goes on with zeros."""
    lengths = np.asarray(vectors.value_lengths())
    flat = np.floor(SCALE * np.asarray(vectors.flatten(), np.float64))
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} in absolute value are not supported")
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat.astype(np.int64)
    return out


def sorted_bytes(parts: np.ndarray) -> np.ndarray:
    """Each row as bytes whose order is the lexicographic order of the numbers."""
    raised = np.ascontiguousarray((parts + (1 << 31)).astype(">u4"))
    return raised.view(np.dtype((np.void, 4 * parts.shape[1]))).ravel()


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, and the place of each row among them."""
    order = np.lexsort(parts.T[::-1])
    ranked = parts[order]
    new = np.ones(len(ranked), bool)
    new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], place


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` (ties to the lower), and its squared distance, for each of ``parts``.

    ``parts`` are distinct and in lexicographic order: the leaves of a trie, whose nodes are ranges
    of rows. Large nodes are visited depth first with an explicit stack, one accumulated vector of
    distances per frame; runs of small sibling subtrees are finished together.
    """
    n, depth = parts.shape
    entry, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return entry, error
    # the level at which a row leaves the path of the row before
    branch = np.zeros(n, np.int64)
    branch[1:] = (parts[1:] != parts[:-1]).argmax(1)

    def finish(level: int, low: int, high: int, sums: np.ndarray) -> None:
        starts, sums = np.array([low]), sums[None, :]
        for d in range(level, depth):
            opens = branch[low:high] <= d
            opens[0] = True
            children = low + np.flatnonzero(opens)
            parent = np.searchsorted(starts, children, "right") - 1
            sums = sums[parent] + (parts[children, d][:, None] - book[None, :, d]) ** 2
            starts = children
        if level == depth:  # nothing below: all of it is one leaf
            starts = np.array([low])
        best = sums.argmin(1)
        entry[starts], error[starts] = best, sums[np.arange(len(starts)), best]

    stack = [(0, 0, n, np.zeros(len(book), np.int64))]
    while stack:
        level, low, high, sums = stack.pop()
        if high - low <= LEAVES or level == depth:
            finish(level, low, high, sums)
            continue
        opens = branch[low:high] <= level
        opens[0] = True
        edges = np.append(low + np.flatnonzero(opens), high)
        frames, at = [], 0
        while at < len(edges) - 1:
            to = max(int(np.searchsorted(edges, edges[at] + LEAVES, "right")) - 1, at + 1)
            if to == at + 1 and edges[to] - edges[at] > LEAVES:  # one large child
                x = parts[edges[at], level]
                frames.append((level + 1, int(edges[at]), int(edges[to]), sums + (x - book[:, level]) ** 2))
            else:  # siblings that are finished together
                frames.append((level, int(edges[at]), int(edges[to]), sums))
            at = to
        stack += frames[::-1]
    return entry, error


def kept_vectors(vectors: DataFrame, vector: str) -> DataFrame:
    value = F.col(vector)
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(value.isNotNull() & sound).withColumn(vector, value.cast("array<double>"))


def distinct_parts(kept: DataFrame, vector: str, width: int) -> DataFrame:
    """Columns position, part, weight: the distinct parts in order, dealt to ranges, and how often each occurs."""
    size = width // PARTS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                whole = integers(batch.column(0).slice(low, ROWS), width)
                for position in range(PARTS):
                    parts, place = distinct(whole[:, position * size:(position + 1) * size])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(parts), position, np.int32)), pa.array([x.tobytes() for x in sorted_bytes(parts)], pa.binary()),
                         pa.array(np.bincount(place, minlength=len(parts)))], names=["position", "part", "weight"])

    counted = stored(kept.select(vector).mapInArrow(cut, "position int, part binary, weight long")
                     .groupBy("position", "part").agg(F.sum("weight").alias("weight")), "parts")
    ranges = max(PARTS, -(-counted.count() // RANGE_ROWS))
    return stored(counted.repartitionByRange(ranges, "position", "part").sortWithinPartitions("position", "part"), "trie")


def _numbers(parts: pa.Array, size: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(parts.to_pylist()), ">u4").astype(np.int64)
    return flat.reshape(len(parts), size) - (1 << 31)


def sums_of_round(trie: DataFrame, books: np.ndarray) -> DataFrame:
    """Columns position, entry, place, total: of the parts nearest to each entry, their sums by component; place -1 counts them."""
    size = books.shape[2]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((PARTS, books.shape[1], size + 1), np.int64)
        for batch in batches:
            where, weight = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            parts = _numbers(batch.column(1), size)
            for position in np.unique(where).tolist():
                own = where == position
                entry, _ = nearest(parts[own], books[position])
                np.add.at(totals[position, :, :size], entry, parts[own] * weight[own][:, None])
                np.add.at(totals[position, :, size], entry, weight[own])
        position, entry = np.nonzero(totals[:, :, size])
        if len(position):
            rows = totals[position, entry].ravel()
            repeat = lambda x: pa.array(np.repeat(x, size + 1).astype(np.int32))
            place = np.tile(np.append(np.arange(size), -1), len(position)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([repeat(position), repeat(entry), pa.array(place), pa.array(rows)],
                                             names=["position", "entry", "place", "total"])

    return (trie.select("position", "part", "weight").mapInArrow(kernel, "position int, entry int, place int, total long")
            .groupBy("position", "entry", "place").agg(F.sum("total").alias("total")))


def codebooks(kept: DataFrame, vector: str, key: str, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray | None:
    """The learnt entries by part position; None where no kept row has a key.

    They start as the parts of the rows with the smallest keys; of rows that share a key, the
    lexicographically smallest vector counts. An entry that is nearest to nothing stays.
    """
    named = kept.filter(F.col(key).isNotNull())
    least = [r[0] for r in named.select(key).distinct().orderBy(key).limit(entries).collect()]
    if not least:
        return None
    width = kept.agg(F.max(F.size(vector))).first()[0]
    width = max(1, -(-width // PARTS)) * PARTS
    first = dict(named.filter(F.col(key).isin(least)).groupBy(key).agg(F.min(vector)).collect())
    seeds = integers(pa.array([first[k] for k in least], pa.list_(pa.float64())), width)
    books = seeds.reshape(len(least), PARTS, -1).transpose(1, 0, 2).copy()
    if rounds:
        trie = distinct_parts(kept, vector, width)
    for _ in range(rounds):
        found: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums_of_round(trie, books).collect():  # as many numbers as the codebooks hold
            found.setdefault((r.position, r.entry), {})[r.place] = r.total
        for (position, entry), total in found.items():
            books[position, entry] = [total[i] // total[-1] for i in range(books.shape[2])]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The kept rows with ``code`` and ``error`` in place of their vector; other columns stay, these two are replaced."""
    width, size = PARTS * books.shape[2], books.shape[2]
    others = [c for c in vectors.columns if c not in (vector, "code", "error")]
    kept = kept_vectors(vectors, vector).select(*others, vector)
    schema = kept.select(*others, F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), ROWS):
                batch = whole.slice(low, ROWS)
                numbers = integers(batch.column(len(others)), width)
                codes, errors = np.zeros((len(batch), PARTS), np.uint8), np.zeros(len(batch), np.int64)
                for position in range(PARTS):
                    parts, place = distinct(numbers[:, position * size:(position + 1) * size])
                    entry, error = nearest(parts, books[position])
                    codes[:, position] = entry[place]
                    errors += error[place]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)], names=[*others, "code", "error"])

    return kept.mapInArrow(kernel, schema)


def compressed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
               rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """Per kept row: the key, code, error, label_error, codebooks_sha256.

    A null vector, or one with a null or non-finite component, drops its row. Rows that repeat a key
    are rows of their own; one without a key has a code, but starts no entry. Vectors of
    several lengths go on with zeros up to the longest, and that to a multiple of 16. Ties of
    distance go to the lower entry. Null labels count as one label. An empty table gives an empty
    result; where no kept row has a key there are no codebooks, and codes and errors are null. At most 256
    entries. Other columns are ignored.
    """
    vectors = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    kept = kept_vectors(vectors, "vector")
    books = codebooks(kept, "vector", "vec_id", rounds, entries)
    if books is None:
        return kept.select(F.col("vec_id").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    coded = stored(vector_codes(vectors, books, "vector"), "codes")
    by_label = stored(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if by_label.count() <= LABELS_SENT:
        by_label = F.broadcast(by_label)
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("vec_id").alias(key), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ASSIGN = """SELECT j, part, n, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT p.j, part, n, e, CAST(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM different p JOIN {book} b ON b.j = p.j) GROUP BY 1, 2, 3"""
_UPDATE = """SELECT b.j, b.e, coalesce(m.entry, b.entry) AS entry FROM {book} b LEFT JOIN (
    SELECT j, e, list(x ORDER BY i) AS entry FROM (
      SELECT j, e, i, CAST(floor(CAST(sum(n * part[i]) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS x
      FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM {near}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m
  ON m.j = b.j AND m.e = b.e"""

VECTOR_CODES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, j, v[j * len(v) // 16 + 1:(j + 1) * len(v) // 16] AS part FROM (SELECT r, v, unnest(range(16)) AS j FROM kept)),
different AS MATERIALIZED (SELECT j, part, count(*) AS n FROM parts GROUP BY 1, 2),
book0 AS MATERIALIZED (
  SELECT j, e, part AS entry FROM (
    SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept WHERE vec_id IS NOT NULL) s JOIN parts ON parts.r = s.r WHERE e < 64),
near0 AS MATERIALIZED ({_ASSIGN.format(book="book0")}),
book1 AS MATERIALIZED ({_UPDATE.format(book="book0", near="near0")}),
near1 AS MATERIALIZED ({_ASSIGN.format(book="book1")}),
book2 AS MATERIALIZED ({_UPDATE.format(book="book1", near="near1")}),
near2 AS MATERIALIZED ({_ASSIGN.format(book="book2")}),
digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j, e, i)) AS codebooks_sha256
  FROM (SELECT j, e, unnest(entry) AS x, unnest(range(1, len(entry) + 1)) AS i FROM book2)),
coded AS (
  SELECT parts.r, string_agg(printf('%02x', e), '' ORDER BY parts.j) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM parts JOIN near2 ON near2.j = parts.j AND near2.part = parts.part GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept ON kept.r = coded.r, digest
"""
