"""Operator 5, exact top-k search: a Voronoi join of queries and data.

Pivots, a bounded sample of the vectors, divide space into cells. Each cell's summary (size,
radius, largest norm) bounds the inner product that a query can reach in it. A query first meets
blocks of the cells where it may expect most, which gives a score to beat; then it is replicated
only to the cells whose bound is no less. A cell is dealt to blocks of bounded size by a hash of
the id, so a cell with a third of all vectors is many blocks; queries go in blocks too, and every
pair of blocks is solved by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsgraph.llm.repeats import stored

#: Scale of the integer components, answers per query, most pivots, vectors of a block.
SCALE, TOP, PIVOTS, BLOCK = 256, 5, 64, 2048

#: Below any score; its negative is a number too.
_NONE = -(1 << 62)

_RESULT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """Columns vec_id, x (array of long): floor(SCALE * component), the component as double.

    Left out: rows without an id or vector, empty vectors, and vectors with a null or
    non-finite component.
    """
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
            .filter(good)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE)).alias("x")))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows by vector length: (row numbers, matrix)."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    ends = np.cumsum(lengths)
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out.append((rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]))
    return out


def in_cells(vectors: DataFrame, pivots: dict[int, np.ndarray], blocks: int) -> DataFrame:
    """Adds dim, cell (nearest pivot of that length), block, radius and norm."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            dim, cell = np.zeros(n, np.int64), np.zeros(n, np.int64)
            radius, norm = np.zeros(n), np.zeros(n)
            for rows, x in _matrix(batch.column(1)):
                x = x.astype(float)
                p = pivots[x.shape[1]].astype(float)
                far = (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T
                near = far.argmin(1)
                dim[rows], cell[rows] = x.shape[1], near
                radius[rows] = np.sqrt(((x - p[near]) ** 2).sum(1)) + 1e-6
                norm[rows] = np.sqrt((x * x).sum(1)) + 1e-6
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (dim, cell, radius, norm))],
                                             names=["vec_id", "x", "dim", "cell", "radius", "norm"])

    return vectors.mapInArrow(kernel, "vec_id long, x array<long>, dim long, cell long, radius double, norm double") \
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)))


def _packed(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per block: its ids, and its vectors as one list."""
    return rows.groupBy("dim", *keys).agg(F.collect_list(F.struct("vec_id", "x")).alias("rows"))


def _solve(pairs: DataFrame, top: int) -> DataFrame:
    """Best ``top`` candidates of each query in each pair of blocks (queries, data)."""
    def side(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
        rows = column[i].values
        ids = np.asarray(rows.field(0), np.int64)
        return ids, np.asarray(rows.field(1).flatten(), np.int64).reshape(len(ids), -1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q, x = side(batch.column(0), i)
                c, y = side(batch.column(1), i)
                order = np.argsort(c, kind="stable")
                c, y = c[order], y[order]
                # doubles hold these products exactly while sums stay below 2**53
                small = np.abs(x).max(initial=0) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2 ** 53
                for low in range(0, len(q), 256):
                    ids = q[low:low + 256]
                    score = (x[low:low + 256].astype(float) @ y.T.astype(float)).astype(np.int64) if small \
                        else x[low:low + 256] @ y.T
                    score[ids[:, None] == c] = _NONE
                    best = np.argsort(-score, axis=1, kind="stable")[:, :top] if len(c) <= 4 * top else _top(score, top)
                    keep = np.take_along_axis(score, best, 1)
                    row, col = np.nonzero(keep > _NONE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row]), pa.array(c[best[row, col]]), pa.array(keep[row, col])],
                        names=["query_id", "vec_id", "score"])

    return pairs.select("queries", "data").mapInArrow(kernel, _RESULT)


def _top(score: np.ndarray, top: int) -> np.ndarray:
    """Columns of the ``top`` largest values per row, ties to smaller columns, in order."""
    least = -np.partition(-score, top - 1, axis=1)[:, top - 1:top]
    out = np.zeros((len(score), top), np.int64)
    for i in range(len(score)):
        some = np.flatnonzero(score[i] >= least[i])
        out[i] = some[np.argsort(-score[i, some], kind="stable")][:top]
    return out


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Columns query_id, rank, vec_id, score: the ``top`` largest inner products of each query.

    Both tables have vec_id and embedding. A vector with the query's own id is no candidate;
    ties go to the smaller vec_id; with fewer candidates all are returned. Vectors of different lengths do
    not meet. See ``integer_vectors`` for what takes no part. A repeated row is a candidate of
    its own; a repeated query id is answered as one query. Other columns are ignored.
    """
    data = stored(integer_vectors(vectors), "vectors")
    asked = integer_vectors(queries)
    # at most ``pivots`` rows, the same ones in any run
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(pivots).collect()
    dims = [r.n for r in data.select(F.size("x").alias("n")).distinct().collect()]
    points = {n: np.array([r.x for r in sample if len(r.x) == n] or [[0] * n], np.int64) for n in dims}
    count = data.count()
    celled = stored(in_cells(data, points, max(1, -(-count // block))), "cells")
    summary = celled.groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm"),
        F.countDistinct("block").alias("blocks")).collect()  # one row per pivot at most
    asked_known = asked.filter(F.size("x").isin(dims)) if dims else asked.filter("false")
    number = asked.count()
    cells: dict[int, list] = {}
    for r in summary:
        cells.setdefault(r.dim, []).append((r.cell, r.n, r.radius, r.norm, points[r.dim][r.cell]))
    # blocks of a cell: its share of the vectors over the size of a block
    share = F.create_map(*[x for r in summary for x in (F.lit(f"{r.dim},{r.cell}"), F.lit(max(1, -(-r.n // block))))]) \
        if summary else F.create_map(F.lit(""), F.lit(1))
    key = F.concat_ws(",", "dim", "cell")
    celled = celled.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), share[key].cast("long")))
    blocks = stored(_packed(celled, "cell", "block").withColumnRenamed("rows", "data"), "blocks")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = batch.column(1)
            for at, x in _matrix(rows):
                own = cells[x.shape[1]]
                p = np.array([c[4] for c in own], float)
                n, radius, norm = (np.array([c[i] for c in own], float) for i in (1, 2, 3))
                length = np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
                most = np.minimum(x @ p.T + length * radius, length * norm) + 1e-3
                for i, k in enumerate(at.tolist()):
                    out += [(k, own[j][0], most[i, j], int(r)) for r, j in enumerate(np.argsort(-most[i], kind="stable"))]
            if out:
                k, cell, most, rank = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(k)), rows.take(pa.array(k)), pa.array(cell, pa.int64()),
                     pa.array(most, pa.float64()), pa.array(rank, pa.int64())],
                    names=["vec_id", "x", "cell", "most", "place"])

    sent = asked_known.select("vec_id", "x").mapInArrow(
        bounds, "vec_id long, x array<long>, cell long, most double, place long").withColumn("dim", F.size("x").cast("long"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-number // block))).cast("long")).alias("part")

    def met(rows: DataFrame, data_blocks: DataFrame) -> DataFrame:
        packed = _packed(rows.withColumn("part", part), "cell", "part").withColumnRenamed("rows", "queries")
        return _solve(packed.join(data_blocks, ["dim", "cell"]), top)

    # a first answer from one block each of the three most promising cells
    first = met(sent.filter("place < 3"), blocks.filter("block = 0"))
    floor = _best(first, top).groupBy("query_id").agg(F.count("*").alias("have"), F.min("score").alias("least"))
    floor = stored(floor.filter(F.col("have") >= top).select("query_id", "least"), "floor")
    open_ = (sent.join(floor, F.col("vec_id") == F.col("query_id"), "left")
             .filter(F.col("least").isNull() | (F.col("most") >= F.col("least"))).drop("query_id", "least"))
    return _best(met(open_, blocks), top).select(
        "query_id", "rank", "vec_id", "score")


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50, candidates all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


#: The same for DuckDB.
VORONOI_KNN_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
