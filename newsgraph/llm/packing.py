"""Operator 10, packing: documents as token sequences of one length, by multiway differencing.

Documents are tokenised and cut: whole windows of 2048 tokens first, then shorter pieces. The
short pieces are packed block by block, within the partition that made them; only what is left of
a partition, less than a block, is shuffled and packed with the rest of others, so that padding does
not follow the layout of files. In a block, Karmarkar-Karp differencing merges partial partitions with
opposing imbalances into near-equal windows; while the fullest exceeds the capacity, one window is added.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsgraph.llm.repeats import stored
from newsgraph.llm.textkit import text_column
from newsgraph.llm.wordcodes import groups, tokenizer_path, word_codes

CAPACITY = 2048
#: The id after each document.
END = 1
#: Longest piece of a document's rest after its whole windows.
PIECE = 512
#: Pieces that are packed together.
BLOCK = 1000
#: Blocks of a task that packs what partitions leave, about.
REST_BLOCKS = 4
#: Sequence ids of a task begin at its number times this; those of rests lie behind all others.
_TASK_IDS = 1 << 40
_REST_TASKS = 1 << 22
_END = np.array([END], "<u4").tobytes()

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(tokenizer: str, capacity: int, piece: int, keep_ids: bool) -> Kernel:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_codes(tokenizer) as codes:
            for batch in batches:
                low = 0
                for texts in groups([t or b"" for t in batch.column(1).to_pylist()]):
                    part = batch.slice(low, len(texts))
                    low += len(texts)
                    rows: list[list] = [[] for _ in range(6)]
                    for k, ids in enumerate(codes(texts)):
                        ids += _END
                        total, at = len(ids) // 4, 0
                        while at < total:
                            size = capacity if total - at >= capacity else min(piece, total - at)
                            own = ids[4 * at:4 * (at + size)]
                            for values, value in zip(rows, (k, at, size, zlib.crc32(own), total, own)):
                                values.append(value)
                            at += size
                    columns = [part.column(0).take(pa.array(rows[0])), *[pa.array(c, pa.int64()) for c in rows[1:5]]]
                    if keep_ids:
                        columns.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in rows[5]],
                                                pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return kernel


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, piece: int = PIECE,
                 keep_ids: bool = False) -> DataFrame:
    """Pieces of the tokenised documents: doc_id, start, length, ids_crc32, doc_tokens[, ids].

    ``tokenizer`` is the path of a vocabulary file that every machine has. A null or empty text
    is the end id alone. Repeated rows and rows without an id are documents like others.
    """
    return _texts(docs).mapInArrow(_cutter(tokenizer, capacity, piece, keep_ids), PIECES + ", ids array<int>" * keep_ids)


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp: the window of each item, and the load of the fullest window."""
    order = np.argsort(-sizes, kind="stable")
    left, right = [-1] * len(sizes), [-1] * len(sizes)  # a node is an item, or two nodes of one window
    # loads and nodes of the windows that hold something, fullest first
    heap = [(-size if windows > 1 else 0, rank, [size], [item])
            for rank, (size, item) in enumerate(zip(sizes[order].tolist(), order.tolist()))]
    heapq.heapify(heap)
    count = len(order)
    while len(heap) > 1:
        _, _, loads, nodes = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        free = windows - len(loads) - len(other)
        if free >= 0 and len(other) == 1 and other[0] <= loads[-1]:
            loads += other
            nodes += theirs
        else:
            if free >= 0:
                loads, nodes = loads + other[::-1], nodes + theirs[::-1]
            else:  # the fullest of one meets the emptiest of the other
                alone, shared = len(loads) + free, []
                for node, their in zip(nodes[alone:], theirs[::-1]):
                    shared.append(len(left))
                    left.append(node)
                    right.append(their)
                nodes = nodes[:alone] + shared + theirs[::-1][len(shared):]
                met = [a + b for a, b in zip(loads[alone:], other[::-1])]
                loads = loads[:alone] + met + other[::-1][len(met):]
            rank = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
            loads, nodes = [loads[i] for i in rank], [nodes[i] for i in rank]
        count += 1
        heapq.heappush(heap, ((loads[-1] if len(loads) == windows else 0) - loads[0], count, loads, nodes))
    _, _, loads, nodes = heap[0]
    place = np.zeros(len(sizes), np.int64)
    for window, node in enumerate(nodes):
        stack = [node]
        while stack:
            node = stack.pop()
            if left[node] < 0:
                place[node] = window
            else:
                stack += (left[node], right[node])
    return place, loads[0]


def near_equal(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item; as few windows as differencing can fill within the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        place, load = differencing(sizes, windows)
        if load <= capacity:
            return place
        windows += 1


def _packer(names: list[str], capacity: int, block: int, rest: bool = False) -> Kernel:
    """Fills sequence_id and offset; where these are not the ``rest``, less than a block stays without them."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() + _REST_TASKS * rest) * _TASK_IDS
        used = 0

        def emit(table: pa.Table, sequence: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
            table = table.append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))
            yield from table.select(names).combine_chunks().to_batches()

        def fill(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal used
            sizes = table.column("length").to_numpy()
            place = near_equal(sizes, capacity)
            order = np.argsort(place, kind="stable")
            sizes, place = sizes[order], place[order]
            before = np.cumsum(sizes) - sizes
            first = np.searchsorted(place, place)
            yield from emit(table.take(pa.array(order)), used + place, before - before[first])
            used += int(place.max()) + 1

        waiting: list[pa.Table] = []
        count = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            length = table.column("length").to_numpy()
            full = pa.Table.from_batches([batch]).filter(pa.array(length >= capacity))
            if len(full):
                yield from emit(full, used + np.arange(len(full)), np.zeros(len(full), np.int64))
                used += len(full)
            short = table.filter(pa.array(length < capacity))
            waiting.append(short)
            count += len(short)
            if count >= block:
                table = pa.concat_tables(waiting)
                at = 0
                while count - at >= block:
                    yield from fill(table.slice(at, block))
                    at += block
                waiting, count = [table.slice(at)], count - at
        if count and rest:
            yield from fill(pa.concat_tables(waiting))
        elif count:
            table = pa.concat_tables(waiting)
            for name in ("sequence_id", "offset"):
                table = table.append_column(name, pa.nulls(count, pa.int64()))
            yield from table.select(names).combine_chunks().to_batches()

    return kernel


def _with_rests(placed: DataFrame, capacity: int, block: int) -> DataFrame:
    """``placed`` with what its partitions left packed together, in a number of tasks that follows their rows."""
    placed = stored(placed, "placed")
    left = placed.filter("sequence_id is null").drop("sequence_id", "offset")
    tasks = max(1, -(-left.count() // (REST_BLOCKS * block)))
    pack = _packer(placed.columns, capacity, block, rest=True)
    return placed.filter("sequence_id is not null").unionByName(left.repartition(tasks).mapInArrow(pack, placed.schema))


def packed(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces`` with sequence_id and offset; any other columns stay, these two are replaced.

    No piece may be longer than ``capacity``. Offsets have no gaps. Sequence ids follow from
    the partition and the order in it. An empty table gives an empty result. The pieces are
    written once to the shared folder.
    """
    pieces = pieces.drop("sequence_id", "offset")
    schema = pieces.withColumns({c: F.lit(None).cast("long") for c in ("sequence_id", "offset")}).schema
    return _with_rests(pieces.mapInArrow(_packer(schema.fieldNames(), capacity, block), schema), capacity, block)


def packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    As ``packed`` of ``token_pieces``, with cutting and the first packing in one Python worker.
    """
    cut = _cutter(tokenizer or tokenizer_path(), capacity, PIECE, False)
    schema = PIECES + ", sequence_id long, offset long"
    pack = _packer([f.split()[0] for f in schema.split(", ")], capacity, BLOCK)
    return _with_rests(_texts(docs).mapInArrow(lambda batches: pack(cut(batches)), schema), capacity, BLOCK)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences."""
    return packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
