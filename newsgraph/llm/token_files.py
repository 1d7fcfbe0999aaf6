"""Operator 12, token-ID output: files of independent zstandard frames with a trailing seek table.

A file holds documents in ascending order of their ids:

* one frame per document, its token ids as little-endian unsigned integers of 2 or 4 bytes;
* a skippable frame with the index: JSON settings, then doc_id and number of ids of each frame;
* the seek table, a skippable frame in the published seekable format: compressed size, plain
  size and checksum (the low half of XXH64 of the plain bytes) of each frame before it.

Any zstandard decoder reads the whole file. A reader of some documents reads the end of the file,
the index, and the frames of those documents alone, each checked by its checksum.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsgraph.llm.repeats import stored
from newsgraph.llm.textkit import text_column
from newsgraph.llm.wordcodes import groups, tokenizer_path, word_codes
from newsgraph.session import scratch_path

#: The id after each document.
END = 2
#: Bytes of frames in one file, about.
FILE_BYTES = 32 << 20
#: Compression level of the frames.
LEVEL = 3

# Fixed values of the published frame formats: magic numbers of skippable frames and of the seek table.
SKIPPABLE, SEEK_FRAME, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: The seek table's descriptor: entries have checksums.
CHECKSUMS = 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("checksum", "<u4")])
_INDEX = np.dtype([("doc_id", "<i8"), ("n_tokens", "<i8")])


class BrokenFile(ValueError):
    """A token file whose bytes do not agree with its checksums or its table."""


def checksum(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def frames(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Columns doc_id, n_tokens, plain_size, checksum, frame: each document's ids, ``end`` behind them, as a frame.

    A null or empty text is the end id alone. Rows without an id go: they have no place in
    the order. Rows that share an id are documents of their own. Other columns are ignored.
    """
    end_code = np.array([end], "<u4").tobytes()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with word_codes(tokenizer) as codes:
            dtype = "<u2" if max(codes.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"
            pack = zstandard.ZstdCompressor(level=LEVEL)
            for batch in batches:
                low = 0
                for texts in groups([t or b"" for t in batch.column(1).to_pylist()]):
                    plain = [np.frombuffer(ids + end_code, "<u4").astype(dtype).tobytes() for ids in codes(texts)]
                    width = np.dtype(dtype).itemsize
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(low, len(texts)), pa.array([len(p) // width for p in plain], pa.int64()),
                         pa.array([len(p) for p in plain], pa.int64()), pa.array([checksum(p) for p in plain], pa.int64()),
                         pa.array([pack.compress(p) for p in plain], pa.binary())],
                        names=["doc_id", "n_tokens", "plain_size", "checksum", "frame"])
                    low += len(texts)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs)).filter("doc_id is not null")
            .mapInArrow(kernel, "doc_id long, n_tokens long, plain_size long, checksum long, frame binary"))


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def skippable(kind: int, content: bytes) -> bytes:
    return struct.pack("<II", kind, len(content)) + content


def trailer(table: np.ndarray, index: np.ndarray, width: int) -> bytes:
    """The index frame and the seek table behind frames with these entries."""
    settings = json.dumps({"width": width, "documents": len(index)}).encode()
    content = struct.pack("<I", len(settings)) + settings + index.tobytes()
    frame = skippable(SKIPPABLE, content + struct.pack("<I", checksum(content)))
    entries = np.append(table, np.array([(len(frame), 0, 0)], _ENTRY))
    return frame + skippable(SEEK_FRAME, entries.tobytes() + _FOOTER.pack(len(entries), CHECKSUMS, SEEKABLE))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END,
                      file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes token files of ``docs`` below ``folder``; returns their list: part, name, first_id, documents, tokens, base.

    ``base`` counts the ids in the files before. The list is stored as ``folder``/files; a
    file that a lost or repeated task left behind is not in it. File sizes follow ``file_bytes``, so
    no file grows with the data. An empty table gives an empty list.
    """
    spark = docs.sparkSession
    coded = stored(frames(docs, tokenizer or tokenizer_path(), end), "frames")
    total = coded.agg(F.sum(F.octet_length("frame"))).first()[0]
    listed = "part int, name string, first_id long, documents long, tokens long"
    if not total:
        spark.createDataFrame([], listed + ", base long").write.mode("overwrite").parquet(f"{folder}/files")
        return spark.read.parquet(f"{folder}/files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"tokens-{part:06d}-{uuid.uuid4().hex}.zst"  # each attempt has its own
        system, path = _file_system(folder)
        out, tables, indexes, width = None, [], [], 2
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            n_tokens, plain_size = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            width = int(plain_size[0] // n_tokens[0])
            own = batch.column(4).to_pylist()
            table = np.zeros(len(batch), _ENTRY)
            table["packed"], table["plain"], table["checksum"] = [len(f) for f in own], plain_size, np.asarray(batch.column(3))
            index = np.zeros(len(batch), _INDEX)
            index["doc_id"], index["n_tokens"] = np.asarray(batch.column(0)), n_tokens
            tables.append(table)
            indexes.append(index)
            for frame in own:
                out.write(frame)
        if out is not None:
            index = np.concatenate(indexes)
            out.write(trailer(np.concatenate(tables), index, width))
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([name]), pa.array([int(index["doc_id"][0])]), pa.array([len(index)]),
                 pa.array([int(index["n_tokens"].sum())])], names=["part", "name", "first_id", "documents", "tokens"])

    parts = max(1, -(-total // file_bytes))
    # ties of an id are ordered by content, so a task that runs again writes the same file
    placed = coded.repartitionByRange(parts, "doc_id", "checksum").sortWithinPartitions("doc_id", "checksum", "frame")
    files = stored(placed.select("doc_id", "n_tokens", "plain_size", "checksum", "frame").mapInArrow(write, listed), "files")
    base, rows = 0, []
    for row in files.orderBy("part").collect():  # one row per file
        rows.append((*row, base))
        base += row.tokens
    spark.createDataFrame(rows, listed + ", base long").write.mode("overwrite").parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


@dataclass
class TokenFile:
    """One file, opened: its table and index are in memory, its frames are read on demand."""

    source: pa.NativeFile
    width: int
    table: np.ndarray
    index: np.ndarray

    @classmethod
    def open(cls, system: fs.FileSystem, path: str) -> TokenFile:
        source = system.open_input_file(path)
        size = source.size()
        source.seek(max(0, size - _FOOTER.size))
        tail = source.read(_FOOTER.size)
        if len(tail) < _FOOTER.size:
            raise BrokenFile(f"{path}: no seek table")
        count, descriptor, magic = _FOOTER.unpack(tail)
        start = size - _FOOTER.size - count * _ENTRY.itemsize
        if magic != SEEKABLE or descriptor != CHECKSUMS or start < 8 or not count:
            raise BrokenFile(f"{path}: no seek table")
        source.seek(start - 8)
        head = struct.unpack("<II", source.read(8))
        entries = np.frombuffer(source.read(count * _ENTRY.itemsize), _ENTRY)
        if head != (SEEK_FRAME, count * _ENTRY.itemsize + _FOOTER.size) or int(entries["packed"].astype(np.int64).sum()) != start - 8:
            raise BrokenFile(f"{path}: the seek table does not fit the file")
        source.seek(start - 8 - int(entries["packed"][-1]))
        content = source.read(int(entries["packed"][-1]))[8:]
        if checksum(content[:-4]) != struct.unpack("<I", content[-4:])[0]:
            raise BrokenFile(f"{path}: the index does not have its checksum")
        length = struct.unpack_from("<I", content)[0]
        settings = json.loads(content[4:4 + length])
        index = np.frombuffer(content[4 + length:-4], _INDEX)
        if len(index) != count - 1:
            raise BrokenFile(f"{path}: the index does not fit the seek table")
        return cls(source, settings["width"], entries[:-1], index)

    def read(self, which: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(place, plain bytes) of the documents at these ascending places; nothing else is decompressed."""
        ends = np.cumsum(self.table["packed"].astype(np.int64))
        unpack = zstandard.ZstdDecompressor()
        for i in which.tolist():
            packed, plain, expected = self.table[i].tolist()
            self.source.seek(int(ends[i]) - packed)
            try:
                data = unpack.decompress(self.source.read(packed), max_output_size=plain)
            except zstandard.ZstdError as error:
                raise BrokenFile(f"frame {i}: {error}") from error
            if len(data) != plain or checksum(data) != expected:
                raise BrokenFile(f"frame {i} does not have its checksum")
            yield i, data


def read_token_files(spark: SparkSession, folder: str, ids: DataFrame | None = None, keep_ids: bool = True) -> DataFrame:
    """Columns doc_id, start, n_tokens, ids_crc32[, ids]: documents read back, all or those of ``ids`` (doc_id).

    ``start`` counts the ids of all documents before. Only requested documents are decompressed: each
    task gets files, and the requested ids that lie between a file's first id and the next file's.
    A frame whose bytes do not have their checksum raises ``BrokenFile``.
    """
    files = spark.read.parquet(f"{folder}/files")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*[r[:4] for r in rows])]
        if keep_ids:
            columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        for batch in batches:
            for name, base, wanted in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                file = TokenFile.open(system, f"{path}/{name}")
                which = np.arange(len(file.index))
                if wanted is not None:
                    which = which[np.isin(file.index["doc_id"], np.array(wanted, np.int64))]
                starts = base + np.cumsum(file.index["n_tokens"]) - file.index["n_tokens"]
                rows, size = [], 0
                for i, data in file.read(which):
                    tokens = np.frombuffer(data, f"<u{file.width}").astype("<u4")
                    rows.append((int(file.index["doc_id"][i]), int(starts[i]), len(tokens), zlib.crc32(tokens.tobytes()),
                                 tokens.astype(np.int64) if keep_ids else None))
                    size += len(data) * keep_ids
                    if len(rows) == 8192 or size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)
                file.source.close()

    if ids is None:
        requests = files.select("name", "base", F.lit(None).cast("array<long>").alias("wanted"), "part")
    else:
        requests = _requests(files, ids)
    tasks = max(1, files.count())
    return (requests.repartitionByRange(tasks, "part", "name").select("name", "base", "wanted").mapInArrow(read, schema))


#: Requested ids of one row of work; more of one file make further rows.
REQUESTED = 100_000


def _requests(files: DataFrame, ids: DataFrame) -> DataFrame:
    """name, base, wanted, part: the requested ids dealt to the files that may hold them."""
    bounds = files.select("part", "first_id").orderBy("part").collect()  # one row per file
    firsts = [r.first_id for r in bounds]
    wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    if not firsts:
        return wanted.select(F.lit("").alias("name"), F.lit(0).alias("base"), F.array("doc_id").alias("wanted"),
                             F.lit(0).alias("part")).limit(0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, parts = np.array(firsts), np.array([r.part for r in bounds])
        for batch in batches:
            doc = np.asarray(batch.column(0))
            last = np.searchsorted(edges, doc, "right") - 1  # the last file that may hold it
            first = np.maximum(np.searchsorted(edges, doc, "left") - 1, 0)  # rows of one id may lie across files
            count = np.maximum(last - first + 1, 0)
            row = np.repeat(np.arange(len(doc)), count)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(parts[at].astype(np.int32))], names=["doc_id", "part"])

    dealt = wanted.mapInArrow(deal, "doc_id long, part int")
    block = F.floor(F.row_number().over(Window.partitionBy("part").orderBy("doc_id")) / REQUESTED)
    lists = dealt.withColumn("block", block).groupBy("part", "block").agg(F.collect_list("doc_id").alias("wanted"))
    return lists.join(files.select("part", "name", "base"), "part").select("name", "base", "wanted", "part")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    folder = scratch_path(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder, keep_ids=False)
