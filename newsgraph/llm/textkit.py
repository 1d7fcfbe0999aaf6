"""Byte and word kernels on Arrow columns: word bounds, rolling hashes, sliding minima.

All of it works on whole UTF-8 texts as one flat byte array with document offsets, in
slices of bounded size, so that no Python loop runs per byte or per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of text a kernel looks at together; one longer document is a slice of its own.
SLICE_BYTES = 400_000

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = b" \t\n\x0b\x0c\r"

_MASK = (1 << 64) - 1
_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The modulus of the second family of hashes, a prime.
PRIME = (1 << 31) - 1
_P, _SHIFT = np.uint64(PRIME), np.uint64(31)


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number that equals ``x`` modulo PRIME."""
    return (x & _P) + (x >> _SHIFT)


class Powers:
    """Powers of an odd base and of its inverse, modulo 2**64 and modulo PRIME, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.small = base % PRIME or 7
        self.up = self.down = self.up_small = self.down_small = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, step in (("up", self.base), ("down", self.inverse)):
                values = np.full(size, step, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))
            for name, step in (("up_small", self.small), ("down_small", pow(self.small, -1, PRIME))):
                values = np.ones(1, np.uint64)
                while len(values) < size:
                    values = np.concatenate([values, values * np.uint64(pow(step, len(values), PRIME)) % _P])
                setattr(self, name, values[:size])


_POWERS = [Powers((s * 0x2545F4914F6CDD1D) & _MASK) for s in _SEEDS]
_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEEDS[2]))


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit symbols, after two prefix sums.

    Two polynomials: one modulo 2**64, and, as some different sequences agree there whatever
    the base (those of Thue-Morse kind), one modulo a prime.
    """

    def __init__(self, symbols: np.ndarray, which: int = 0):
        self.powers = _POWERS[which]
        n = len(symbols)
        self.powers.need(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * self.powers.up[:n], out=self.sums[1:], dtype=np.uint64)
        self.small = np.zeros(n + 1, np.uint64)
        # 33 bits each after one fold, so 2**31 symbols fit
        np.cumsum(_fold((symbols >> np.uint64(33)) * self.powers.up_small[:n]), out=self.small[1:], dtype=np.uint64)

    def _hash(self, sums: np.ndarray, small: np.ndarray, start, length) -> np.ndarray:
        rest = _fold(_fold(_fold(_fold(small)) * self.powers.down_small[start]))
        rest = np.where(rest >= _P, rest - _P, rest)
        return mix(sums * self.powers.down[start] + rest * np.uint64(_SEEDS[0]) + length)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._hash(self.sums[end] - self.sums[start], self.small[end] - self.small[start], start,
                          (end - start).astype(np.uint64) * np.uint64(_SEEDS[1]))

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` symbols, document bounds ignored."""
        count = len(self.sums) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return self._hash(self.sums[n:] - self.sums[:count], self.small[n:] - self.small[:count], slice(count),
                          np.uint64(n * _SEEDS[1] & _MASK))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    if len(values) < width:
        return values[:0]
    best, have = values, 1
    while 2 * have <= width:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    rest = width - have
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def byte_class(members: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Words between ASCII white space.
PLAIN_WORD = byte_class(set(range(256)) - set(SPACES))
#: Words of digits, letters and all that is not ASCII (case is folded first).
ALNUM_WORD = byte_class({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold_case(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _LOWER[data]


class Slice:
    """Some whole documents as one byte array; ``offsets`` has one more entry than documents."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.size = len(offsets) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of every word, and each document's first word (one entry more)."""
        inside = table[self.data]
        n = len(inside)
        edges = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[edges] = False
            after[edges - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(start, self.offsets)

    def word_hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return Rolling(byte_symbols(self.data)).of(start, end)


def binary(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Slice]:
    """The texts of a column in slices of about SLICE_BYTES; null counts as empty."""
    texts = binary(column)
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        low, high = offsets[first], offsets[last]
        yield Slice(first, data[low:high], offsets[first:last + 1] - low)
        first = last


def small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what a kernel makes of one takes little memory."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def free_name(columns: Iterable[str], stem: str) -> str:
    """A column name that begins with ``stem`` and that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def rows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of so many members: each member's group and its place in the group."""
    counts = np.asarray(counts, np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    return group, place


def text_column(docs: DataFrame, name: str = "text") -> Column:
    """The text as bytes; kernels then never meet a text that Python cannot decode."""
    return F.col(name).cast("binary").alias("text")


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching (start, end) ranges as maximal ones, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out
