"""Bits: reading and writing least-bit-first streams, reversing, and samples of less than a byte."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BitReader:
    """Reads a byte string least bit first. Aligning drops only the rest of the current byte."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        """The next ``n`` bits, with zeros after the end."""
        first = self.at >> 3
        return int.from_bytes(self.data[first : (self.at + n + 7 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def consume(self, n: int) -> None:
        if self.at + n > self.end:
            raise EOFError("EndOfStream")
        self.at += n

    def read(self, n: int = 1) -> int:
        value = self.peek(n)
        self.consume(n)
        return value

    def align(self) -> None:
        self.at = self.at + 7 & ~7

    def read_bytes(self, n: int) -> bytes:
        self.align()
        first = self.at >> 3
        self.consume(8 * n)
        return self.data[first : first + n]

    @property
    def is_at_end(self) -> bool:
        return self.at >= self.end

    @property
    def remaining_bytes(self) -> int:
        return (self.end - self.at) // 8


class BitWriter:
    """Writes least bit first; ``limit`` bytes at most if given."""

    def __init__(self, limit: int | None = None):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.out, self.hold, self.count = bytearray(), 0, 0

    def write(self, value: int, n: int = 1) -> None:
        self.hold |= (value & ((1 << n) - 1)) << self.count
        self.count += n
        while self.count >= 8:
            self._byte(self.hold & 255)
            self.hold >>= 8
            self.count -= 8

    def _byte(self, value: int) -> None:
        if self.limit is not None and len(self.out) >= self.limit:
            raise OverflowError("BufferOverflow")
        self.out.append(value)

    def flush(self) -> None:
        """Fill the current byte with zeros."""
        if self.count:
            self._byte(self.hold & 255)
            self.hold = self.count = 0

    def write_bytes(self, data: bytes) -> None:
        self.flush()
        for x in data:
            self._byte(x)

    @property
    def written(self) -> bytes:
        return bytes(self.out)


def bit_reverse(value: Column, n: Column | int) -> Column:
    """The low ``n`` bits in reverse order."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.conv(F.reverse(F.lpad(F.bin(value.cast("bigint")), n, "0")), 2, 10).cast("bigint")


def unpack_sample(byte: Column, place: Column, depth: int) -> Column:
    """Sample number ``place`` (from the high bits) of a byte that holds 8 / depth samples."""
    return F.call_function("shiftright", byte, F.lit(8 - depth) - place * depth).bitwiseAND((1 << depth) - 1)


def unpack_row(row: Column, depth: int, width: Column) -> Column:
    """array<int> bytes to array<int> samples of a row of ``width`` samples."""
    each = F.transform(F.sequence(F.lit(0), F.lit(8 // depth - 1)), lambda k: k)
    return F.slice(F.flatten(F.transform(row, lambda b: F.transform(each, lambda k: unpack_sample(b, k, depth)))), F.lit(1), width)


def pack_row(values: Column, depth: int) -> Column:
    """array<int> samples to array<int> bytes, high bits first, zeros at the end."""
    per = 8 // depth
    n = F.ceil(F.size(values) / per).cast("int")
    byte = lambda j: sum((F.coalesce(F.get(values, j * per + k), F.lit(0)) * (1 << (8 - depth * (k + 1))) for k in range(per)), F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), byte)).otherwise(F.array().cast("array<int>"))


def unpack_rows(raw: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Rows of bytes to rows of samples (8 bits each)."""
    shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    return ((raw[:, :, None] >> shifts) & np.uint8((1 << depth) - 1)).reshape(len(raw), -1)[:, :width]


def pack_rows(values: np.ndarray, depth: int) -> np.ndarray:
    per = 8 // depth
    padded = np.pad(values, ((0, 0), (0, -values.shape[1] % per))).reshape(len(values), -1, per)
    shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
    return np.bitwise_or.reduce(padded << shifts, axis=2).astype(np.uint8)
