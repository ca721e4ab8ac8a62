"""CRC-32 and Adler-32 as expressions, and in steps for kernels."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

MOD = 65521


def crc32(data: Column) -> Column:
    """CRC-32 of a binary column (built in)."""
    return F.crc32(data)


def chunk_crc(kind: Column, data: Column) -> Column:
    """CRC-32 over a chunk's type and data."""
    return F.crc32(F.concat(F.encode(kind, "US-ASCII"), data))


def byte_array(data: Column) -> Column:
    """A binary column as array<int>, 0 to 255; empty for empty data."""
    return F.when(F.length(data) > 0, F.transform(F.split(F.regexp_replace(F.hex(data), "(..)(?=.)", "$1 "), " "), lambda x: F.conv(x, 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def to_binary(values: Column) -> Column:
    """array<int> of bytes as binary."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def adler32(data: Column) -> Column:
    """Adler-32 of a binary column, one fold over its bytes; for long inputs prefer the kernel."""
    zero = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(s: Column, v: Column) -> Column:
        a = (s["a"] + v) % MOD
        return F.struct(a.alias("a"), ((s["b"] + a) % MOD).alias("b"))

    return F.aggregate(byte_array(data), zero, step, lambda s: s["b"] * 65536 + s["a"])


class Running:
    """Both checksums in steps: ``update`` any number of times, then read ``crc`` and ``adler``."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.crc, self.adler = 0, 1

    def update(self, data: bytes) -> Running:
        self.crc, self.adler = zlib.crc32(data, self.crc), zlib.adler32(data, self.adler)
        return self
