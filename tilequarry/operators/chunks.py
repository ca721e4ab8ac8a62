"""Chunks of image files: reading, writing, checking, as kernels and as DataFrame operators."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checksums import chunk_crc
from ..schema import ANCILLARY, CRITICAL, MAX_CHUNK, SIGNATURE, ImageError


def read_chunk(data: bytes, at: int) -> tuple[str, bytes, int, int]:
    """Type, data, CRC and the place after the chunk that begins at ``at``."""
    if len(data) - at < 12:
        raise ImageError("UnexpectedEndOfData")
    (n,) = struct.unpack_from(">I", data, at)
    if n > MAX_CHUNK:
        raise ImageError("InvalidLength")
    if len(data) - at < 12 + n:
        raise ImageError("UnexpectedEndOfData")
    kind = data[at + 4 : at + 8]
    if not (kind.isascii() and kind.isalpha()):
        raise ImageError("InvalidChunkType")
    return kind.decode(), data[at + 8 : at + 8 + n], struct.unpack_from(">I", data, at + 8 + n)[0], at + 12 + n


def iterate(content: bytes) -> Iterator[tuple[str, bytes, int]]:
    """Type, data and CRC of each chunk after the signature, to the end of the bytes."""
    at = 8
    while at < len(content):
        kind, data, crc, at = read_chunk(content, at)
        yield kind, data, crc


def write_chunk(kind: str, data: bytes) -> bytes:
    body = kind.encode() + data
    return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))


def has_signature(content: Column) -> Column:
    return (F.length(content) >= 8) & (F.substring(content, 1, 8) == F.lit(SIGNATURE))


def chunk_bytes(kind: Column, data: Column) -> Column:
    """A whole chunk as binary, as an expression."""
    word = lambda v: F.unhex(F.lpad(F.hex(v.cast("bigint")), 8, "0"))
    return F.concat(word(F.length(data)), F.encode(kind, "US-ASCII"), data, word(chunk_crc(kind, data)))


def _lower(kind: Column, place: int) -> Column:
    return F.ascii(F.substring(kind, place, 1)).bitwiseAND(32) != 0


def is_critical(kind: Column) -> Column:
    return ~_lower(kind, 1)


def is_public(kind: Column) -> Column:
    return ~_lower(kind, 2)


def is_safe_to_copy(kind: Column) -> Column:
    """A lower-case fourth letter says that editors may copy a chunk that they do not know."""
    return _lower(kind, 4)


def catalog(spark: SparkSession) -> DataFrame:
    """The known chunk types and their flags."""
    types = spark.createDataFrame([(t,) for t in CRITICAL + ANCILLARY], "type string")
    return types.select("type", is_critical(F.col("type")).alias("critical"), is_public(F.col("type")).alias("public"), is_safe_to_copy(F.col("type")).alias("safe_to_copy"))


def palette(data: Column) -> Column:
    """PLTE bytes as an array of colours; null where their number is not 1 to 256 whole ones."""
    n = F.length(data)
    value = lambda k, c: F.conv(F.hex(data.substr(k * 3 + c, F.lit(1))), 16, 10).cast("int")
    colours = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(n / 3).cast("int") - 1, F.lit(0))), lambda k: F.struct(value(k, F.lit(1)).alias("r"), value(k, F.lit(2)).alias("g"), value(k, F.lit(3)).alias("b")))
    return F.when((n > 0) & (n % 3 == 0) & (n <= 768), colours)


def palette_error(data: Column) -> Column:
    n = F.length(data)
    return F.when((n == 0) | (n % 3 != 0), "InvalidLength").when(n > 768, "InvalidPaletteSize")


def palette_bytes(colours: Column) -> Column:
    """The inverse of :func:`palette`."""
    two = lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")
    return F.unhex(F.array_join(F.transform(colours, lambda c: F.concat(two(c["r"]), two(c["g"]), two(c["b"]))), ""))


SCHEMA = "idx int, type string, offset long, length long, data binary, crc long, crc_ok boolean, error string"


def chunks(files: DataFrame, keys: list[str], with_data: bool = True) -> DataFrame:
    """One row for each chunk of ``content``, with ``keys``; a chunk that cannot be read gives a last row with ``error``.

    A null content gives no row; content without a signature gives one row with InvalidSignature.
    """
    fields = [files.schema[k] for k in keys]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if not with_data:
        names.remove("data")
    kinds = {"idx": pa.int32(), "type": pa.string(), "offset": pa.int64(), "length": pa.int64(), "data": pa.binary(), "crc": pa.int64(), "crc_ok": pa.bool_(), "error": pa.string()}

    def of(content: bytes) -> Iterator[dict]:
        if content[:8] != SIGNATURE:
            yield {"idx": 0, "offset": 0, "error": "InvalidSignature"}
            return
        at, k = 8, 0
        while at < len(content):
            try:
                kind, data, crc, end = read_chunk(content, at)
            except ImageError as e:
                yield {"idx": k, "offset": at, "error": e.label}
                return
            yield {"idx": k, "type": kind, "offset": at, "length": len(data), "data": data, "crc": crc, "crc_ok": zlib.crc32(kind.encode() + data) == crc}
            at, k = end, k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                content = b.column(len(keys))[i].as_py()
                rows = list(of(content)) if content is not None else []
                if rows:
                    key = [pa.repeat(b.column(k)[i], len(rows)) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*key, *[pa.array([r.get(n) for r in rows], kinds[n]) for n in names]], [*keys, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in names)
    return files.select(*keys, "content").mapInArrow(run, schema)


def order_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a reader's chunk rules say of each file: the first chunk, whether IEND came, chunks that are out of place.

    Chunks after IEND are ignored. A second IHDR, an unknown critical chunk or a PLTE after IDAT is only reported.
    """
    end = F.min(F.when(F.col("type") == "IEND", F.col("idx")))
    ends = rows.groupBy(*keys).agg(end.alias("end"))
    live = rows.join(ends, keys).where(F.col("end").isNull() | (F.col("idx") <= F.col("end")))
    first_idat = F.min(F.when(F.col("type") == "IDAT", F.col("idx")))
    return live.groupBy(*keys).agg(
        F.min_by("type", "idx").alias("first_type"),
        F.max(F.col("type") == "IEND").alias("has_iend"),
        F.sum(F.when(F.col("type") == "IDAT", F.col("length")).otherwise(0)).alias("idat_bytes"),
        (F.count_if(F.col("type") == "IHDR") - 1).alias("extra_ihdr"),
        F.count_if(is_critical(F.col("type")) & ~F.col("type").isin(*CRITICAL)).alias("unknown_critical"),
        (F.max(F.when(F.col("type") == "PLTE", F.col("idx"))) > first_idat).alias("late_plte"),
    )
