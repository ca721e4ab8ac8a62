"""The library's functions by name in SQL: ``register(spark)``.

Scalar functions are SQL functions, whose bodies Catalyst inlines; Adler-32, decoding and encoding are Arrow functions;
``png_chunks``, ``png_rows``, ``png_pixels`` and ``lz77_tokens`` are table functions for ``LATERAL``. ``crc32`` is
Spark's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chunks, codec
from ..schema import ADAM7, DEPTHS, HEADER, IMAGE, SAMPLES, SIGNATURE, ImageError
from . import bits, checksums, deflate

_SAMPLES = "CASE color " + " ".join(f"WHEN {k} THEN {v}" for k, v in SAMPLES.items()) + " END"
_COMBO = " OR ".join(f"(color = {k} AND depth IN {v})" for k, v in DEPTHS.items())
_ROW = f"(width * ({_SAMPLES}) * depth + 7) DIV 8"
_FILTERED = f"({_ROW} * height + 4 * height + 14)"
_PACKED = f"({_FILTERED} + {_FILTERED} DIV 8 + {_FILTERED} DIV 64 + 64)"
_GRID = "CASE WHEN y % 8 = 0 AND x % 8 = 0 THEN 0 WHEN y % 8 = 0 AND x % 8 = 4 THEN 1 WHEN y % 8 = 4 AND x % 4 = 0 THEN 2 WHEN y % 4 = 0 AND x % 4 = 2 THEN 3 WHEN y % 4 = 2 AND x % 2 = 0 THEN 4 WHEN y % 2 = 0 AND x % 2 = 1 THEN 5 ELSE 6 END"


def _axis(origin: int, step: int) -> str:
    return "CASE pass " + " ".join(f"WHEN {k} THEN greatest(0L, (size - {p[origin]} + {p[step]} - 1) DIV {p[step]})" for k, p in enumerate(ADAM7)) + " END"


def _code(table: list[tuple[int, int]], first: int, most: int) -> str:
    return f"CASE WHEN v > {most} THEN NULL " + " ".join(f"WHEN v >= {b} THEN {first + k}" for k, (b, _) in reversed(list(enumerate(table)))) + " END"


_FIELD = "CAST(conv(hex(substring(data, {at}, {n})), 16, 10) AS {kind})"
_HEADER = "named_struct(" + ", ".join(f"'{name}', " + _FIELD.format(at=at, n=n, kind="BIGINT" if n == 4 else "INT") for name, at, n in zip(codec.FIELDS, (1, 5, 9, 10, 11, 12, 13), (4, 4, 1, 1, 1, 1, 1))) + ")"
SCALAR = {
    "paeth(a INT, b INT, c INT) RETURNS INT": "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END",
    "bit_reverse(v BIGINT, n INT) RETURNS BIGINT": "CAST(conv(reverse(lpad(bin(v), n, '0')), 2, 10) AS BIGINT)",
    "png_bits_per_pixel(color INT, depth INT) RETURNS BIGINT": f"({_SAMPLES}) * depth",
    "png_bytes_per_pixel(color INT, depth INT) RETURNS BIGINT": f"greatest(1, ({_SAMPLES}) * depth DIV 8)",
    "png_bytes_per_row(width BIGINT, color INT, depth INT) RETURNS BIGINT": _ROW,
    "png_raw_size(width BIGINT, height BIGINT, color INT, depth INT) RETURNS BIGINT": f"(({_ROW}) + 1) * height",
    "png_valid_combo(color INT, depth INT) RETURNS BOOLEAN": _COMBO,
    "png_max_encoded_size(width BIGINT, height BIGINT, color INT, depth INT) RETURNS BIGINT": f"{_PACKED} + 825 + 12 * (({_PACKED} + 32767) DIV 32768)",
    "png_parse_header(data BINARY) RETURNS " + HEADER.upper().replace(":", ": "): f"CASE WHEN length(data) = 13 THEN {_HEADER} END",
    "png_is_critical(type STRING) RETURNS BOOLEAN": "ascii(type) & 32 = 0",
    "adam7_pass(x BIGINT, y BIGINT) RETURNS INT": _GRID,
    "adam7_width(size BIGINT, pass INT) RETURNS BIGINT": _axis(0, 2),
    "adam7_height(size BIGINT, pass INT) RETURNS BIGINT": _axis(1, 3),
    "deflate_length_code(v INT) RETURNS INT": _code(deflate.LENGTHS, 257, 258),
    "deflate_distance_code(v INT) RETURNS INT": _code(deflate.DISTANCES, 0, deflate.WINDOW),
    "zlib_header(level STRING) RETURNS STRING": "CASE level " + " ".join(f"WHEN '{k}' THEN '{deflate.zlib_header(k).hex().upper()}'" for k in deflate.CHAIN) + " END",
    "sum_abs(row ARRAY<INT>) RETURNS BIGINT": "aggregate(row, 0L, (s, v) -> s + IF(v < 128, v, 256 - v))",
}


_BYTE = pa.int32()
_IMAGE = pa.schema([
    ("header", pa.struct([(n, pa.int64() if n in ("width", "height") else _BYTE) for n in codec.FIELDS])), ("pixels", pa.binary()),
    ("palette", pa.list_(pa.struct([("r", _BYTE), ("g", _BYTE), ("b", _BYTE)]))), ("error", pa.string()), ("detail", pa.string()),
])


def adler32(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else checksums.Running().update(d).adler)


def png_decode(content: pa.Array) -> pa.Array:
    def one(c: bytes | None) -> dict:
        try:
            return codec.decode(c) if c is not None else {}
        except ImageError as e:
            return {"error": e.label, "detail": e.detail}

    return pa.array([{k: v.get(k) for k in _IMAGE.names} for v in map(one, content.to_pylist())], pa.struct(_IMAGE))


_FILE = pa.struct([("content", pa.binary()), ("error", pa.string()), ("detail", pa.string())])


def png_encode(header: pa.Array, pixels: pa.Array, palette: pa.Array, level: pa.Array) -> pa.Array:
    def one(h: dict | None, p: bytes | None, colours: list | None, how: str | None) -> dict:
        try:
            return {"content": codec.encode(h, p, colours, how or "default")} if h is not None and p is not None else {}
        except ImageError as e:
            return {"error": e.label, "detail": e.detail}

    return pa.array([one(*x) for x in zip(*(c.to_pylist() for c in (header, pixels, palette, level)))], _FILE)


class Chunks:
    """``png_chunks(content)``: idx, type, length, data, crc, crc_ok, error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        import zlib

        if content is None:
            return
        if content[:8] != SIGNATURE:
            yield 0, None, None, None, None, None, "InvalidSignature"
            return
        at, k = 8, 0
        while at < len(content):
            try:
                kind, data, crc, at = chunks.read_chunk(content, at)
            except ImageError as e:
                yield k, None, None, None, None, None, e.label
                return
            yield k, kind, len(data), data, crc, zlib.crc32(kind.encode() + data) == crc, None
            k += 1


class Rows:
    """``png_rows(content)``: y, data, error. A broken file has one row, with its error alone; null has none."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        if content is None:
            return
        try:
            image = codec.decode(content)
        except ImageError as e:
            yield None, None, e.label
            return
        h = image["header"]["height"]
        w = len(image["pixels"]) // h
        for y in range(h):
            yield y, image["pixels"][y * w : (y + 1) * w], None


class Pixels:
    """``png_pixels(content)``: x, y, samples, error, with broken files and nulls as in ``png_rows``."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        import numpy as np

        if content is None:
            return
        try:
            image = codec.decode(content)
        except ImageError as e:
            yield None, None, None, e.label
            return
        h = image["header"]
        rows = np.frombuffer(image["pixels"], np.uint8).reshape(h["height"], -1)
        n, depth = SAMPLES[h["color_type"]], h["bit_depth"]
        if depth == 16:
            values = rows.view(">u2")
        else:
            values = bits.unpack_rows(rows, depth, h["width"]) if depth < 8 else rows
        for y, row in enumerate(values.reshape(h["height"], h["width"], n).tolist()):
            for x, v in enumerate(row):
                yield x, y, v, None


class Tokens:
    """``lz77_tokens(data, level)``: idx, kind, literal, length, distance."""

    def eval(self, data: bytes, level: str) -> Iterator[tuple]:
        for k, t in enumerate(deflate.tokens(data or b"", level)):
            yield (k, "match", None, *t) if isinstance(t, tuple) else (k, "literal", t, None, None)


TABLES = {
    "png_chunks": (Chunks, "idx int, type string, length long, data binary, crc long, crc_ok boolean, error string"),
    "png_rows": (Rows, "y long, data binary, error string"),
    "png_pixels": (Pixels, "x long, y long, samples array<int>, error string"),
    "lz77_tokens": (Tokens, "idx long, kind string, literal int, length int, distance int"),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to ``spark`` as temporary functions."""
    for signature, body in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("adler32", F.pandas_udf(adler32, "long"))
    spark.udf.register("png_decode", F.arrow_udf(png_decode, IMAGE))
    spark.udf.register("png_encode", F.arrow_udf(png_encode, "content binary, error string, detail string"))
    for name, (cls, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=schema))
