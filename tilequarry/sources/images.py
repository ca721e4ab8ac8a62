"""Reading and writing image files: a Python data source named ``png``, plain readers, and synthetic images.

``spark.read.format("png").load(dir)`` gives one row a file; option ``view`` picks headers (33 bytes are read, no
pixels), chunks, rows or images. Files are found on the driver by Hadoop-independent listing of a local or mounted
folder; for other stores use :func:`read_files`, which goes through Spark's ``binaryFile``.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.bits import pack_rows
from ..operators.chunks import SCHEMA as CHUNKS
from ..operators.chunks import read_chunk
from ..operators.codec import FIELDS, decode, encode, read_header
from ..schema import COLOR_NAMES, DEPTHS, HEADER, IMAGE, INTERLACE_NAMES, MAX_FILE, PALETTE, SAMPLES, SIGNATURE, ImageError

VIEWS = {
    "images": f"path string, {IMAGE}",
    "headers": f"path string, length long, header {HEADER}, error string, detail string",
    "chunks": f"path string, {CHUNKS}",
    "rows": "path string, y long, data binary, error string",
}


def read_files(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Files as path, modificationTime, length, content, error through ``binaryFile``. Of files larger than the limit the
    content is not read; they have none, and the error FileTooLarge."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    large = found.where(F.col("length") > MAX_FILE).select("path", "modificationTime", "length")
    return found.where(F.col("length") <= MAX_FILE).withColumn("error", F.lit(None).cast("string")).unionByName(
        large.withColumns({"content": F.lit(None).cast("binary"), "error": F.lit("FileTooLarge")})
    )


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], view: str):
        self.options, self.view = options, view

    def partitions(self) -> list[InputPartition]:
        root = self.options["path"].removeprefix("file://").removeprefix("file:")
        found = sorted(glob.glob(os.path.join(root, "**", self.options.get("pathglobfilter", "*.png")), recursive=True)) if os.path.isdir(root) else [root]
        # Parts of about equal bytes, so that large images do not share a task.
        limit, parts, size = int(self.options.get("partitionbytes", 16 << 20)), [[]], 0
        for f in found:
            if parts[-1] and size + os.path.getsize(f) > limit:
                parts.append([])
                size = 0
            parts[-1].append(f)
            size += os.path.getsize(f)
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                content = f.read(33) if self.view == "headers" else f.read() if size <= MAX_FILE else None
            yield from getattr(self, "_" + self.view)(path, size, content)

    def _headers(self, path: str, size: int, content: bytes) -> Iterator[tuple]:
        try:
            if content[:8] != SIGNATURE:
                raise ImageError("InvalidSignature")
            if len(content) < 33:
                raise ImageError("MissingIhdr" if len(content) == 8 else "UnexpectedEndOfData")
            kind, data, crc, _ = read_chunk(content, 8)
            if kind != "IHDR":
                raise ImageError("MissingIhdr")
            if zlib.crc32(b"IHDR" + data) != crc:
                raise ImageError("InvalidChunk")
            yield path, size, tuple(read_header(data)[k] for k in FIELDS), None, None
        except ImageError as e:
            yield path, size, None, e.label, e.detail

    def _images(self, path: str, size: int, content: bytes | None) -> Iterator[tuple]:
        try:
            if content is None:
                raise ImageError("FileTooLarge")
            image = decode(content)
            colours = image["palette"] and [tuple(c.values()) for c in image["palette"]]
            yield path, tuple(image["header"][k] for k in FIELDS), image["pixels"], colours, None, None
        except ImageError as e:
            yield path, None, None, None, e.label, e.detail

    def _chunks(self, path: str, size: int, content: bytes | None) -> Iterator[tuple]:
        if content is None or content[:8] != SIGNATURE:
            yield path, 0, None, 0, None, None, None, None, "FileTooLarge" if content is None else "InvalidSignature"
            return
        at, k = 8, 0
        while at < len(content):
            try:
                kind, data, crc, end = read_chunk(content, at)
            except ImageError as e:
                yield path, k, None, at, None, None, None, None, e.label
                return
            yield path, k, kind, at, len(data), data, crc, zlib.crc32(kind.encode() + data) == crc, None
            at, k = end, k + 1

    def _rows(self, path: str, size: int, content: bytes | None) -> Iterator[tuple]:
        try:
            if content is None:
                raise ImageError("FileTooLarge")
            image = decode(content)
        except ImageError as e:
            yield path, None, None, e.label
            return
        w = len(image["pixels"]) // image["header"]["height"]
        for y in range(image["header"]["height"]):
            yield path, y, image["pixels"][y * w : (y + 1) * w], None


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


class _Writer(DataSourceWriter):
    """One file a row (name, header, pixels, palette), under a temporary name until the whole job commits."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").removeprefix("file:")
        self.level, self.strategy = options.get("compression", "default"), options.get("filter", "adaptive")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.root, exist_ok=True)
        done = []
        for r in rows:
            colours = [c.asDict() for c in r["palette"]] if "palette" in r and r["palette"] else None
            target = os.path.join(self.root, r["name"])
            temporary = f"{target}.{TaskContext.get().taskAttemptId()}.tmp"
            with open(temporary, "wb") as f:
                f.write(encode(r["header"].asDict(), bytes(r["pixels"]), colours, self.level, self.strategy))
            done.append((temporary, target))
        return _Written(done)

    def commit(self, messages: list) -> None:
        for m in messages:
            for temporary, target in m.paths:
                os.replace(temporary, target)

    def abort(self, messages: list) -> None:
        for m in messages:
            for temporary, _ in m.paths if m else ():
                if os.path.exists(temporary):
                    os.remove(temporary)


class PngSource(DataSource):
    """Options: path, view (images, headers, chunks, rows), pathGlobFilter, partitionBytes; to write: compression, filter."""

    @classmethod
    def name(cls) -> str:
        return "png"

    def schema(self) -> str:
        return VIEWS[self.options.get("view", "images")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, self.options.get("view", "images"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PngSource)


def write_binary(files: DataFrame, path: str) -> None:
    """Encoded files (name, content) as a table: the sink for stores without plain files."""
    files.write.mode("error").parquet(path)


# Synthetic images: each colour type at each of its depths, plain and interlaced, in sizes that fill no byte or pass evenly.
SIZES = ((1, 1), (3, 7), (33, 18), (130, 5))
SYNTHETIC = [
    (f"{COLOR_NAMES[color]}_{depth}_{INTERLACE_NAMES[lace]}_{w}x{h}", w, h, color, depth, lace)
    for color, depths in DEPTHS.items() for depth in depths for lace in INTERLACE_NAMES for w, h in SIZES
]


def synthetic_pixels(width: int, height: int, color: int, depth: int) -> bytes:
    """Rows of bytes: a slope along rows, another down columns and a ripple, so that no one filter suits all rows."""
    n = SAMPLES[color]
    at, y = np.arange(width * n, dtype=np.int64), np.arange(height, dtype=np.int64)[:, None]
    values = 37 * (at // n) + 91 * (at % n) + y * y + (at * y % 5) * (1 << depth - 1)
    if depth < 8:
        return pack_rows((values % (1 << depth)).astype(np.uint8), depth).tobytes()
    return (values % (1 << depth)).astype(">u2" if depth == 16 else np.uint8).tobytes()


def synthetic_palette(depth: int) -> list[dict]:
    return [{"r": k * 255 // ((1 << depth) - 1), "g": 255 - k, "b": k * k % 256} for k in range(1 << depth)]


def synthetic(spark: SparkSession) -> DataFrame:
    """name, header, pixels, palette of the synthetic images, made on the executors."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = []
            for k in b["id"]:
                name, w, h, color, depth, lace = SYNTHETIC[k]
                header = dict(zip(FIELDS, (w, h, depth, color, 0, 0, lace)))
                out.append((name, header, synthetic_pixels(w, h, color, depth), synthetic_palette(depth) if color == 3 else None))
            yield pd.DataFrame(out, columns=["name", "header", "pixels", "palette"])

    return spark.range(len(SYNTHETIC)).mapInPandas(run, f"name string, header {HEADER}, pixels binary, palette {PALETTE}")
