"""Images to bytes and back: numpy kernels on one image, and DataFrame operators over tables of images.

One bad image never fails a job: every operator returns an error label in place of a result. Large binaries are handled
row by row within an Arrow batch, so memory is that of the batch and of one image.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import pack_rows, unpack_rows
from ..functions.deflate import compress, decompress
from ..functions.geometry import passes, pixel_bytes, row_bytes
from ..functions.predict import filter_rows, unfilter_rows
from ..schema import DEPTHS, HEADER, IDAT_PIECE, IMAGE, MAX_DIMENSION, MAX_IDAT_TOTAL, MAX_PIXELS, SAMPLES, SIGNATURE, ImageError
from .chunks import iterate, write_chunk

FIELDS = ("width", "height", "bit_depth", "color_type", "compression", "filter", "interlace")
MAX_BUFFER = 1 << 31


def read_header(data: bytes) -> dict:
    """Header fields; the label of the first broken rule otherwise."""
    if len(data) != 13:
        raise ImageError("InvalidIhdr", "InvalidLength")
    h = dict(zip(FIELDS, struct.unpack(">IIBBBBB", data)))
    check_header(h)
    return h


def check_header(h: dict, label: str = "InvalidIhdr") -> None:
    rules = (
        ("InvalidWidth", 1 <= h["width"] <= MAX_DIMENSION),
        ("InvalidHeight", 1 <= h["height"] <= MAX_DIMENSION and h["width"] * h["height"] <= MAX_PIXELS),
        ("InvalidBitDepth", h["bit_depth"] in (1, 2, 4, 8, 16)),
        ("InvalidColorType", h["color_type"] in SAMPLES),
        ("InvalidColorBitDepthCombo", h["bit_depth"] in DEPTHS.get(h["color_type"], ())),
        ("InvalidCompressionMethod", h["compression"] == 0),
        ("InvalidFilterMethod", h["filter"] == 0),
        ("InvalidInterlaceMethod", h["interlace"] in (0, 1)),
    )
    for detail, holds in rules:
        if not holds:
            raise ImageError(label, detail)


def _cells(rows: np.ndarray, h: dict, width: int) -> np.ndarray:
    """Rows of bytes as (row, pixel, bytes of a pixel); pixels of less than a byte take one."""
    if h["bit_depth"] < 8:
        return unpack_rows(rows, h["bit_depth"], width)[:, :, None]
    return rows.reshape(len(rows), width, -1)


def _rows(cells: np.ndarray, h: dict) -> np.ndarray:
    if h["bit_depth"] < 8:
        return pack_rows(cells[:, :, 0], h["bit_depth"])
    return np.ascontiguousarray(cells).reshape(len(cells), -1)


def deinterlace(parts: list[np.ndarray], h: dict) -> np.ndarray:
    """The image's rows of bytes from the rows of its (not empty) passes."""
    size = 1 if h["bit_depth"] < 8 else pixel_bytes(h["color_type"], h["bit_depth"])
    image = np.zeros((h["height"], h["width"], size), np.uint8)
    for part, (_, w, _, x0, y0, dx, dy) in zip(parts, passes(h["width"], h["height"])):
        image[y0::dy, x0::dx] = _cells(part, h, w)
    return _rows(image, h)


def interlace(rows: np.ndarray, h: dict) -> list[np.ndarray]:
    """The rows of bytes of each pass that is not empty."""
    cells = _cells(rows, h, h["width"])
    return [_rows(cells[y0::dy, x0::dx], h) for _, _, _, x0, y0, dx, dy in passes(h["width"], h["height"])]


def pass_shapes(h: dict) -> list[tuple[int, int]]:
    """(rows, bytes a row without filter byte) of what is filtered on its own."""
    c, d = h["color_type"], h["bit_depth"]
    return [(n, row_bytes(w, c, d)) for _, w, n, *_ in passes(h["width"], h["height"])] if h["interlace"] else [(h["height"], row_bytes(h["width"], c, d))]


def unpack_pixels(stream: bytes, h: dict) -> bytes:
    """Pixels from a zlib stream of filtered rows."""
    shapes = pass_shapes(h)
    size = sum(n * (w + 1) for n, w in shapes)
    if size > MAX_BUFFER:
        raise ImageError("SizeOverflow")
    raw = decompress(stream, size)
    if len(raw) != size:
        raise ImageError("DecompressionFailed", "UnexpectedEndOfStream" if len(raw) < size else "OutputBufferFull")
    data, at, parts = np.frombuffer(raw, np.uint8), 0, []
    bpp = pixel_bytes(h["color_type"], h["bit_depth"])
    for n, w in shapes:
        try:
            parts.append(unfilter_rows(data[at : at + n * (w + 1)].reshape(n, w + 1), bpp))
        except ValueError as e:
            raise ImageError(str(e)) from None
        at += n * (w + 1)
    return (deinterlace(parts, h) if h["interlace"] else parts[0]).tobytes()


def pack_pixels(pixels: bytes, h: dict, level: str = "default", strategy: str = "adaptive") -> bytes:
    """The zlib stream of an image's filtered rows."""
    w = row_bytes(h["width"], h["color_type"], h["bit_depth"])
    if len(pixels) != w * h["height"]:
        raise ImageError("InvalidImage")
    rows = np.frombuffer(pixels, np.uint8).reshape(h["height"], w)
    bpp = pixel_bytes(h["color_type"], h["bit_depth"])
    return compress(b"".join(filter_rows(p, bpp, strategy).tobytes() for p in (interlace(rows, h) if h["interlace"] else [rows])), level)


def decode(content: bytes) -> dict:
    """header, pixels, palette of a file; raises ImageError with the label that a reader would give."""
    if content[:8] != SIGNATURE:
        raise ImageError("InvalidSignature")
    found = iterate(content)
    kind, data, crc = next(found, (None, b"", 0))
    if kind != "IHDR":
        raise ImageError("MissingIhdr")
    if zlib.crc32(b"IHDR" + data) != crc:
        raise ImageError("InvalidChunk")
    header = read_header(data)
    parts, size, colours, ended = [], 0, None, False
    for kind, data, crc in found:
        if zlib.crc32(kind.encode() + data) != crc:
            raise ImageError("InvalidChunk")
        if kind == "IDAT":
            size += len(data)
            if size > MAX_IDAT_TOTAL:
                raise ImageError("IdatTooLarge")
            parts.append(data)
        elif kind == "PLTE" and data and len(data) % 3 == 0 and len(data) <= 768:
            colours = [{"r": data[i], "g": data[i + 1], "b": data[i + 2]} for i in range(0, len(data), 3)]
        elif kind == "IEND":
            ended = True
            break
    if not size:
        raise ImageError("MissingIdat")
    if not ended:
        raise ImageError("PrematureEnd")
    return {"header": header, "pixels": unpack_pixels(b"".join(parts), header), "palette": colours}


def preamble(header: dict, colours: list | None) -> bytes:
    """Signature, IHDR and, for indexed images, PLTE."""
    check_header(header, "InvalidImage")
    out = SIGNATURE + write_chunk("IHDR", struct.pack(">IIBBBBB", *[header[k] for k in FIELDS]))
    if header["color_type"] == 3:
        if not colours or len(colours) > 256:
            raise ImageError("InvalidImage")
        out += write_chunk("PLTE", bytes(v for c in colours for v in (c["r"], c["g"], c["b"])))
    return out


def body(stream: bytes) -> bytes:
    """IDAT chunks of at most 32768 bytes, and IEND."""
    return b"".join(write_chunk("IDAT", stream[i : i + IDAT_PIECE]) for i in range(0, len(stream), IDAT_PIECE)) + write_chunk("IEND", b"")


def encode(header: dict, pixels: bytes, colours: list | None = None, level: str = "default", strategy: str = "adaptive") -> bytes:
    return preamble(header, colours) + body(pack_pixels(pixels, header, level, strategy))


def _over_rows(df: DataFrame, inputs: list[str], keys: list[str], schema: str, make: Callable[..., dict]) -> DataFrame:
    """``keys`` and the fields that ``make`` returns for each row's ``inputs``, or its error."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()
    kinds = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                values = [b.column(len(keys) + k)[i].as_py() for k in range(len(inputs))]
                try:
                    out.append(make(*values) if values[0] is not None else {})
                except ImageError as e:
                    out.append({"error": e.label, "detail": e.detail})
                if len(out) == 64 or i == b.num_rows - 1:
                    at = i + 1 - len(out)
                    yield pa.RecordBatch.from_arrays([*[b.column(k).slice(at, len(out)) for k in range(len(keys))], *[pa.array([o.get(n) for o in out], t) for n, t in zip(names, kinds)]], [*keys, *names])
                    out = []

    head = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.select(*keys, *inputs).mapInArrow(run, head + schema)


def _arrow(schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(schema)).types)


def decode_images(files: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, header, pixels, palette, error and detail for each row's ``content``; a null content gives nulls."""
    return _over_rows(files, ["content"], keys, IMAGE, decode)


def encode_images(images: DataFrame, keys: list[str], level: str = "default", strategy: str = "adaptive") -> DataFrame:
    """``keys``, content, error and detail for each row's header, pixels and (if there is one) palette."""
    inputs = ["header", "pixels"] + ["palette"] * ("palette" in images.columns)

    def make(header: dict, pixels: bytes | None, colours: list | None = None) -> dict:
        if pixels is None:
            raise ImageError("InvalidImage")
        return {"content": encode(header, pixels, colours, level, strategy)}

    return _over_rows(images, inputs, keys, "content binary, error string, detail string", make)


def transcode(files: DataFrame, keys: list[str], level: str = "default", strategy: str = "adaptive") -> DataFrame:
    """Files decoded and encoded anew; errors of either step are labelled."""

    def make(content: bytes) -> dict:
        image = decode(content)
        return {"content": encode(image["header"], image["pixels"], image["palette"], level, strategy)}

    return _over_rows(files, ["content"], keys, "content binary, error string, detail string", make)


def info(images: DataFrame, keys: list[str]) -> DataFrame:
    """The header's fields and the number of pixel bytes."""
    return images.select(*keys, "header.*", F.length("pixels").cast("bigint").alias("n_bytes"), "error")


def idat_pieces(stream: Column) -> Column:
    """Pieces of at most 32768 bytes, as an array of (idx, data)."""
    n = F.ceil(F.length(stream) / IDAT_PIECE).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("idx"), stream.substr(k * IDAT_PIECE + 1, F.lit(IDAT_PIECE)).alias("data"))))


def join_idat(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, the joined data of IDAT chunks in order, and IdatTooLarge beyond the limit."""
    idat = rows.where(F.col("type") == "IDAT")
    size = idat.groupBy(*keys).agg(F.sum("length").alias("n"))
    whole = idat.join(size.where(F.col("n") <= MAX_IDAT_TOTAL).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "data"))).alias("d"))
    joined = whole.select(*keys, F.unhex(F.array_join(F.transform("d", lambda x: F.hex(x["data"])), "")).alias("stream"))
    return size.join(joined, keys, "left").select(*keys, "stream", F.when(F.col("n") > MAX_IDAT_TOTAL, "IdatTooLarge").alias("error"))


def image_rows(images: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each row of pixels: ``keys``, y, data."""
    h = "header."
    w = F.floor((F.col(h + "width") * F.coalesce(*[F.when(F.col(h + "color_type") == k, v) for k, v in SAMPLES.items()]) * F.col(h + "bit_depth") + 7) / 8).cast("int")
    ys = F.sequence(F.lit(0).cast("bigint"), F.col(h + "height") - 1)
    rows = images.where(F.col("pixels").isNotNull()).select(*keys, "pixels", w.alias("_w"), F.explode(ys).alias("y"))
    return rows.select(*keys, "y", F.col("pixels").substr((F.col("y") * F.col("_w") + 1).cast("int"), F.col("_w")).alias("data"))


def pixel(header: str, pixels: str, x: Column, y: Column) -> Column:
    """The samples of a pixel as array<int>: 8 bits and less each its own, 16 bits high byte first; null out of bounds."""
    f = lambda c: F.col(f"{header}.{c}")
    depth, n = f("bit_depth"), F.coalesce(*[F.when(f("color_type") == k, v) for k, v in SAMPLES.items()])
    w = F.floor((f("width") * n * depth + 7) / 8)
    byte = lambda at: F.conv(F.hex(F.col(pixels).substr((at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    small = F.array(F.call_function("shiftright", byte(y * w + F.floor(x * depth / 8)), (F.lit(8) - depth - (x * depth) % 8).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1), depth) - 1))
    at = lambda k: y * w + x * n * F.floor(depth / 8) + k * F.floor(depth / 8)
    whole = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(depth == 16, byte(at(k)) * 256 + byte(at(k) + 1)).otherwise(byte(at(k))))
    return F.when((x >= 0) & (y >= 0) & (x < f("width")) & (y < f("height")), F.when(depth < 8, small).otherwise(whole))


HEADER_TYPE = HEADER
