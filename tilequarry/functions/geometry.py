"""Sizes, limits and header fields of images as expressions over BIGINT columns, and the same in Python for kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ADAM7, COLOR_NAMES, DEPTHS, FILTER_NAMES, INTERLACE_NAMES, MAX_DIMENSION, MAX_PIXELS, SAMPLES


def _named(value: Column, names: dict[int, str]) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in names.items()])


def color_name(v: Column) -> Column:
    """The colour type's name; null for a byte that is none."""
    return _named(v, COLOR_NAMES)


def interlace_name(v: Column) -> Column:
    return _named(v, INTERLACE_NAMES)


def filter_name(v: Column) -> Column:
    return _named(v, FILTER_NAMES)


def bit_depth(v: Column) -> Column:
    """The byte if it is a bit depth, else null."""
    return F.when(v.isin(1, 2, 4, 8, 16), v)


def method_zero(v: Column) -> Column:
    """Compression and filter methods: only 0 exists."""
    return F.when(v == 0, v)


def samples(color: Column) -> Column:
    return F.coalesce(*[F.when(color == k, F.lit(v)) for k, v in SAMPLES.items()]).cast("bigint")


def uses_palette(color: Column) -> Column:
    return color == 3


def has_alpha(color: Column) -> Column:
    return color.isin(4, 6)


def valid_combo(color: Column, depth: Column) -> Column:
    """Whether the colour type allows the bit depth."""
    return F.coalesce(*[F.when(color == k, depth.isin(*v)) for k, v in DEPTHS.items()], F.lit(False))


def bits_per_pixel(color: Column, depth: Column) -> Column:
    return samples(color) * depth


def bytes_per_pixel(color: Column, depth: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.floor(bits_per_pixel(color, depth) / 8))


def bytes_per_row(width: Column, color: Column, depth: Column) -> Column:
    return F.floor((width * bits_per_pixel(color, depth) + 7) / 8)


def bytes_per_row_with_filter(width: Column, color: Column, depth: Column) -> Column:
    return bytes_per_row(width, color, depth) + 1


def raw_size(width: Column, height: Column, color: Column, depth: Column) -> Column:
    return bytes_per_row_with_filter(width, color, depth) * height


def is_interlaced(interlace: Column) -> Column:
    return interlace == 1


def max_encoded_size(width: Column, height: Column, color: Column, depth: Column) -> Column:
    """An upper bound: rows (of Adam7 at most 2 * height + 7, each with a filter byte and a byte begun), an eighth and a
    64th for bytes that need nine bits, signature, IHDR, PLTE and IEND, and 12 bytes for each IDAT."""
    filtered = bytes_per_row(width, color, depth) * height + 4 * height + 14
    packed = filtered + F.floor(filtered / 8) + F.floor(filtered / 64) + 64
    return packed + 825 + F.ceil(packed / 32768) * 12


def header_error(width: Column, height: Column, depth: Column, color: Column, compression: Column, filter_: Column, interlace: Column) -> Column:
    """The first rule that a header breaks, in the order in which a decoder checks them; null if none."""
    return F.coalesce(
        F.when(~width.between(1, MAX_DIMENSION), "InvalidWidth"),
        F.when(~height.between(1, MAX_DIMENSION), "InvalidHeight"),
        F.when(width * height > MAX_PIXELS, "InvalidHeight"),
        F.when(bit_depth(depth).isNull(), "InvalidBitDepth"),
        F.when(color_name(color).isNull(), "InvalidColorType"),
        F.when(~valid_combo(color, depth), "InvalidColorBitDepthCombo"),
        F.when(compression != 0, "InvalidCompressionMethod"),
        F.when(filter_ != 0, "InvalidFilterMethod"),
        F.when(~interlace.isin(0, 1), "InvalidInterlaceMethod"),
    )


def _field(data: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, n)), 16, 10).cast("bigint")


def parse_header(data: Column) -> Column:
    """The fields of 13 bytes of IHDR; null for another length."""
    names = ("bit_depth", "color_type", "compression", "filter", "interlace")
    fields = [_field(data, 1, 4).alias("width"), _field(data, 5, 4).alias("height")]
    return F.when(F.length(data) == 13, F.struct(*fields, *[_field(data, 9 + k, 1).cast("int").alias(c) for k, c in enumerate(names)]))


def header_bytes(h: str) -> Column:
    """13 bytes from a header struct column."""
    part = lambda c, n: F.lpad(F.hex(F.col(f"{h}.{c}").cast("bigint")), 2 * n, "0")
    return F.unhex(F.concat(part("width", 4), part("height", 4), *[part(c, 1) for c in ("bit_depth", "color_type", "compression", "filter", "interlace")]))


def adam7(spark: SparkSession) -> DataFrame:
    """The seven passes: pass, x0, y0, dx, dy."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(ADAM7)], "pass int, x0 int, y0 int, dx int, dy int")


def pass_size(size: Column, origin: Column, step: Column) -> Column:
    """Pixels of an axis that a pass takes."""
    return F.greatest(F.lit(0).cast("bigint"), F.floor((size - origin + step - 1) / step))


def pass_row_bytes(width: Column, origin: Column, step: Column, color: Column, depth: Column, with_filter: bool = False) -> Column:
    n = pass_size(width, origin, step)
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(bytes_per_row(n, color, depth) + int(with_filter))


def pass_of(x: Column, y: Column) -> Column:
    """The pass of a pixel."""
    return (
        F.when((y % 8 == 0) & (x % 8 == 0), 0).when((y % 8 == 0) & (x % 8 == 4), 1).when((y % 8 == 4) & (x % 4 == 0), 2)
        .when((y % 4 == 0) & (x % 4 == 2), 3).when((y % 4 == 2) & (x % 2 == 0), 4).when((y % 2 == 0) & (x % 2 == 1), 5).otherwise(6)
    )


def row_bytes(width: int, color: int, depth: int) -> int:
    return (width * SAMPLES[color] * depth + 7) // 8


def pixel_bytes(color: int, depth: int) -> int:
    return max(1, SAMPLES[color] * depth // 8)


def passes(width: int, height: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """pass, width, height, x0, y0, dx, dy of each pass that is not empty."""
    out = []
    for k, (x0, y0, dx, dy) in enumerate(ADAM7):
        w, h = max(0, -(-(width - x0) // dx)), max(0, -(-(height - y0) // dy))
        if w and h:
            out.append((k, w, h, x0, y0, dx, dy))
    return out
