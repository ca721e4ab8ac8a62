"""Tables of rows of bytes: filtering with window functions, choosing filters, undoing them, Adam7 by pixels.

Row tables have ``image`` keys, an order column and ``px`` array<int>. Filtering is one shuffle by image (and pass) for
``lag``; undoing filters that depend on what is undone before runs in one kernel an image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import adam7, pass_of, pass_row_bytes, pass_size
from ..functions.predict import best, filtered, score, unfilter_rows, unfiltered_sub

KINDS = ("none", "sub", "up", "average", "paeth")


def with_above(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``above``, the raw row before in its image; zeros for the first."""
    before = F.lag("px").over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("above", F.coalesce(before, F.transform("px", lambda x: F.lit(0))))


def filter_all(rows: DataFrame, keys: list[str], order: str, bpp: int = 1, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``rows`` with a column for each filter asked for."""
    told = with_above(rows, keys, order)
    return told.select("*", *[filtered(F.col("px"), F.col("above"), KINDS.index(k), bpp).alias(f"f_{k}") for k in kinds])


def choose(rows: DataFrame, keys: list[str], order: str, bpp: int = 1, strategy: str = "adaptive") -> DataFrame:
    """``rows`` with ``filter`` and ``data``: the row under the filter of the strategy (adaptive: of the least score)."""
    if strategy != "adaptive":
        k = KINDS.index(strategy)
        return filter_all(rows, keys, order, bpp, (strategy,)).withColumn("filter", F.lit(k)).withColumnRenamed(f"f_{strategy}", "data").drop("above")
    told = filter_all(rows, keys, order, bpp).withColumn("filter", best([score(F.col(f"f_{k}")) for k in KINDS]))
    return told.withColumn("data", F.element_at(F.array(*[F.col(f"f_{k}") for k in KINDS]), F.col("filter") + 1)).drop("above", *[f"f_{k}" for k in KINDS])


def unfilter_sub(rows: DataFrame, bpp: int = 1, column: str = "data") -> DataFrame:
    """Undoes Sub, which depends on nothing outside the row."""
    return rows.withColumn("px", unfiltered_sub(F.col(column), bpp))


def unfilter_up(rows: DataFrame, keys: list[str], order: str, column: str = "data") -> DataFrame:
    """Undoes Up over images all of whose rows have it: a running sum of each column, modulo 256."""
    cells = rows.select(*keys, order, F.posexplode(column).alias("i", "x"))
    total = F.sum("x").over(Window.partitionBy(*keys, "i").orderBy(order)).bitwiseAND(255).cast("int")
    return cells.select(*keys, order, "i", total.alias("v")).groupBy(*keys, order).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("px"))


def unfilter(rows: DataFrame, keys: list[str], order: str, bpp: int = 1) -> DataFrame:
    """Undoes any mix of filters: rows (``filter``, ``data`` array<int>) back to ``px``, one image at a time.

    An unknown filter byte gives InvalidFilterType in ``error`` for the image's rows.
    """
    head = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, order])

    def undo(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        data = np.column_stack((pdf["filter"].to_numpy(), np.stack(pdf["data"].to_numpy()))).astype(np.uint8) if len(pdf) else np.zeros((0, 1), np.uint8)
        try:
            px, error = list(unfilter_rows(data, bpp).astype(np.int32)), None
        except ValueError as e:
            px, error = [None] * len(pdf), str(e)
        return pdf[[*keys, order]].assign(px=px, error=error)

    return rows.select(*keys, order, "filter", "data").groupBy(*keys).applyInPandas(undo, f"{head}, px array<int>, error string")


def pixel_passes(pixels: DataFrame) -> DataFrame:
    """Pixels (x, y) with their Adam7 pass and their place in it."""
    told = pixels.withColumn("pass", pass_of(F.col("x"), F.col("y")))
    dims = F.broadcast(adam7(pixels.sparkSession))  # seven rows
    return told.join(dims, "pass").withColumn("px", F.floor((F.col("x") - F.col("x0")) / F.col("dx"))).withColumn("py", F.floor((F.col("y") - F.col("y0")) / F.col("dy"))).drop("x0", "y0", "dx", "dy")


def image_pixels(parts: DataFrame) -> DataFrame:
    """The inverse: places in passes (pass, px, py) as image places x, y."""
    dims = F.broadcast(adam7(parts.sparkSession))
    return parts.join(dims, "pass").withColumn("x", F.col("x0") + F.col("px") * F.col("dx")).withColumn("y", F.col("y0") + F.col("py") * F.col("dy")).drop("x0", "y0", "dx", "dy")


def pass_rows(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (x, y, v) gathered as rows of their passes: ``keys``, pass, py, values in order."""
    return _gather(pixel_passes(pixels), [*keys, "pass", "py"], "px")


def full_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Pass pixels (pass, px, py, v) scattered back to rows of the image: ``keys``, y, values in order."""
    return _gather(image_pixels(parts), [*keys, "y"], "x")


def _gather(cells: DataFrame, keys: list[str], place: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("i"), "v"))), lambda x: x["v"]).alias("values"))


def pass_geometry(headers: DataFrame, keys: list[str]) -> DataFrame:
    """For each header row (width, height, color_type, bit_depth) and pass: its size and bytes."""
    c, d = F.col("color_type"), F.col("bit_depth")
    told = headers.crossJoin(F.broadcast(adam7(headers.sparkSession)))  # seven rows a header
    w, h = pass_size(F.col("width"), F.col("x0"), F.col("dx")), pass_size(F.col("height"), F.col("y0"), F.col("dy"))
    line = pass_row_bytes(F.col("width"), F.col("x0"), F.col("dx"), c, d, True)
    return told.select(*keys, "pass", w.alias("pass_width"), h.alias("pass_height"), line.alias("row_bytes"), (line * h).alias("raw_bytes"))


def interlaced_bytes(headers: DataFrame, keys: list[str]) -> DataFrame:
    """The bytes of all passes of each header."""
    return pass_geometry(headers, keys).groupBy(*keys).agg(F.sum("raw_bytes").alias("raw_bytes"))

