"""The library's queries over the driver's tables, and SQL that gives the same rows.

Rows of ``embeddings`` serve as scanlines (image: label and ``TILE`` numbers of vec_id, so that no image grows with the
table; order: vec_id, samples quantised to bytes), texts of
``documents`` and ``pages`` as byte streams, keys of ``part`` and ``lineitem`` as header fields and lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, checksums, deflate, geometry, predict
from ..operators import chunks, codec, scanlines
from ..schema import ADAM7, ANCILLARY, CRITICAL


TILE = 1024


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """image, y, px: scanlines of 64 bytes."""
    px = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1) * 127.5).cast("int").bitwiseAND(255))
    tile = F.floor(F.col("vec_id") / TILE)
    return _table(spark, sf, "embeddings").select(F.concat("label", F.lit("/"), tile).alias("image"), F.col("vec_id").alias("y"), px.alias("px"))


def images(spark: SparkSession, sf: str, interlace: int = 0) -> DataFrame:
    """image, header, pixels: 8-bit grey images of a label's scanlines, at most ``TILE`` each, in order of vec_id."""
    rows = lines(spark, sf).withColumn("data", checksums.to_binary(F.col("px")))
    whole = rows.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("y", "data"))).alias("r"))
    # The rows of an image are 64 bytes each, and at most TILE unless vec_ids repeat.
    header = F.struct(F.lit(64).cast("bigint").alias("width"), F.size("r").cast("bigint").alias("height"), *[F.lit(v).alias(c) for c, v in (("bit_depth", 8), ("color_type", 0), ("compression", 0), ("filter", 0), ("interlace", interlace))])
    pixels = F.unhex(F.array_join(F.transform("r", lambda x: F.hex(x["data"])), ""))
    return whole.select("image", header.alias("header"), pixels.alias("pixels"))


def _cells(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.select("image", "y", F.posexplode(column).alias("i", name)).select("image", "y", F.col("i").cast("bigint").alias("i"), F.col(name).cast("bigint").alias(name))


def doc_crc32(spark: SparkSession, sf: str) -> DataFrame:
    data = F.encode("text", "utf-8")
    return _table(spark, sf, "documents").select("doc_id", checksums.crc32(data).alias("crc"), F.length(data).cast("bigint").alias("n_bytes"))


def doc_adler32(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("long")
    def adler(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else checksums.Running().update(t.encode()).adler)

    return _table(spark, sf, "documents").select("doc_id", adler("text").alias("adler"))


def chunk_type_flags(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.catalog(spark)


def _headers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    return _table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") * (k % 97) * (F.when(k % 11 == 0, F.lit(800000)).otherwise(F.lit(1)))).cast("bigint").alias("width"),
        ((k % 89) * F.when(k % 7 == 0, F.lit(45000000)).otherwise(F.lit(3))).cast("bigint").alias("height"),
        pick([1, 2, 3, 4, 8, 16], F.floor(k / 3)).alias("depth"),
        pick([0, 2, 3, 4, 6, 5], k).alias("color"),
        F.when(k % 41 == 0, 1).otherwise(0).alias("comp"),
        F.when(k % 43 == 0, 1).otherwise(0).alias("filt"),
        pick([0, 1, 0, 1, 2], k).alias("lace"),
    )


_HEADERS_SQL = """h AS (SELECT p_partkey,
  (p_size * (p_partkey % 97) * CASE WHEN p_partkey % 11 = 0 THEN 800000 ELSE 1 END)::BIGINT AS width,
  ((p_partkey % 89) * CASE WHEN p_partkey % 7 = 0 THEN 45000000 ELSE 3 END)::BIGINT AS height,
  [1, 2, 3, 4, 8, 16][(p_partkey // 3) % 6 + 1] AS depth, [0, 2, 3, 4, 6, 5][p_partkey % 6 + 1] AS color,
  CASE WHEN p_partkey % 41 = 0 THEN 1 ELSE 0 END AS comp, CASE WHEN p_partkey % 43 = 0 THEN 1 ELSE 0 END AS filt,
  [0, 1, 0, 1, 2][p_partkey % 5 + 1] AS lace FROM part)"""
_COMBO = "(color = 0 AND depth IN (1, 2, 4, 8, 16) OR color IN (2, 4, 6) AND depth IN (8, 16) OR color = 3 AND depth IN (1, 2, 4, 8))"
_SAMPLES = "CASE color WHEN 0 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 6 THEN 4 END"


def ihdr_validate(spark: SparkSession, sf: str) -> DataFrame:
    """Headers written to 13 bytes, read back and judged."""
    h = _headers(spark, sf)
    names = dict(zip(("width", "height", "depth", "color", "comp", "filt", "lace"), codec.FIELDS))
    packed = h.select("p_partkey", F.struct(*[F.col(a).alias(b) for a, b in names.items()]).alias("h")).select("p_partkey", geometry.header_bytes("h").alias("ihdr"))
    back = packed.select("p_partkey", F.hex("ihdr").alias("ihdr"), geometry.parse_header(F.col("ihdr")).alias("g"))
    return back.select("p_partkey", "ihdr", geometry.header_error(*[F.col(f"g.{c}") for c in codec.FIELDS]).alias("error"))


def row_geometry(spark: SparkSession, sf: str) -> DataFrame:
    h = _headers(spark, sf)
    w, n, c, d = (F.col(x) for x in ("width", "height", "color", "depth"))
    h = h.where(geometry.valid_combo(c, d) & w.between(1, 1000000) & n.between(1, 1000000))
    return h.select(
        "p_partkey", geometry.samples(c).alias("samples"), geometry.color_name(c).alias("color_name"), geometry.has_alpha(c).alias("has_alpha"), geometry.uses_palette(c).alias("uses_palette"),
        geometry.bits_per_pixel(c, d).alias("bits_per_pixel"), geometry.bytes_per_pixel(c, d).alias("bytes_per_pixel"), geometry.bytes_per_row(w, c, d).alias("row_bytes"),
        geometry.bytes_per_row_with_filter(w, c, d).alias("row_bytes_with_filter"), geometry.raw_size(w, n, c, d).alias("raw_size"), geometry.max_encoded_size(w, n, c, d).alias("max_encoded_size"),
    )


def _small_headers(spark: SparkSession, sf: str) -> DataFrame:
    h = _headers(spark, sf).where(geometry.valid_combo(F.col("color"), F.col("depth")) & F.col("width").between(1, 1000000) & F.col("height").between(1, 1000000))
    return h.select("p_partkey", "width", "height", F.col("color").alias("color_type"), F.col("depth").alias("bit_depth"))


def adam7_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return scanlines.pass_geometry(_small_headers(spark, sf), ["p_partkey"]).select("p_partkey", F.col("pass").cast("bigint").alias("pass"), "pass_width", "pass_height", "row_bytes", "raw_bytes")


def interlaced_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return scanlines.interlaced_bytes(_small_headers(spark, sf), ["p_partkey"])


def adam7_pixel_pass(spark: SparkSession, sf: str) -> DataFrame:
    """Every pixel of the images: its pass, its place there, and the place that this maps back to."""
    cells = _pixels(spark, sf)
    told = scanlines.pixel_passes(cells)
    back = scanlines.image_pixels(told.withColumnRenamed("x", "x_was").withColumnRenamed("y", "y_was"))
    return back.select("image", F.col("x_was").alias("x"), F.col("y_was").alias("y"), F.col("pass").cast("bigint").alias("pass"), F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"), F.col("x").cast("bigint").alias("x_back"), F.col("y").cast("bigint").alias("y_back"))


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rows = lines(spark, sf).withColumn("row", F.row_number().over(Window.partitionBy("image").orderBy("y")) - 1)
    return rows.select("image", F.col("row").cast("bigint").alias("y"), F.posexplode("px").alias("x", "v")).select("image", F.col("x").cast("bigint").alias("x"), "y", "v")


def adam7_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each pass of each image, as text of hexadecimal bytes."""
    rows = scanlines.pass_rows(_pixels(spark, sf), ["image"])
    return rows.select("image", F.col("pass").cast("bigint").alias("pass"), F.col("py").cast("bigint").alias("py"), F.hex(checksums.to_binary(F.col("values"))).alias("data"))


def _filter(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _cells(scanlines.filter_all(lines(spark, sf), ["image"], "y", 1, (kind,)), f"f_{kind}", "v")

    query.__name__ = f"filter_{kind}"
    return query


def filter_scores(spark: SparkSession, sf: str) -> DataFrame:
    told = scanlines.filter_all(lines(spark, sf), ["image"], "y")
    return told.select("image", "y", *[predict.score(F.col(f"f_{k}")).alias(f"s_{k}") for k in scanlines.KINDS])


def filter_best(spark: SparkSession, sf: str) -> DataFrame:
    return scanlines.choose(lines(spark, sf), ["image"], "y").select("image", "y", F.col("filter").cast("bigint").alias("filter"))


def unfilter_sub(spark: SparkSession, sf: str) -> DataFrame:
    """The samples taken as differences: their sums along rows."""
    return _cells(scanlines.unfilter_sub(lines(spark, sf).withColumnRenamed("px", "data")), "px", "v")


def unfilter_up(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(scanlines.unfilter_up(lines(spark, sf).withColumnRenamed("px", "data"), ["image"], "y"), "px", "v")


def unfilter_adaptive(spark: SparkSession, sf: str) -> DataFrame:
    """Adaptively filtered rows, undone: the samples again."""
    told = scanlines.choose(lines(spark, sf), ["image"], "y").select("image", "y", "filter", "data")
    return _cells(scanlines.unfilter(told, ["image"], "y"), "px", "v")


def paeth_predictor(spark: SparkSession, sf: str) -> DataFrame:
    """The predictor on three neighbouring samples of each row."""
    rows = lines(spark, sf).select("image", "y", F.posexplode("px").alias("i", "a"), "px").where("i < 62")
    b, c = F.get("px", F.col("i") + 1), F.get("px", F.col("i") + 2)
    return rows.select("image", "y", F.col("i").cast("bigint").alias("i"), predict.paeth(F.col("a"), b, c).cast("bigint").alias("p"))


def bit_pack4(spark: SparkSession, sf: str) -> DataFrame:
    low = lines(spark, sf).withColumn("px", F.transform("px", lambda v: v.bitwiseAND(15)))
    return _cells(low.withColumn("packed", bits.pack_row(F.col("px"), 4)), "packed", "v")


def bit_unpack4(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(lines(spark, sf).withColumn("samples", bits.unpack_row(F.col("px"), 4, F.lit(128))), "samples", "v")


def bit_reverse(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select("p_partkey", "p_size", bits.bit_reverse(F.col("p_size"), 9).alias("reversed"))


def deflate_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Length and distance codes of values from the order lines."""
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 256 + 3).alias("len"), (F.col("l_orderkey") * 7 % 32768 + 1).alias("dist"))
    told = rows.withColumn("a", deflate.length_code_of(F.col("len"))).withColumn("b", deflate.distance_code_of(F.col("dist")))
    return told.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "len", F.col("a.code").alias("len_code"), F.col("a.extra_bits").alias("len_bits"), F.col("a.extra").alias("len_extra"), "dist", F.col("b.code").alias("dist_code"), F.col("b.extra_bits").alias("dist_bits"), F.col("b.extra").alias("dist_extra"))


def fixed_huffman_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Bits of each image's samples as literals of the fixed code."""
    cells = lines(spark, sf).select("image", F.explode("px").alias("v"))
    return cells.groupBy("image").agg(F.sum(deflate.fixed_length(F.col("v"))).alias("bits"), F.count("*").alias("n"))


def canonical_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed code's table: symbol, code, length, made by the canonical rule."""
    rows = [(s, c, n) for s, (c, n) in deflate.canonical(deflate.fixed_lengths()).items()]
    return spark.createDataFrame(rows, "symbol long, code long, length long")


def symbol_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each sample occurs, as needed for codes made to measure."""
    return lines(spark, sf).select("image", F.explode("px").alias("symbol")).select("image", F.col("symbol").cast("bigint").alias("symbol")).groupBy("image", "symbol").agg(F.count("*").alias("n"))


def zlib_header(spark: SparkSession, sf: str) -> DataFrame:
    levels = spark.createDataFrame([(k,) for k in deflate.CHAIN], "level string")
    return levels.select("level", deflate.zlib_header_of(F.col("level")).alias("word")).withColumn("error", deflate.zlib_header_error(F.col("word")))


def zlib_header_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every order key's last 16 bits taken as a stream's first two bytes."""
    return _table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 40503 % 65536).alias("word")).withColumn("error", deflate.zlib_header_error(F.col("word")))


def idat_split(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' bytes in pieces of at most 32768."""
    data = _table(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("stream"))
    flat = data.select("page_id", F.explode(codec.idat_pieces(F.col("stream"))).alias("x"))
    return flat.select("page_id", F.col("x.idx").cast("bigint").alias("idx"), F.length("x.data").cast("bigint").alias("n"))


def _roundtrip(interlace: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        files = codec.encode_images(images(spark, sf, interlace), ["image"])
        rows = codec.image_rows(codec.decode_images(files.select("image", "content"), ["image"]), ["image"])
        return rows.select("image", "y", F.hex("data").alias("data"))

    query.__name__ = "png_roundtrip" + "_adam7" * interlace
    return query


def image_info(spark: SparkSession, sf: str) -> DataFrame:
    files = codec.encode_images(images(spark, sf), ["image"], "best", "paeth")
    told = codec.info(codec.decode_images(files.select("image", "content"), ["image"]), ["image"])
    return told.select("image", "width", "height", F.col("bit_depth").cast("bigint").alias("bit_depth"), F.col("color_type").cast("bigint").alias("color_type"), F.col("interlace").cast("bigint").alias("interlace"), "n_bytes", "error")


def png_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of the encoded images, with their checks (IDAT sizes depend on the compressor, so are left out)."""
    files = codec.encode_images(images(spark, sf), ["image"], "store", "none").select("image", "content")
    rows = chunks.chunks(files, ["image"], with_data=False)
    return rows.select("image", F.col("idx").cast("bigint").alias("idx"), "type", "crc_ok", chunks.is_critical(F.col("type")).alias("critical"), "error")


def chunk_order(spark: SparkSession, sf: str) -> DataFrame:
    files = codec.encode_images(images(spark, sf), ["image"], "store", "none").select("image", "content")
    return chunks.order_report(chunks.chunks(files, ["image"], with_data=False), ["image"]).drop("idat_bytes")


def image_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Single pixels by place: the diagonal of each decoded image, and one place out of bounds."""
    files = codec.encode_images(images(spark, sf), ["image"]).select("image", "content")
    told = codec.decode_images(files, ["image"]).select("image", "header", "pixels", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("x"))
    return told.select("image", F.col("x").cast("bigint").alias("x"), F.get(codec.pixel("header", "pixels", F.col("x"), F.col("x") % F.col("header.height")), 0).cast("bigint").alias("v"))


def lz77_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Documents tokenised and expanded again: the text, and what the tokens must cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [deflate.expand(deflate.tokens((t or "").encode(), "fastest")).decode() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    # The kernel takes seconds a megabyte: small files are dealt over all cores.
    docs = _table(spark, sf, "documents").select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return docs.mapInArrow(run, "doc_id long, text string")


def zlib_streams(spark: SparkSession, sf: str) -> DataFrame:
    """Pages compressed with the fixed code and inflated again, with the stream's first bytes and checksum checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [deflate.compress((t or "").encode(), "default") for t in b.column(1).to_pylist()]
            back = [deflate.decompress(p).decode() for p in packed]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(back, pa.string()), pa.array([p[:1].hex() for p in packed], pa.string())], ["page_id", "html", "cmf"])

    return _table(spark, sf, "pages").select("page_id", "html").mapInArrow(run, "page_id long, html string, cmf string")


_IMAGE = f"label || '/' || vec_id // {TILE}"
_LINES = f"q AS (SELECT {_IMAGE} AS image, vec_id AS y, list_transform(embedding, lambda v: (floor((v::DOUBLE + 1) * 127.5)::BIGINT & 255)) AS px FROM embeddings)"
_NEAR = f"""WITH {_LINES}, p AS (SELECT *, lag(px) OVER (PARTITION BY image ORDER BY y) AS up FROM q),
n AS (SELECT image, y, unnest(range(64)) AS i, px, up FROM p),
s AS (SELECT image, y, i, px[i + 1] AS x, CASE WHEN i > 0 THEN px[i] ELSE 0 END AS a, coalesce(up[i + 1], 0) AS b, CASE WHEN i > 0 THEN coalesce(up[i], 0) ELSE 0 END AS c FROM n),
f AS (SELECT image, y, i, x AS f_none, (x - a) & 255 AS f_sub, (x - b) & 255 AS f_up, (x - ((a + b) >> 1)) & 255 AS f_average,
  (x - CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END) & 255 AS f_paeth FROM s)"""
_SCORES = _NEAR + ", t AS (SELECT image, y, " + ", ".join(f"sum(least(f_{k}, 256 - f_{k}))::BIGINT AS s_{k}" for k in scanlines.KINDS) + " FROM f GROUP BY 1, 2)"
_PASS = "CASE WHEN y % 8 = 0 AND x % 8 = 0 THEN 0 WHEN y % 8 = 0 AND x % 8 = 4 THEN 1 WHEN y % 8 = 4 AND x % 4 = 0 THEN 2 WHEN y % 4 = 0 AND x % 4 = 2 THEN 3 WHEN y % 4 = 2 AND x % 2 = 0 THEN 4 WHEN y % 2 = 0 AND x % 2 = 1 THEN 5 ELSE 6 END"
_DIMS = "d(pass, x0, y0, dx, dy) AS (VALUES " + ", ".join(f"({k}, {', '.join(map(str, p))})" for k, p in enumerate(ADAM7)) + ")"
_PIXELS = f"{_LINES}, r AS (SELECT image, px, row_number() OVER (PARTITION BY image ORDER BY y) - 1 AS y FROM q), c AS (SELECT image, y, unnest(range(64)) AS x, unnest(px) AS v FROM r)"
_HEX = "upper(string_agg(printf('%02x', {v}), '' ORDER BY {o}))"
_BYTES = "list_transform(range(octet_length({b})), lambda i: ('0x' || substr(hex({b}), (2 * i + 1)::INT, 2))::BIGINT)"
_GEOMETRY = f"""g AS (SELECT *, {_SAMPLES} AS n FROM h WHERE {_COMBO} AND width BETWEEN 1 AND 1000000 AND height BETWEEN 1 AND 1000000)"""
_ADAM = f"""WITH {_HEADERS_SQL}, {_GEOMETRY}, {_DIMS},
m AS (SELECT p_partkey, pass, greatest(0, (width - x0 + dx - 1) // dx) AS pw, greatest(0, (height - y0 + dy - 1) // dy) AS ph, n * depth AS bpp FROM g, d),
z AS (SELECT p_partkey, pass::BIGINT AS pass, pw::BIGINT AS pass_width, ph::BIGINT AS pass_height, (CASE WHEN pw = 0 THEN 0 ELSE (pw * bpp + 7) // 8 + 1 END)::BIGINT AS row_bytes FROM m)"""


def _steps(base: str, table: list[tuple[int, int]], first: int) -> str:
    rows = ", ".join(f"({first + k}, {b}, {e})" for k, (b, e) in enumerate(table))
    return f"{base}(code, low, bits) AS (VALUES {rows})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        doc_crc32, doc_adler32, chunk_type_flags, ihdr_validate, row_geometry, adam7_geometry, interlaced_bytes, adam7_pixel_pass, adam7_rows,
        *map(_filter, scanlines.KINDS[1:]), filter_scores, filter_best, unfilter_sub, unfilter_up, unfilter_adaptive, paeth_predictor, bit_pack4, bit_unpack4,
        bit_reverse, deflate_codes, fixed_huffman_bits, canonical_codes, symbol_counts, zlib_header, zlib_header_errors, idat_split, _roundtrip(0), _roundtrip(1),
        image_info, png_chunks, chunk_order, image_pixels, lz77_tokens, zlib_streams,
    )
}
_FLAGS = "ascii(substr(type, {p}, 1)) & 32 {op} 0"
_WORD_ERROR = "CASE WHEN word % 31 <> 0 THEN 'InvalidChecksum' WHEN (word >> 8) & 15 <> 8 THEN 'InvalidCompressionMethod' WHEN word >> 12 > 7 THEN 'InvalidWindowSize' WHEN word & 32 <> 0 THEN 'DictNotSupported' END"
ORACLE_SQL: dict[str, str] = {
    "doc_crc32": f"""WITH t AS (SELECT list(list_reduce(range(8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, n) ORDER BY n) AS tab FROM range(256) r(n)),
b AS (SELECT doc_id, {_BYTES.format(b="encode(text)")} AS b FROM documents)
SELECT doc_id, xor(list_reduce(b, lambda acc, x: xor(acc >> 8, tab[(xor(acc, x) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS crc, len(b)::BIGINT AS n_bytes FROM b, t""",
    "doc_adler32": f"""WITH b AS (SELECT doc_id, {_BYTES.format(b="encode(text)")} AS b FROM documents),
u AS (SELECT doc_id, len(b) AS n, unnest(b) AS x, unnest(range(len(b))) AS i FROM b)
SELECT doc_id, ((sum(x * (n - i)) + any_value(n)) % 65521 * 65536 + (1 + sum(x)) % 65521)::BIGINT AS adler FROM u GROUP BY 1
UNION ALL SELECT doc_id, 1 FROM documents WHERE text = ''""",
    "chunk_type_flags": f"SELECT type, {_FLAGS.format(p=1, op='=')} AS critical, {_FLAGS.format(p=2, op='=')} AS public, {_FLAGS.format(p=4, op='<>')} AS safe_to_copy FROM (VALUES " + ", ".join(f"('{t}')" for t in CRITICAL + ANCILLARY) + ") v(type)",
    "ihdr_validate": f"""WITH {_HEADERS_SQL} SELECT p_partkey, upper(printf('%08x%08x%02x%02x%02x%02x%02x', width, height, depth, color, comp, filt, lace)) AS ihdr,
CASE WHEN NOT width BETWEEN 1 AND 1000000000 THEN 'InvalidWidth' WHEN NOT height BETWEEN 1 AND 1000000000 OR width * height > 4000000000 THEN 'InvalidHeight'
  WHEN depth NOT IN (1, 2, 4, 8, 16) THEN 'InvalidBitDepth' WHEN color NOT IN (0, 2, 3, 4, 6) THEN 'InvalidColorType' WHEN NOT {_COMBO} THEN 'InvalidColorBitDepthCombo'
  WHEN comp <> 0 THEN 'InvalidCompressionMethod' WHEN filt <> 0 THEN 'InvalidFilterMethod' WHEN lace > 1 THEN 'InvalidInterlaceMethod' END AS error FROM h""",
    "row_geometry": f"""WITH {_HEADERS_SQL}, {_GEOMETRY}, r AS (SELECT *, n * depth AS bpp, (width * n * depth + 7) // 8 AS rb FROM g), e AS (SELECT *, rb * height + 4 * height + 14 AS f FROM r), m AS (SELECT *, f + f // 8 + f // 64 + 64 AS c FROM e)
SELECT p_partkey, n::BIGINT AS samples, CASE color WHEN 0 THEN 'grayscale' WHEN 2 THEN 'rgb' WHEN 3 THEN 'indexed' WHEN 4 THEN 'grayscale_alpha' ELSE 'rgba' END AS color_name, color IN (4, 6) AS has_alpha, color = 3 AS uses_palette,
bpp::BIGINT AS bits_per_pixel, greatest(1, bpp // 8)::BIGINT AS bytes_per_pixel, rb::BIGINT AS row_bytes, (rb + 1)::BIGINT AS row_bytes_with_filter, ((rb + 1) * height)::BIGINT AS raw_size, (c + 825 + (c + 32767) // 32768 * 12)::BIGINT AS max_encoded_size FROM m""",
    "adam7_geometry": _ADAM + " SELECT *, (row_bytes * pass_height)::BIGINT AS raw_bytes FROM z",
    "interlaced_bytes": _ADAM + " SELECT p_partkey, sum(row_bytes * pass_height)::BIGINT AS raw_bytes FROM z GROUP BY 1",
    "adam7_pixel_pass": f"""WITH {_PIXELS}, {_DIMS}, k AS (SELECT image, x, y, {_PASS} AS pass FROM c)
SELECT image, x::BIGINT AS x, y::BIGINT AS y, k.pass::BIGINT AS pass, ((x - x0) // dx)::BIGINT AS px, ((y - y0) // dy)::BIGINT AS py, x::BIGINT AS x_back, y::BIGINT AS y_back FROM k JOIN d ON k.pass = d.pass""",
    "adam7_rows": f"""WITH {_PIXELS}, {_DIMS}, k AS (SELECT image, x, y, v, {_PASS} AS pass FROM c)
SELECT image, k.pass::BIGINT AS pass, ((y - y0) // dy)::BIGINT AS py, {_HEX.format(v="v", o="x")} AS data FROM k JOIN d ON k.pass = d.pass GROUP BY 1, 2, 3""",
    **{f"filter_{k}": _NEAR + f" SELECT image, y, i::BIGINT AS i, f_{k}::BIGINT AS v FROM f" for k in scanlines.KINDS[1:]},
    "filter_scores": _SCORES + " SELECT * FROM t",
    "filter_best": _SCORES + " SELECT image, y, (CASE least(s_none, s_sub, s_up, s_average, s_paeth) WHEN s_none THEN 0 WHEN s_sub THEN 1 WHEN s_up THEN 2 WHEN s_average THEN 3 ELSE 4 END)::BIGINT AS filter FROM t",
    "unfilter_sub": f"WITH {_LINES}, u AS (SELECT image, y, unnest(range(64)) AS i, unnest(px) AS x FROM q) SELECT image, y, i::BIGINT AS i, (sum(x) OVER (PARTITION BY image, y ORDER BY i) % 256)::BIGINT AS v FROM u",
    "unfilter_up": f"WITH {_LINES}, u AS (SELECT image, y, unnest(range(64)) AS i, unnest(px) AS x FROM q) SELECT image, y, i::BIGINT AS i, (sum(x) OVER (PARTITION BY image, i ORDER BY y) % 256)::BIGINT AS v FROM u",
    "unfilter_adaptive": f"WITH {_LINES} SELECT image, y, unnest(range(64))::BIGINT AS i, unnest(px)::BIGINT AS v FROM q",
    "paeth_predictor": f"""WITH {_LINES}, u AS (SELECT image, y, unnest(range(62)) AS i, px FROM q), s AS (SELECT image, y, i, px[i + 1] AS a, px[i + 2] AS b, px[i + 3] AS c FROM u)
SELECT image, y, i::BIGINT AS i, (CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END)::BIGINT AS p FROM s""",
    "bit_pack4": f"WITH {_LINES}, u AS (SELECT image, y, unnest(range(32)) AS i, px FROM q) SELECT image, y, i::BIGINT AS i, ((px[2 * i + 1] & 15) * 16 + (px[2 * i + 2] & 15))::BIGINT AS v FROM u",
    "bit_unpack4": f"WITH {_LINES}, u AS (SELECT image, y, unnest(range(128)) AS i, px FROM q) SELECT image, y, i::BIGINT AS i, (CASE WHEN i % 2 = 0 THEN px[i // 2 + 1] >> 4 ELSE px[i // 2 + 1] & 15 END)::BIGINT AS v FROM u",
    "bit_reverse": "SELECT p_partkey, p_size, (list_sum(list_transform(range(9), lambda k: ((p_size >> k) & 1) << (8 - k))))::BIGINT AS reversed FROM part",
    "deflate_codes": f"""WITH {_steps("a", deflate.LENGTHS, 257)}, {_steps("b", deflate.DISTANCES, 0)},
v AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey % 256 + 3 AS len, l_orderkey * 7 % 32768 + 1 AS dist FROM lineitem)
SELECT l_orderkey, l_linenumber, len, a.code::BIGINT AS len_code, a.bits::BIGINT AS len_bits, (len - a.low)::BIGINT AS len_extra, dist, b.code::BIGINT AS dist_code, b.bits::BIGINT AS dist_bits, (dist - b.low)::BIGINT AS dist_extra
FROM v ASOF JOIN a ON v.len >= a.low ASOF JOIN b ON v.dist >= b.low""",
    "fixed_huffman_bits": f"WITH {_LINES}, u AS (SELECT image, unnest(px) AS x FROM q) SELECT image, sum(CASE WHEN x < 144 THEN 8 ELSE 9 END)::BIGINT AS bits, count(*) AS n FROM u GROUP BY 1",
    "canonical_codes": "SELECT s::BIGINT AS symbol, (CASE WHEN s < 144 THEN 48 + s WHEN s < 256 THEN 400 + s - 144 WHEN s < 280 THEN s - 256 ELSE 192 + s - 280 END)::BIGINT AS code, (CASE WHEN s < 144 THEN 8 WHEN s < 256 THEN 9 WHEN s < 280 THEN 7 ELSE 8 END)::BIGINT AS length FROM range(288) r(s)",
    "symbol_counts": f"WITH {_LINES}, u AS (SELECT image, unnest(px) AS x FROM q) SELECT image, x::BIGINT AS symbol, count(*) AS n FROM u GROUP BY 1, 2",
    "zlib_header": f"SELECT level, word::BIGINT AS word, {_WORD_ERROR} AS error FROM (VALUES ('store', 30721), ('fastest', 30721), ('fast', 30814), ('default', 30876), ('best', 30938)) v(level, word)",
    "zlib_header_errors": f"WITH w AS (SELECT o_orderkey, o_orderkey * 40503 % 65536 AS word FROM orders) SELECT o_orderkey, word, {_WORD_ERROR} AS error FROM w",
    "idat_split": "WITH p AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages), u AS (SELECT page_id, n, unnest(range((n + 32767) // 32768)) AS k FROM p) SELECT page_id, k::BIGINT AS idx, least(32768, n - 32768 * k)::BIGINT AS n FROM u",
    **{f"png_roundtrip{x}": f"WITH {_LINES}, r AS (SELECT image, px, row_number() OVER (PARTITION BY image ORDER BY y) - 1 AS y FROM q) SELECT image, y::BIGINT AS y, upper(array_to_string(list_transform(px, lambda v: printf('%02x', v)), '')) AS data FROM r" for x in ("", "_adam7")},
    "image_info": f"SELECT {_IMAGE} AS image, 64::BIGINT AS width, count(*) AS height, 8::BIGINT AS bit_depth, 0::BIGINT AS color_type, 0::BIGINT AS interlace, (64 * count(*))::BIGINT AS n_bytes, NULL::VARCHAR AS error FROM embeddings GROUP BY 1",
    "png_chunks": f"""WITH e AS (SELECT {_IMAGE} AS image, count(*) * 65 AS n FROM embeddings GROUP BY 1), s AS (SELECT image, n + 6 + 5 * ((n + 65534) // 65535) AS z FROM e), k AS (SELECT image, (z + 32767) // 32768 AS m FROM s),
u AS (SELECT image, m, unnest(range(m + 2)) AS i FROM k) SELECT image, i::BIGINT AS idx, CASE i WHEN 0 THEN 'IHDR' WHEN m + 1 THEN 'IEND' ELSE 'IDAT' END AS type, true AS crc_ok, true AS critical, NULL::VARCHAR AS error FROM u""",
    "chunk_order": f"SELECT DISTINCT {_IMAGE} AS image, 'IHDR' AS first_type, true AS has_iend, 0::BIGINT AS extra_ihdr, 0::BIGINT AS unknown_critical, NULL::BOOLEAN AS late_plte FROM embeddings",
    "image_pixels": f"""WITH {_LINES}, r AS (SELECT image, px, row_number() OVER (PARTITION BY image ORDER BY y) - 1 AS y, count(*) OVER (PARTITION BY image) AS h FROM q), k AS (SELECT image, any_value(h) AS h, unnest(range(65)) AS x FROM r GROUP BY image)
SELECT k.image, x::BIGINT AS x, CASE WHEN x < 64 THEN px[x + 1] END::BIGINT AS v FROM k JOIN r ON r.image = k.image AND r.y = x % k.h""",
    "lz77_tokens": "SELECT doc_id, text FROM documents",
    "zlib_streams": "SELECT page_id, html, '78' AS cmf FROM pages",
}

from . import kernel_queries  # noqa: E402

QUERIES |= kernel_queries.QUERIES
ORACLE_SQL |= kernel_queries.ORACLE_SQL
