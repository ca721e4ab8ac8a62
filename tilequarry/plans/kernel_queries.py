"""Queries whose rows tell what single kernels and the functions registered by name in SQL give, with SQL of their own.

Streams are written by one implementation and read by another (Python's zlib and the kernels here), and damaged files are
judged by label, so that a query that left its operator out would not give these rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, checksums, deflate, geometry, sql
from ..operators import chunks, codec
from . import queries as base

DAMAGE = {
    "none": None, "signature": "InvalidSignature", "signature only": "MissingIhdr", "no end": "PrematureEnd", "header crc": "InvalidChunk",
    "cut in header": "UnexpectedEndOfData", "depth 3": "InvalidIhdr", "no data": "MissingIdat", "first chunk lost": "MissingIhdr", "cut in data": "UnexpectedEndOfData",
}


def sql_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of headers by name, for all headers, valid or not (sides below a million)."""
    sql.register(spark)
    h = base._headers(spark, sf).withColumn("width", F.col("width") % 1000000).withColumn("height", F.col("height") % 1000000)
    return h.selectExpr(
        "p_partkey", "png_bits_per_pixel(color, depth) AS bits", "png_bytes_per_pixel(color, depth) AS bytes", "png_bytes_per_row(width, color, depth) AS row_bytes",
        "png_raw_size(width, height, color, depth) AS raw_size", "png_valid_combo(color, depth) AS combo", "png_max_encoded_size(width, height, color, depth) AS most", "lace", "comp", "depth",
    ).select("p_partkey", "bits", "bytes", "row_bytes", "raw_size", "combo", "most", geometry.is_interlaced(F.col("lace")).alias("interlaced"), geometry.interlace_name(F.col("lace")).alias("lace_name"), geometry.method_zero(F.col("comp")).cast("bigint").alias("method"), geometry.bit_depth(F.col("depth")).cast("bigint").alias("depth"), geometry.filter_name(F.col("p_partkey") % 6).alias("filter_name"))


def sql_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Length and distance codes by name, of values in and out of range."""
    sql.register(spark)
    v = base._table(spark, sf, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS bigint) AS l_linenumber", "CAST(l_partkey % 300 AS int) AS n", "CAST(l_orderkey * 7 % 40000 AS int) AS d")
    return v.selectExpr("l_orderkey", "l_linenumber", "CAST(deflate_length_code(n) AS bigint) AS length_code", "CAST(deflate_distance_code(d) AS bigint) AS distance_code")


def sql_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Functions of samples by name, on every scanline."""
    sql.register(spark)
    rows = base.lines(spark, sf).withColumn("data", checksums.to_binary(F.col("px")))
    return rows.selectExpr(
        "image", "y", "CAST(paeth(px[0], px[1], px[2]) AS bigint) AS predicted", "bit_reverse(px[0], 8) AS reversed", "sum_abs(px) AS total", "adler32(data) AS adler",
        "CAST(adam7_pass(px[0], y) AS bigint) AS pass", "adam7_width(y, CAST(px[1] % 7 AS int)) AS pass_width", "adam7_height(y, CAST(px[1] % 7 AS int)) AS pass_height",
        "zlib_header(CASE px[2] % 2 WHEN 0 THEN 'fast' ELSE 'best' END) AS head", "png_is_critical(CASE px[3] % 2 WHEN 0 THEN 'IDAT' ELSE 'tEXt' END) AS critical",
    )


def _bytes_udf(kind: str):
    def wrap(f):
        return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else f(t.encode())), kind)

    return wrap


def inflate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages compressed by Python's zlib in three ways and read block by block here."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, t in zip(f["page_id"], f["html"]):
                for mode, level, way in (("stored", 0, zlib.Z_DEFAULT_STRATEGY), ("fixed", 6, zlib.Z_FIXED), ("dynamic", 6, zlib.Z_DEFAULT_STRATEGY)):
                    c = zlib.compressobj(level, zlib.DEFLATED, -15, 8, way)
                    reader = deflate.BlockReader(c.compress((t or "").encode()) + c.flush())
                    kinds = {b["kind"] for b in reader.blocks()}
                    out.append((i, mode, ",".join(sorted(kinds)), hashlib.md5(bytes(reader.out)).hexdigest()))
            yield pd.DataFrame(out, columns=["page_id", "mode", "kinds", "digest"])

    pages = base._table(spark, sf, "pages").select("page_id", "html").where(F.octet_length("html") > 0)
    return pages.repartition(8).mapInPandas(read, "page_id long, mode string, kinds string, digest string")


def deflate_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Pages compressed here, by token and fixed code, and read by Python's zlib: what comes back, and whether it got shorter."""
    levels = ("fastest", "default")

    @_bytes_udf("array<string>")
    def there_and_back(data: bytes) -> list[str]:
        out = []
        for level in levels:
            stream = deflate.deflate_fixed(data, level)
            out.append(hashlib.md5(zlib.decompress(stream, -15)).hexdigest() + (" shorter" if len(stream) < len(data) else ""))
        return out

    pages = base._table(spark, sf, "pages").select("page_id", "html").where(F.octet_length("html") > 0).repartition(8)
    return pages.select("page_id", F.posexplode(there_and_back("html")).alias("level", "told")).select("page_id", F.col("level").cast("bigint").alias("level"), "told")


def bit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers written bit by bit, least first, then aligned and followed by a byte; read back the same way."""

    @F.pandas_udf("string")
    def write(size: pd.Series, key: pd.Series) -> pd.Series:
        def one(a: int, b: int) -> str:
            w = bits.BitWriter()
            w.write(a, 6)
            w.write(b, 11)
            w.flush()
            w.write_bytes(b"\x5a")
            return w.written.hex()

        return pd.Series([one(int(a), int(b)) for a, b in zip(size, key)])

    @F.pandas_udf("string")
    def read(data: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            r = bits.BitReader(bytes.fromhex(x))
            seen, a, b = r.peek(6), r.read(6), r.read(11)
            left = r.remaining_bytes
            return f"{seen} {a} {b} {left} {r.read_bytes(1).hex()} {r.is_at_end}"

        return data.map(one)

    written = base._table(spark, sf, "part").select("p_partkey", write("p_size", "p_partkey").alias("written"))
    return written.select("p_partkey", "written", read("written").alias("told"))


def palettes(spark: SparkSession, sf: str) -> DataFrame:
    """The first bytes of scanlines as PLTE data: colours, what is wrong with the length, and the bytes made of the colours."""
    rows = base.lines(spark, sf).withColumn("data", checksums.to_binary(F.slice("px", F.lit(1), (F.col("y") % 65).cast("int"))))
    colours = chunks.palette(F.col("data"))
    told = rows.select("image", "y", colours.alias("c"), chunks.palette_error(F.col("data")).alias("error"))
    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x["r"] + 2 * x["g"] + 3 * x["b"])
    return told.select("image", "y", F.when(F.col("c").isNotNull(), F.size("c")).cast("bigint").alias("n"), total.alias("total"), F.lower(F.hex(chunks.palette_bytes(F.col("c")))).alias("back"), "error")


def _damaged(c: Column) -> dict[str, Column]:
    at = lambda a, n=None: F.substring(c, a, F.lit(1 << 30) if n is None else F.lit(n))
    other = F.unhex(F.lpad(F.hex((F.conv(F.hex(at(33, 1)), 16, 10).cast("bigint") + 1) % 256), 2, "0"))
    bad_depth = chunks.chunk_bytes(F.lit("IHDR"), F.concat(at(17, 8), F.lit(b"\x03"), at(26, 4)))
    return {
        "none": c, "signature": F.concat(F.lit(b"\x00"), at(2)), "signature only": at(1, 8), "no end": F.substring(c, F.lit(1), F.length(c) - 12), "header crc": F.concat(at(1, 32), other, at(34)),
        "cut in header": at(1, 20), "depth 3": F.concat(at(1, 8), bad_depth, at(34)), "no data": F.concat(at(1, 33), F.substring(c, F.length(c) - 11, F.lit(12))), "first chunk lost": F.concat(at(1, 8), at(34)),
        "cut in data": F.substring(c, F.lit(1), F.length(c) - 13),
    }


def damaged_images(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded images, each damaged in several ways: the label that decoding gives, and whether the signature stands."""
    files = codec.encode_images(base.images(spark, sf), ["image"])
    ways = F.array(*[F.struct(F.lit(k).alias("damage"), v.alias("content")) for k, v in _damaged(F.col("content")).items()])
    rows = files.select("image", F.inline(ways)).withColumn("signed", chunks.has_signature(F.col("content")))
    return codec.decode_images(rows, ["image", "damage", "signed"]).select("image", "damage", "signed", "error")


def indexed_images(spark: SparkSession, sf: str) -> DataFrame:
    """Scanlines as interlaced indexed images of 1, 2 and 4 bits, encoded by the SQL function and told by table functions."""
    sql.register(spark)
    rows = base.lines(spark, sf)
    header = "named_struct('width', 64L, 'height', 1L, 'bit_depth', {d}, 'color_type', 3, 'compression', 0, 'filter', 0, 'interlace', 1)"
    each = []
    for d in (1, 2, 4):
        packed = checksums.to_binary(bits.pack_row(F.transform("px", lambda v: v.bitwiseAND((1 << d) - 1)), d))
        colours = f"transform(sequence(0, {(1 << d) - 1}), k -> named_struct('r', k, 'g', 2 * k, 'b', 255 - k))"
        each.append(rows.select("image", "y", F.lit(d).cast("bigint").alias("depth"), packed.alias("pixels")).selectExpr("image", "y", "depth", f"png_encode({header.format(d=d)}, pixels, {colours}, 'default').content AS content"))
    files = each[0].unionByName(each[1]).unionByName(each[2])
    name = "indexed_images_files"
    files.createOrReplaceTempView(name)
    kinds = spark.sql(f"SELECT image, y, depth, count(*) AS n_chunks, count_if(c.type = 'PLTE' AND c.length = 3 * shiftleft(1, CAST(depth AS int))) AS n_palettes, max(CASE WHEN c.type = 'IHDR' THEN png_parse_header(c.data).interlace END) AS lace FROM {name}, LATERAL png_chunks(content) c GROUP BY 1, 2, 3")
    samples = spark.sql(f"SELECT t.image, t.y, t.depth, sum(p.samples[0] * (p.x + 1)) AS weighted FROM {name} t, LATERAL png_pixels(t.content) p GROUP BY 1, 2, 3")
    data = spark.sql(f"SELECT t.image, t.y, t.depth, lower(hex(r.data)) AS data FROM {name} t, LATERAL png_rows(t.content) r").join(samples, ["image", "y", "depth"]).join(kinds, ["image", "y", "depth"])
    return data.selectExpr("image", "y", "depth", "data", "CAST(weighted AS bigint) AS weighted", "n_chunks", "n_palettes", "CAST(lace AS bigint) AS lace")


QUERIES = {f.__name__: f for f in (sql_geometry, sql_codes, sql_samples, inflate_blocks, deflate_blocks, bit_stream, palettes, damaged_images, indexed_images)}

# Fixed values of RFC 1951: the least value of each length code from 257 on and of each distance code from 0 on.
LENGTH_BASES = [3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258]
DISTANCE_BASES = [1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145, 8193, 12289, 16385, 24577]
_RAW = "(rb * height + 4 * height + 14)"
_GRID = [[0, 5, 3, 5, 1, 5, 3, 5], [6] * 8, [4, 5, 4, 5, 4, 5, 4, 5], [6] * 8, [2, 5, 3, 5, 2, 5, 3, 5], [6] * 8, [4, 5, 4, 5, 4, 5, 4, 5], [6] * 8]
_AXIS = "CASE WHEN y <= {o}[px[2] % 7 + 1] THEN 0 ELSE ceil((y - {o}[px[2] % 7 + 1]) / {s}[px[2] % 7 + 1]) END::BIGINT"
_NAMES = ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in DAMAGE.items())


def _packed(d: int) -> str:
    per = 8 // d
    value = " + ".join(f"(px[{per} * j + {k + 1}] & {(1 << d) - 1}) * {1 << (8 - d * (k + 1))}" for k in range(per))
    return f"array_to_string(list_transform(range({64 // per}), lambda j: printf('%02x', ({value})::INT)), '')"


ORACLE_SQL: dict[str, str] = {
    "sql_geometry": f"""WITH {base._HEADERS_SQL}, s AS (SELECT p_partkey, width % 1000000 AS width, height % 1000000 AS height, depth, color, comp, lace, ({base._SAMPLES}) * depth AS bpp, {base._COMBO} AS combo FROM h),
r AS (SELECT *, (width * bpp + 7) // 8 AS rb FROM s), c AS (SELECT *, {_RAW} + {_RAW} // 8 + {_RAW} // 64 + 64 AS z FROM r)
SELECT p_partkey, bpp::BIGINT AS bits, greatest(1, bpp // 8)::BIGINT AS bytes, rb::BIGINT AS row_bytes, ((rb + 1) * height)::BIGINT AS raw_size, combo, (825 + z + (z + 32767) // 32768 * 12)::BIGINT AS most,
lace = 1 AS interlaced, CASE lace WHEN 0 THEN 'none' WHEN 1 THEN 'adam7' END AS lace_name, CASE WHEN comp = 0 THEN 0 END::BIGINT AS method, CASE WHEN depth IN (1, 2, 4, 8, 16) THEN depth END::BIGINT AS depth,
['none', 'sub', 'up', 'average', 'paeth', NULL][p_partkey % 6 + 1] AS filter_name FROM c""",
    "sql_codes": f"""WITH v AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey % 300 AS n, l_orderkey * 7 % 40000 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n BETWEEN 3 AND 258 THEN 256 + len(list_filter({LENGTH_BASES}, lambda b: b <= n)) END::BIGINT AS length_code,
CASE WHEN d BETWEEN 1 AND 32768 THEN len(list_filter({DISTANCE_BASES}, lambda b: b <= d)) - 1 END::BIGINT AS distance_code FROM v""",
    "sql_samples": f"""WITH {base._LINES}, z AS (SELECT image, y, px, px[1] AS a, px[2] AS b, px[3] AS c FROM q)
SELECT image, y, CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END::BIGINT AS predicted,
list_sum(list_transform(range(8), lambda k: ((a >> k) & 1) << (7 - k)))::BIGINT AS reversed, list_sum(list_transform(px, lambda v: CASE WHEN v < 128 THEN v ELSE 256 - v END))::BIGINT AS total,
((64 + list_sum(list_transform(range(64), lambda k: (64 - k) * px[k + 1]))) % 65521 * 65536 + (1 + list_sum(px)) % 65521)::BIGINT AS adler,
{_GRID}[y % 8 + 1][a % 8 + 1]::BIGINT AS pass, {_AXIS.format(o=[0, 4, 0, 2, 0, 1, 0], s=[8, 8, 4, 4, 2, 2, 1])} AS pass_width, {_AXIS.format(o=[0, 0, 4, 0, 2, 0, 1], s=[8, 8, 8, 4, 4, 2, 2])} AS pass_height,
CASE c % 2 WHEN 0 THEN '785E' ELSE '78DA' END AS head, px[4] % 2 = 0 AS critical FROM z""",
    "inflate_blocks": "SELECT page_id, mode, mode AS kinds, md5(html) AS digest FROM pages, (VALUES ('stored'), ('fixed'), ('dynamic')) v(mode) WHERE octet_length(encode(html)) > 0",
    "deflate_blocks": "SELECT page_id, unnest([0, 1])::BIGINT AS level, md5(html) || ' shorter' AS told FROM pages WHERE octet_length(encode(html)) > 0",
    "bit_stream": """WITH v AS (SELECT p_partkey, (p_size & 63) + (p_partkey & 2047) * 64 AS v FROM part)
SELECT p_partkey, printf('%02x%02x%02x5a', (v & 255)::INT, (v >> 8 & 255)::INT, (v >> 16)::INT) AS written, printf('%d %d %d 1 5a True', (v & 63)::INT, (v & 63)::INT, (v >> 6)::INT) AS told FROM v""",
    "palettes": f"""WITH {base._LINES}, d AS (SELECT image, y, px[1:(y % 65)::INT] AS b, y % 65 AS n FROM q)
SELECT image, y, CASE WHEN n > 0 AND n % 3 = 0 THEN n // 3 END::BIGINT AS n, CASE WHEN n > 0 AND n % 3 = 0 THEN list_sum(list_transform(range(n), lambda k: b[k + 1] * (k % 3 + 1))) END::BIGINT AS total,
CASE WHEN n > 0 AND n % 3 = 0 THEN array_to_string(list_transform(b, lambda v: printf('%02x', v::INT)), '') END AS back, CASE WHEN n = 0 OR n % 3 <> 0 THEN 'InvalidLength' END AS error FROM d""",
    "damaged_images": f"SELECT image, damage, damage <> 'signature' AS signed, error FROM (SELECT DISTINCT {base._IMAGE} AS image FROM embeddings), (VALUES {_NAMES}) v(damage, error)",
    "indexed_images": f"""WITH {base._LINES} SELECT image, y, d::BIGINT AS depth, CASE d WHEN 1 THEN {_packed(1)} WHEN 2 THEN {_packed(2)} ELSE {_packed(4)} END AS data,
list_sum(list_transform(range(64), lambda k: (px[k + 1] & ((1 << d) - 1)) * (k + 1)))::BIGINT AS weighted, 4::BIGINT AS n_chunks, 1::BIGINT AS n_palettes, 1::BIGINT AS lace FROM q, (VALUES (1), (2), (4)) v(d)""",
}
