"""Checksums, geometry, bits, filters and DEFLATE pieces against known values and Python's zlib."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilequarry.functions import bits, checksums, deflate, geometry, predict
from tilequarry.operators import chunks
from tilequarry.schema import DEPTHS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("data", "crc"), [(b"", 0), (b"123456789", 0xCBF43926), (b"a", 0xE8B7BE43), (b"abc", 0x352441C2)])
def test_crc32(spark, data, crc):
    assert value(spark, checksums.crc32(F.lit(data))) == crc
    assert checksums.Running().update(data[:1]).update(data[1:]).crc == crc


@pytest.mark.parametrize("data", [b"", b"a", b"Wikipedia", bytes(range(256)) * 3])
def test_adler32(spark, data):
    assert value(spark, checksums.adler32(F.lit(data))) == zlib.adler32(data)
    assert checksums.Running().update(data[:4]).update(data[4:]).adler == zlib.adler32(data)


def test_bytes_there_and_back(spark):
    assert bytes(value(spark, checksums.to_binary(checksums.byte_array(F.lit(bytes(range(256))))))) == bytes(range(256))


def test_chunk_expressions(spark):
    assert bytes(value(spark, chunks.chunk_bytes(F.lit("IEND"), F.lit(b"")))).hex() == "0000000049454e44ae426082"
    assert chunks.write_chunk("IEND", b"").hex() == "0000000049454e44ae426082"
    assert value(spark, chunks.palette(F.lit(bytes([1, 2, 3, 250, 5, 6]))))[1] == (250, 5, 6)
    assert value(spark, chunks.palette(F.lit(b"ab"))) is None
    assert value(spark, chunks.palette_error(F.lit(b"abc" * 257))) == "InvalidPaletteSize"
    assert bytes(value(spark, chunks.palette_bytes(chunks.palette(F.lit(b"abcdef"))))) == b"abcdef"
    told = {r["type"]: r for r in chunks.catalog(spark).collect()}
    assert told["IDAT"]["critical"] and told["tEXt"]["safe_to_copy"] and not told["tRNS"]["critical"] and not told["gAMA"]["safe_to_copy"]


def test_geometry(spark):
    row = spark.sql("SELECT 100L AS w, 50L AS h, 6 AS c, 8 AS d")
    got = row.select(geometry.bytes_per_row(F.col("w"), F.col("c"), F.col("d")), geometry.bytes_per_row_with_filter(F.col("w"), F.col("c"), F.col("d")), geometry.raw_size(F.col("w"), F.col("h"), F.col("c"), F.col("d")), geometry.bytes_per_pixel(F.col("c"), F.col("d"))).first()
    assert tuple(got) == (400, 401, 20050, 4)
    grid = spark.range(7).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(17))).alias("d"))
    assert all(r["ok"] == (r["d"] in DEPTHS.get(r["c"], ())) for r in grid.select("c", "d", geometry.valid_combo(F.col("c"), F.col("d")).alias("ok")).collect())


def test_header_rules_in_order(spark):
    good = dict(w=1, h=1, d=8, c=0, m=0, f=0, i=0)
    cases = [({}, None), ({"w": 0}, "InvalidWidth"), ({"w": 0x40000000}, "InvalidWidth"), ({"h": 0}, "InvalidHeight"), ({"w": 10**9, "h": 10**9}, "InvalidHeight"), ({"d": 3}, "InvalidBitDepth"), ({"c": 1}, "InvalidColorType"), ({"c": 2, "d": 4}, "InvalidColorBitDepthCombo"), ({"m": 1}, "InvalidCompressionMethod"), ({"f": 1}, "InvalidFilterMethod"), ({"i": 2}, "InvalidInterlaceMethod"), ({"w": 0, "c": 9}, "InvalidWidth")]
    df = spark.createDataFrame([tuple((good | x).values()) for x, _ in cases], "w long, h long, d int, c int, m int, f int, i int")
    assert [r[0] for r in df.select(geometry.header_error(*[F.col(x) for x in "whdcmfi"])).collect()] == [e for _, e in cases]


def test_adam7_total(spark):
    from tilequarry.operators.scanlines import interlaced_bytes

    df = spark.createDataFrame([(1, 8, 8, 0, 8)], "id int, width long, height long, color_type int, bit_depth int")
    assert interlaced_bytes(df, ["id"]).first()["raw_bytes"] == 79


def test_paeth_and_score(spark):
    for a, b, c in [(0, 0, 0), (10, 20, 15), (255, 0, 128), (1, 2, 3), (100, 50, 100), (7, 7, 7)]:
        p = a + b - c
        want = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        assert value(spark, predict.paeth(F.lit(a), F.lit(b), F.lit(c))) == want
    assert value(spark, predict.score(F.array(*map(F.lit, [1, 255, 128, 127])))) == 1 + 1 + 128 + 127
    assert value(spark, predict.best([F.lit(x).cast("long") for x in (9, 4, 4, 7, 4)])) == 1


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.sampled_from([1, 2, 3, 4, 6, 8]), st.sampled_from(["none", "sub", "up", "average", "paeth", "adaptive"]), st.randoms())
def test_filters_undo(h, w, bpp, strategy, r):
    raw = np.array([[r.randrange(256) for _ in range(w * bpp)] for _ in range(h)], np.uint8)
    assert (predict.unfilter_rows(predict.filter_rows(raw, bpp, strategy), bpp) == raw).all()


def test_unknown_filter_byte():
    with pytest.raises(ValueError, match="InvalidFilterType"):
        predict.unfilter_rows(np.array([[5, 1]], np.uint8), 1)


def test_bit_reader_keeps_whole_bytes():
    w = bits.BitWriter()
    w.write(5, 3)
    w.write_bytes(b"xy")
    w.write(1)
    w.flush()
    r = bits.BitReader(w.written)
    assert (r.read(3), r.peek(15) & 31, r.read_bytes(2), r.read(), r.remaining_bytes) == (5, 0, b"xy", 1, 0)
    with pytest.raises(EOFError):
        r.read(16)
    with pytest.raises(OverflowError):
        bits.BitWriter(1).write_bytes(b"ab")


def test_bits(spark):
    assert value(spark, bits.bit_reverse(F.lit(0b1011), 4)) == 0b1101
    assert value(spark, bits.unpack_row(F.array(F.lit(0xE4), F.lit(0x1B)), 2, F.lit(7))) == [3, 2, 1, 0, 0, 1, 2]
    assert value(spark, bits.pack_row(F.array(*map(F.lit, [3, 2, 1, 0, 0, 1, 2])), 2)) == [0xE4, 0x18]
    for depth in (1, 2, 4):
        rows = np.random.default_rng(1).integers(0, 1 << depth, (3, 13)).astype(np.uint8)
        assert (bits.unpack_rows(bits.pack_rows(rows, depth), depth, 13) == rows).all()


def test_code_tables(spark):
    assert [deflate.length_code(n) for n in (3, 10, 11, 257, 258)] == [(257, 0, 0), (264, 0, 0), (265, 1, 0), (284, 5, 30), (285, 0, 0)]
    assert [deflate.distance_code(d) for d in (1, 4, 5, 32768)] == [(0, 0, 0), (3, 0, 0), (4, 1, 0), (29, 13, 8191)]
    df = spark.range(3, 259).select(F.col("id"), deflate.length_code_of(F.col("id")).alias("c"))
    assert all(tuple(r["c"]) == deflate.length_code(r["id"]) for r in df.collect())
    assert value(spark, deflate.length_code_of(F.lit(2))) is None


def test_zlib_headers():
    assert [deflate.zlib_header(k).hex() for k in deflate.CHAIN] == ["7801", "7801", "785e", "789c", "78da"]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(list(deflate.CHAIN)))
def test_deflate(data, level):
    assert deflate.expand(deflate.tokens(data, level)) == data
    raw = deflate.deflate_fixed(data, level)
    assert zlib.decompress(raw, -15) == data
    reader = deflate.BlockReader(raw)
    list(reader.blocks())
    assert bytes(reader.out) == data
    assert zlib.decompress(deflate.compress(data, level)) == data == deflate.decompress(deflate.compress(data, level), len(data))


def test_stored_blocks_over_64k():
    data = random.Random(3).randbytes(150_000)
    assert zlib.decompress(deflate.deflate_fixed(data, "store"), -15) == data


@pytest.mark.parametrize("level", [1, 6, 9])
def test_block_reader_reads_dynamic_and_flushed_blocks(level):
    data = b"the quick brown fox " * 50
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    stream = c.compress(data) + c.flush(zlib.Z_FULL_FLUSH) + c.compress(data) + c.flush()
    reader = deflate.BlockReader(stream)
    kinds = [b["kind"] for b in reader.blocks()]
    assert bytes(reader.out) == data * 2 and "stored" in kinds and kinds[0] in ("dynamic", "fixed")


@pytest.mark.parametrize(("stream", "label"), [(b"\x07", "InvalidBlockType"), (b"\x01\x01\x00\x00\x00", "InvalidStoredLength")])
def test_broken_blocks(stream, label):
    with pytest.raises(ValueError, match=label):
        list(deflate.BlockReader(stream).blocks())


def test_canonical_and_best_lengths():
    assert deflate.canonical([2, 1, 3, 3]) == {1: (0, 1), 0: (2, 2), 2: (6, 3), 3: (7, 3)}
    with pytest.raises(ValueError, match="InvalidCodeLengths"):
        deflate.canonical([1, 1, 1])
    r = random.Random(5)
    for n in (2, 3, 10, 200):
        counts = [r.randint(0, 50) ** 3 for _ in range(n)] + [1, 1]
        for limit in (9, 15):
            lengths = deflate.best_lengths(counts, limit)
            assert max(lengths) <= limit and all((c > 0) == (x > 0) for c, x in zip(counts, lengths))
            assert sum(2.0**-x for x in lengths if x) == 1
    assert deflate.best_lengths([0, 7, 0]) == [0, 1, 0]
