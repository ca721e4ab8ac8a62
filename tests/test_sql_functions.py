"""The functions by name in SQL, against the expressions and kernels that they stand for."""

import zlib

import pytest

from tilequarry.functions import deflate, geometry, sql
from tilequarry.operators import codec
from tilequarry.schema import DEPTHS


@pytest.fixture(scope="module")
def s(spark):
    sql.register(spark)
    return spark


@pytest.mark.parametrize(
    ("call", "value"),
    [
        ("paeth(10, 20, 15)", 15), ("paeth(1, 2, 3)", 1), ("bit_reverse(11, 4)", 13), ("png_bits_per_pixel(6, 16)", 64), ("png_bytes_per_pixel(0, 1)", 1), ("png_bytes_per_row(100, 6, 8)", 400), ("png_raw_size(100, 50, 6, 8)", 20050),
        ("png_valid_combo(2, 4)", False), ("adam7_pass(3, 5)", 6), ("adam7_width(8, 1)", 1), ("adam7_height(8, 2)", 1), ("adam7_width(3, 1)", 0), ("deflate_length_code(258)", 285), ("deflate_length_code(2)", None), ("deflate_distance_code(32768)", 29),
        ("zlib_header('default')", "789C"), ("sum_abs(array(1, 255, 128, 127))", 257), ("adler32(X'57696B697065646961')", 0x11E60398), ("crc32('123456789')", 0xCBF43926), ("png_parse_header(X'00')", None), ("png_is_critical('tEXt')", False), ("png_max_encoded_size(1, 1, 0, 8)", 922),
    ],
)
def test_scalar(s, call, value):
    assert s.sql(f"SELECT {call} AS v").first()["v"] == value


def test_all_codes(s):
    got = s.sql("SELECT id, deflate_length_code(CAST(id AS INT)) AS v FROM range(3, 259)").collect()
    assert all(r["v"] == deflate.length_code(r["id"])[0] for r in got)


def test_images(s):
    header = dict(width=3, height=2, bit_depth=4, color_type=0, compression=0, filter=0, interlace=0)
    content = codec.encode(header, b"\x12\x30\x45\x60")
    s.createDataFrame([(1, content), (2, b"x"), (3, None)], "id int, content binary").createOrReplaceTempView("files")
    rows = s.sql("SELECT id, c.* FROM files, LATERAL png_chunks(content) c ORDER BY id, idx").collect()
    assert [(r["id"], r["type"], r["crc_ok"], r["error"]) for r in rows] == [(1, "IHDR", True, None), (1, "IDAT", True, None), (1, "IEND", True, None), (2, None, None, "InvalidSignature")]
    assert s.sql("SELECT png_parse_header(data).width AS w FROM files, LATERAL png_chunks(content) WHERE type = 'IHDR'").first()["w"] == 3
    rows = s.sql("SELECT id, r.* FROM files, LATERAL png_rows(content) r ORDER BY id, y").collect()
    assert [tuple(r) for r in rows] == [(1, 0, b"\x12\x30", None), (1, 1, b"\x45\x60", None), (2, None, None, "InvalidSignature")]
    pixels = s.sql("SELECT id, p.* FROM files, LATERAL png_pixels(content) p ORDER BY id, y, x").collect()
    assert [tuple(r) for r in pixels] == [(1, (k - 1) % 3, (k - 1) // 3, [k], None) for k in range(1, 7)] + [(2, None, None, None, "InvalidSignature")]
    got = {r["id"]: r["d"] for r in s.sql("SELECT id, png_decode(content) AS d FROM files").collect()}
    assert bytes(got[1]["pixels"]) == b"\x12\x30\x45\x60" and got[1]["header"]["bit_depth"] == 4 and got[2]["error"] == "InvalidSignature"


def test_tokens(s):
    rows = s.sql("SELECT * FROM lz77_tokens(encode('abcabcabcabc', 'utf-8'), 'best') ORDER BY idx").collect()
    assert [(r["kind"], r["literal"], r["length"], r["distance"]) for r in rows] == [("literal", 97, None, None), ("literal", 98, None, None), ("literal", 99, None, None), ("match", None, 9, 3)]


def test_passes_cover_images():
    for w, h in ((1, 1), (5, 3), (8, 8), (9, 17)):
        assert sum(p[1] * p[2] for p in geometry.passes(w, h)) == w * h
    assert zlib.crc32(b"") == 0 and len(DEPTHS) == 5


def test_no_file_is_larger_than_its_bound(s):
    """The bound holds for bytes that do not compress, small and large, with and without interlacing, at every level."""
    import random

    from tilequarry.operators import codec

    r = random.Random(1)
    for w, h, color, depth in ((1, 1, 0, 8), (1, 300, 0, 1), (7, 9, 2, 16), (200, 3, 6, 8), (3, 700, 3, 4), (150, 150, 6, 16)):
        bound = s.sql(f"SELECT png_max_encoded_size({w}, {h}, {color}, {depth})").first()[0]
        row = s.sql(f"SELECT png_bytes_per_row({w}, {color}, {depth})").first()[0]
        colours = [{"r": 1, "g": 2, "b": 3}] * 256 if color == 3 else None
        for lace in (0, 1):
            header = dict(zip(codec.FIELDS, (w, h, depth, color, 0, 0, lace)))
            pixels = bytes(r.randint(144, 255) for _ in range(row * h))
            assert max(len(codec.encode(header, pixels, colours, level)) for level in ("store", "fastest", "best")) <= bound
