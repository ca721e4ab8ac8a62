"""Whole images: every colour, depth, interlace, strategy and level; broken files; the source; rows and pixels; streams."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.functions.geometry import row_bytes
from tilequarry.operators import chunks, codec, scanlines
from tilequarry.schema import DEPTHS, PALETTE, SAMPLES, SIGNATURE, ImageError
from tilequarry.sources import images as source
from tilequarry.streaming import images as streaming

GRAY = dict(width=2, height=2, bit_depth=8, color_type=0, compression=0, filter=0, interlace=0)


def random_image(r, color, depth, lace, w, h):
    header = GRAY | dict(width=w, height=h, bit_depth=depth, color_type=color, interlace=lace)
    n = row_bytes(w, color, depth)
    px = np.frombuffer(r.randbytes(n * h), np.uint8).reshape(h, n).copy()
    spare = n * 8 - w * SAMPLES[color] * depth
    if spare:
        px[:, -1] &= (0xFF << spare) & 0xFF
    return header, px.tobytes(), [dict(r=k, g=1, b=2) for k in range(4)] if color == 3 else None


@pytest.mark.parametrize("lace", [0, 1])
@pytest.mark.parametrize(("color", "depth"), [(c, d) for c, ds in DEPTHS.items() for d in ds])
def test_lossless(color, depth, lace):
    r = random.Random(color * 100 + depth)
    for w, h in ((1, 1), (5, 3), (8, 8), (13, 17)):
        header, px, colours = random_image(r, color, depth, lace, w, h)
        for strategy in ("none", "sub", "up", "average", "paeth", "adaptive"):
            for level in ("store", "best"):
                got = codec.decode(codec.encode(header, px, colours, level, strategy))
                assert got == {"header": header, "pixels": px, "palette": colours}


def ihdr(**changes):
    return chunks.write_chunk("IHDR", struct.pack(">IIBBBBB", *[(GRAY | changes)[k] for k in codec.FIELDS]))


def idat(raw=b"\0\1\2\0\3\4"):
    return chunks.write_chunk("IDAT", zlib.compress(raw))


END = chunks.write_chunk("IEND", b"")
BAD_CRC = chunks.write_chunk("IDAT", b"x")[:-1] + b"\0"
BROKEN = {
    "empty": (b"", "InvalidSignature"),
    "short": (SIGNATURE[:7], "InvalidSignature"),
    "junk": (b"\xff" * 40, "InvalidSignature"),
    "signature only": (SIGNATURE, "MissingIhdr"),
    "four more": (SIGNATURE + b"\0\0\0\x0d", "UnexpectedEndOfData"),
    "partial header": (SIGNATURE + ihdr()[:-3], "UnexpectedEndOfData"),
    "no data": (SIGNATURE + ihdr(), "MissingIdat"),
    "header crc": (SIGNATURE + ihdr()[:-1] + b"\0" + idat() + END, "InvalidChunk"),
    "data first": (SIGNATURE + idat() + ihdr() + END, "MissingIhdr"),
    "type not letters": (SIGNATURE + ihdr() + b"\0\0\0\0ID1T" + b"\0" * 4, "InvalidChunkType"),
    "long length": (SIGNATURE + ihdr() + b"\xff\xff\xff\xffIDAT" + b"\0" * 8, "InvalidLength"),
    "length past end": (SIGNATURE + ihdr() + b"\x00\xff\xff\xffIDAT" + b"\0" * 8, "UnexpectedEndOfData"),
    "width 0": (SIGNATURE + ihdr(width=0) + idat() + END, "InvalidIhdr"),
    "width 2^30": (SIGNATURE + ihdr(width=1 << 30) + idat() + END, "InvalidIhdr"),
    "depth 3": (SIGNATURE + ihdr(bit_depth=3) + idat() + END, "InvalidIhdr"),
    "rgb depth 4": (SIGNATURE + ihdr(color_type=2, bit_depth=4) + idat() + END, "InvalidIhdr"),
    "method 1": (SIGNATURE + ihdr(compression=1) + idat() + END, "InvalidIhdr"),
    "interlace 2": (SIGNATURE + ihdr(interlace=2) + idat() + END, "InvalidIhdr"),
    "bad data crc": (SIGNATURE + ihdr() + BAD_CRC + END, "InvalidChunk"),
    "not zlib": (SIGNATURE + ihdr() + chunks.write_chunk("IDAT", b"\0\0\0\0") + END, "DecompressionFailed"),
    "adler": (SIGNATURE + ihdr() + chunks.write_chunk("IDAT", zlib.compress(b"\0\1\2\0\3\4")[:-1] + b"\0") + END, "DecompressionFailed"),
    "too few rows": (SIGNATURE + ihdr() + idat(b"\0\1\2") + END, "DecompressionFailed"),
    "too many rows": (SIGNATURE + ihdr() + idat(b"\0\1\2" * 3) + END, "DecompressionFailed"),
    "filter 5": (SIGNATURE + ihdr() + idat(b"\5\1\2\0\3\4") + END, "InvalidFilterType"),
    "empty data": (SIGNATURE + ihdr() + chunks.write_chunk("IDAT", b"") + END, "MissingIdat"),
    "no end": (SIGNATURE + ihdr() + idat(), "PrematureEnd"),
    "end before data": (SIGNATURE + ihdr() + END + idat(), "MissingIdat"),
}
ACCEPTED = {
    "plain": SIGNATURE + ihdr() + idat() + END,
    "split data": SIGNATURE + ihdr() + b"".join(chunks.write_chunk("IDAT", bytes([x])) for x in zlib.compress(b"\0\1\2\0\3\4")) + END,
    "bytes after the end": SIGNATURE + ihdr() + idat() + END + b"more",
    "bytes after the stream": SIGNATURE + ihdr() + chunks.write_chunk("IDAT", zlib.compress(b"\0\1\2\0\3\4") + b"zz") + END,
    "second header": SIGNATURE + ihdr() + ihdr(width=9) + idat() + END,
    "late palette": SIGNATURE + ihdr() + idat() + chunks.write_chunk("PLTE", b"abc") + END,
    "unknown critical": SIGNATURE + ihdr() + chunks.write_chunk("ABCD", b"x") + idat() + END,
    "bad palette": SIGNATURE + ihdr() + chunks.write_chunk("PLTE", b"ab") + idat() + END,
}


def test_broken_files_are_labelled(spark):
    files = spark.createDataFrame([(k, v) for k, (v, _) in BROKEN.items()] + [("null", None)], "name string, content binary")
    got = {r["name"]: r for r in codec.decode_images(files, ["name"]).collect()}
    assert {k: got[k]["error"] for k in BROKEN} == {k: e for k, (_, e) in BROKEN.items()}
    assert got["width 0"]["detail"] == "InvalidWidth" and got["null"]["error"] is None and got["null"]["pixels"] is None


def test_odd_files_are_accepted(spark):
    files = spark.createDataFrame(list(ACCEPTED.items()), "name string, content binary")
    got = {r["name"]: r for r in codec.decode_images(files, ["name"]).collect()}
    assert all(bytes(got[k]["pixels"]) == b"\1\2\3\4" for k in ACCEPTED)
    assert got["bad palette"]["palette"] is None and len(got["late palette"]["palette"]) == 1
    report = {r["name"]: r for r in chunks.order_report(chunks.chunks(files, ["name"]).where("error IS NULL"), ["name"]).collect()}
    assert report["second header"]["extra_ihdr"] == 1 and report["unknown critical"]["unknown_critical"] == 1 and report["late palette"]["late_plte"]


def test_large_stored_image():
    r = random.Random(2)
    header = GRAY | dict(width=400, height=400)
    px = r.randbytes(160_000)
    content = codec.encode(header, px, None, "store", "none")
    assert codec.decode(content)["pixels"] == px
    assert [len(d) for k, d, _ in chunks.iterate(content) if k == "IDAT"][:-1] == [32768] * 4


@pytest.mark.parametrize(("header", "px", "colours"), [(GRAY, b"abc", None), (GRAY | {"color_type": 3}, b"abcd", None), (GRAY | {"color_type": 3}, b"abcd", [dict(r=1, g=1, b=1)] * 257), (GRAY | {"bit_depth": 5}, b"abcd", None)])
def test_encode_refuses(header, px, colours):
    with pytest.raises(ImageError, match="InvalidImage"):
        codec.encode(header, px, colours)


def test_chunk_table(spark):
    files = spark.createDataFrame([(1, ACCEPTED["plain"]), (2, BROKEN["type not letters"][0]), (3, b"no"), (4, None)], "id int, content binary")
    rows = chunks.chunks(files, ["id"]).orderBy("id", "idx").collect()
    assert [(r["id"], r["type"], r["error"]) for r in rows] == [(1, "IHDR", None), (1, "IDAT", None), (1, "IEND", None), (2, "IHDR", None), (2, None, "InvalidChunkType"), (3, None, "InvalidSignature")]
    joined = codec.join_idat(chunks.chunks(files, ["id"]).where("error IS NULL"), ["id"]).collect()
    assert zlib.decompress(bytes(joined[0]["stream"])) == b"\0\1\2\0\3\4"
    assert chunks.chunks(files, ["id"], with_data=False).columns == ["id", "idx", "type", "offset", "length", "crc", "crc_ok", "error"]


def test_source_round_trip(spark, tmp_path):
    source.register(spark)
    made = source.synthetic(spark)
    path = str(tmp_path / "images")
    made.select(F.concat("name", F.lit(".png")).alias("name"), "header", "pixels", "palette").write.format("png").mode("append").option("compression", "best").save(path)
    want = {r["name"]: bytes(r["pixels"]) for r in made.collect()}
    assert len(os.listdir(path)) == len(want) == len(source.SYNTHETIC) and not [f for f in os.listdir(path) if f.endswith("tmp")]
    name = lambda p: os.path.basename(p)[:-4]
    assert {name(r["path"]): bytes(r["pixels"]) for r in spark.read.format("png").load(path).collect()} == want
    headers = spark.read.format("png").option("view", "headers").load(path)
    assert {name(r["path"]): (r["header"]["width"], r["header"]["height"]) for r in headers.collect()} == {x[0]: x[1:3] for x in source.SYNTHETIC}
    rows = spark.read.format("png").option("view", "rows").load(path)
    assert rows.count() == sum(x[2] for x in source.SYNTHETIC)
    assert spark.read.format("png").option("view", "chunks").load(path).where("type = 'IEND' AND crc_ok").count() == len(want)
    files = source.read_files(spark, path)
    again = codec.decode_images(codec.transcode(files.select("path", "content"), ["path"], "fastest", "up").select("path", "content"), ["path"])
    assert {name(r["path"]): bytes(r["pixels"]) for r in again.collect()} == want
    assert codec.info(again, ["path"]).where("error IS NULL").count() == len(want)
    broken = tmp_path / "broken.png"
    broken.write_bytes(b"nothing")
    for view in ("images", "headers", "chunks", "rows"):
        assert [r["error"] for r in spark.read.format("png").option("view", view).load(str(broken)).collect()] == ["InvalidSignature"]
    source.write_binary(files.select("path", "content"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == len(want)


@pytest.mark.parametrize(("color", "depth"), [(0, 1), (0, 4), (0, 8), (0, 16), (2, 8), (3, 2), (4, 16), (6, 8)])
def test_pixels_by_place(spark, color, depth):
    header, px, colours = random_image(random.Random(9), color, depth, 0, 7, 3)
    df = spark.createDataFrame([(header, px)], f"header {codec.HEADER_TYPE}, pixels binary").select("*", F.explode(F.sequence(F.lit(-1), F.lit(7))).alias("x"))
    got = {r["x"]: r["v"] for r in df.select("x", codec.pixel("header", "pixels", F.col("x"), F.lit(2)).alias("v")).collect()}
    line = px[2 * row_bytes(7, color, depth) :]
    wide = int.from_bytes(line, "big")
    total = 8 * len(line)
    n = SAMPLES[color]
    want = {x: [wide >> (total - (x * n + k + 1) * depth) & ((1 << depth) - 1) for k in range(n)] for x in range(7)}
    assert got == want | {-1: None, 7: None}


def test_unfilter_table_labels_bad_filters(spark):
    rows = spark.createDataFrame([(1, 0, 0, [1, 2]), (1, 1, 2, [1, 1]), (2, 0, 7, [1, 2])], "image int, y int, filter int, data array<int>")
    got = {(r["image"], r["y"]): r for r in scanlines.unfilter(rows, ["image"], "y").collect()}
    assert got[1, 1]["px"] == [2, 3] and got[2, 0]["error"] == "InvalidFilterType"
    assert scanlines.unfilter(rows.limit(0), ["image"], "y").count() == 0


def test_interlaced_passes_match_the_kernel(spark):
    header, px, _ = random_image(random.Random(4), 0, 8, 1, 9, 11)
    cells = spark.createDataFrame([(1, x, y, px[y * 9 + x]) for y in range(11) for x in range(9)], "image int, x long, y long, v int")
    got = {(r["pass"], r["py"]): bytes(r["values"]) for r in scanlines.pass_rows(cells, ["image"]).collect()}
    parts = codec.interlace(np.frombuffer(px, np.uint8).reshape(11, 9), header)
    from tilequarry.functions.geometry import passes

    assert got == {(k, y): row.tobytes() for (k, *_), part in zip(passes(9, 11), parts) for y, row in enumerate(part)}
    assert codec.deinterlace(parts, header).tobytes() == px
    back = scanlines.full_rows(scanlines.pixel_passes(cells).select("image", "pass", "px", "py", "v"), ["image"]).orderBy("y").collect()
    assert b"".join(bytes(r["values"]) for r in back) == px


def test_row_decoder_takes_any_pieces():
    header, px, _ = random_image(random.Random(6), 2, 8, 0, 12, 9)
    content = codec.encode(header, px)
    for step in (1, 7, 10, 10_000):
        d = streaming.RowDecoder()
        rows = [x for i in range(0, len(content), step) for x in d.feed(content[i : i + step])]
        assert b"".join(r for _, r in rows) == px and [y for y, _ in rows] == list(range(9)) and d.is_finished
    with pytest.raises(ImageError, match="InterlacedNotSupported"):
        streaming.RowDecoder().feed(codec.encode(header | {"interlace": 1}, px))
    with pytest.raises(ImageError, match="InvalidChunk"):
        streaming.RowDecoder().feed(content.replace(b"IDAT", b"IDAT", 1)[:45] + b"\x55" + content[46:])


def test_row_encoder():
    header = GRAY | dict(width=64, height=64, color_type=2)
    rows = [bytes(v % 256 for x in range(64) for v in (4 * x, 4 * y, 2 * (x + y))) for y in range(64)]
    e = streaming.RowEncoder(header)
    for r in rows:
        e.write_row(r)
    content = e.finish()
    assert codec.decode(content)["pixels"] == b"".join(rows)
    for call in (e.finish, lambda: e.write_row(rows[0])):
        with pytest.raises(ImageError, match="AlreadyFinished"):
            call()
    e = streaming.RowEncoder(header)
    with pytest.raises(ImageError, match="RowCountMismatch"):
        e.finish()
    with pytest.raises(ImageError, match="InvalidImage"):
        e.write_row(b"x")
    for bad in ({"interlace": 1}, {"color_type": 3}):
        with pytest.raises(ImageError):
            streaming.RowEncoder(header | bad)


def _run(df, tmp_path, name):
    q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_streams(spark, tmp_path):
    header, px, colours = random_image(random.Random(8), 3, 8, 0, 20, 15)
    content = codec.encode(header, px, colours)
    pieces = [(n, k, content[i : i + 10]) for n in ("a", "b") for k, i in enumerate(range(0, len(content), 10))]
    pieces += [("bad", 0, b"not an image")]
    random.Random(1).shuffle(pieces)
    half = len(pieces) // 2
    for k, part in enumerate((pieces[:half], pieces[half:])):
        spark.createDataFrame(part, "image string, seq long, fragment binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("image string, seq long, fragment binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _run(streaming.decode_stream(stream, whole=True), tmp_path, "decoded")
    for name in ("a", "b"):
        rows = sorted((r["y"], bytes(r["data"])) for r in got if r["image"] == name and not r["finished"])
        assert b"".join(d for _, d in rows) == px and len(rows) == 15
    ends = {r["image"]: r for r in got if r["finished"]}
    assert {k: r["error"] for k, r in ends.items()} == {"a": None, "b": None, "bad": "InvalidSignature"}
    for name in ("a", "b"):
        assert bytes(ends[name]["data"]) == px and ends[name]["header"].asDict() == header and [c.asDict() for c in ends[name]["palette"]] == colours
    assert ends["bad"]["header"] is None and len(got) == 33
    row = lambda name, y, color, palette: (name, y, px[20 * y : 20 * y + 20], 20, 15, 8, color, palette)
    rows = [row("grey", y, 0, None) for y in range(15)] + [row("indexed", y, 3, colours if y == 7 else None) for y in range(15)]
    rows += [row("colourless", y, 3, None) for y in range(15)] + [("short", 0, b"x", 20, 15, 8, 0, None)]
    random.Random(2).shuffle(rows)
    schema = f"image string, y long, data binary, width long, height long, bit_depth int, color_type int, palette {PALETTE}"
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "rows"))
    made = {r["image"]: r for r in _run(streaming.encode_stream(stream), tmp_path, "encoded")}
    assert {k: r["error"] for k, r in made.items()} == {"grey": None, "indexed": None, "colourless": "InvalidImage", "short": "InvalidImage"}
    assert codec.decode(bytes(made["grey"]["content"]))["pixels"] == px
    assert codec.decode(bytes(made["indexed"]["content"])) == {"header": header, "pixels": px, "palette": colours}


def test_large_files_are_labelled(spark, tmp_path, monkeypatch):
    for name, n in (("small", 10), ("large", 200)):
        (tmp_path / f"{name}.png").write_bytes(bytes(n))
    monkeypatch.setattr(source, "MAX_FILE", 100)
    got = {r["length"]: r for r in source.read_files(spark, str(tmp_path)).collect()}
    assert got[10]["error"] is None and bytes(got[10]["content"]) == bytes(10)
    assert got[200]["error"] == "FileTooLarge" and got[200]["content"] is None
