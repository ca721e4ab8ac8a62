"""Images from and to streams, with one state for each image.

Micro-batches keep no order, so fragments carry ``seq`` and rows carry ``y``; what comes early waits in the state.
Decoding inflates as bytes arrive and emits rows as soon as they are whole, checks every CRC, and ends with one row that
tells how the image ended, with its header and palette. An image whose end never comes is dropped when its time to live
is over; of one that has ended a mark stays, so that late pieces of it give nothing.

What grows with an image (compressed bytes, filtered rows) lies in list states that are only added to; each micro-batch
writes its own part again and no more. An inflater cannot be stored: it is kept in the worker's process, and where another
process goes on with the image, the bytes so far are read and inflated once more.
"""

from __future__ import annotations

import pickle
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.deflate import compress
from ..functions.geometry import pixel_bytes, row_bytes
from ..functions.predict import filter_rows, unfilter_rows
from ..operators.codec import FIELDS, body, preamble, read_header
from ..schema import HEADER, MAX_IDAT_TOTAL, PALETTE, SIGNATURE, ImageError

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DECODED = f"image string, y long, data binary, finished boolean, error string, header {HEADER}, palette {PALETTE}"
ENCODED = "image string, content binary, error string"
_BLOB = StructType([StructField("blob", BinaryType())])


class RowDecoder:
    """Feed bytes in any pieces; ``feed`` returns the rows that became whole. Adam7 images are refused."""

    def __init__(self):
        self.held, self.filtered, self.stage = bytearray(), bytearray(), "signature"
        self.header: dict | None = None
        self.palette: bytes | None = None
        self.above, self.y, self.idat = b"", 0, 0
        self.inflater, self.fresh = zlib.decompressobj(), []  # the compressed pieces that are in no state yet

    @property
    def is_finished(self) -> bool:
        return self.stage == "finished"

    @property
    def colours(self) -> list[dict] | None:
        return self.palette and [dict(zip("rgb", self.palette[i : i + 3])) for i in range(0, len(self.palette), 3)]

    def feed(self, data: bytes) -> list[tuple[int, bytes]]:
        self.held += data
        rows: list[tuple[int, bytes]] = []
        while self.stage != "finished":
            if self.stage == "signature":
                if len(self.held) < 8:
                    break
                if self.held[:8] != SIGNATURE:
                    raise ImageError("InvalidSignature")
                del self.held[:8]
                self.stage = "header"
                continue
            if len(self.held) < 8:
                break
            n, kind = struct.unpack_from(">I4s", self.held)
            if n > 0x7FFFFFFF:
                raise ImageError("InvalidLength")
            if not (kind.isascii() and kind.isalpha()):
                raise ImageError("InvalidChunkType")
            if len(self.held) < 12 + n:
                break
            chunk, crc = bytes(self.held[8 : 8 + n]), struct.unpack_from(">I", self.held, 8 + n)[0]
            del self.held[: 12 + n]
            if self.stage == "header" and kind != b"IHDR":
                raise ImageError("MissingIhdr")
            if zlib.crc32(kind + chunk) != crc:
                raise ImageError("InvalidChunk")
            if self.stage == "header":
                self.header = read_header(chunk)
                if self.header["interlace"]:
                    raise ImageError("InterlacedNotSupported")
                self.stage = "chunks"
            elif kind == b"IDAT":
                self.idat += n
                if self.idat > MAX_IDAT_TOTAL:
                    raise ImageError("IdatTooLarge")
                rows += self._inflate(chunk)
            elif kind == b"PLTE" and chunk and n % 3 == 0 and n <= 768:
                self.palette = chunk
            elif kind == b"IEND":
                if not self.idat:
                    raise ImageError("MissingIdat")
                if self.y < self.header["height"]:
                    raise ImageError("DecompressionFailed", "UnexpectedEndOfStream")
                self.stage = "finished"
        return rows

    def _inflate(self, data: bytes) -> list[tuple[int, bytes]]:
        h = self.header
        w, bpp = row_bytes(h["width"], h["color_type"], h["bit_depth"]), pixel_bytes(h["color_type"], h["bit_depth"])
        self.fresh.append(data)
        try:
            self.filtered += self.inflater.decompress(data)
        except zlib.error as e:
            raise ImageError("DecompressionFailed", str(e)) from None
        n = min(len(self.filtered) // (w + 1), h["height"] - self.y)
        if self.y + len(self.filtered) / (w + 1) > h["height"]:
            raise ImageError("DecompressionFailed", "OutputBufferFull")
        if not n:
            return []
        block = np.frombuffer(bytes(self.filtered[: n * (w + 1)]), np.uint8).reshape(n, w + 1)
        del self.filtered[: n * (w + 1)]
        if self.y:
            block = np.concatenate((np.concatenate(([0], np.frombuffer(self.above, np.uint8)))[None].astype(np.uint8), block))
        try:
            raw = unfilter_rows(block, bpp)[1 if self.y else 0 :]
        except ValueError as e:
            raise ImageError(str(e)) from None
        first, self.y, self.above = self.y, self.y + n, raw[-1].tobytes()
        return [(first + k, r.tobytes()) for k, r in enumerate(raw)]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"inflater": None, "fresh": []}


class RowEncoder:
    """Takes rows in order; ``finish`` gives the file. Adam7 and indexed images without a palette are refused."""

    def __init__(self, header: dict, palette: list | None = None, level: str = "default", strategy: str = "adaptive"):
        if header["interlace"]:
            raise ImageError("InterlacedNotSupported")
        self.header, self.level, self.strategy = header, level, strategy
        self.head = preamble(header, palette)
        self.width = row_bytes(header["width"], header["color_type"], header["bit_depth"])
        self.filtered: list[bytes] = []  # the filtered rows that are in no state yet
        self.rows_written = 0
        self.above, self.done = b"", False

    def write_row(self, row: bytes) -> None:
        if self.done:
            raise ImageError("AlreadyFinished")
        if self.rows_written >= self.header["height"]:
            raise ImageError("RowCountMismatch")
        if len(row) != self.width:
            raise ImageError("InvalidImage")
        two = np.frombuffer((self.above or bytes(self.width)) + row, np.uint8).reshape(2, self.width)
        self.filtered.append(filter_rows(two, pixel_bytes(self.header["color_type"], self.header["bit_depth"]), self.strategy)[1].tobytes())
        self.above = row
        self.rows_written += 1

    def finish(self, earlier: bytes = b"") -> bytes:
        """The file; ``earlier`` are the filtered rows that were taken out before."""
        if self.done:
            raise ImageError("AlreadyFinished")
        if self.rows_written != self.header["height"]:
            raise ImageError("RowCountMismatch")
        self.done = True
        return self.head + body(compress(b"".join((earlier, *self.filtered)), self.level))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"filtered": []}


class _Kept(StatefulProcessor):
    """One small pickled object for each image, and lists of what grows with it."""

    LISTS: tuple[str, ...] = ()

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.ttl} if self.ttl else {}
        self.state = handle.getValueState("image", _BLOB, **ttl)
        self.lists = {name: handle.getListState(name, _BLOB, **ttl) for name in self.LISTS}

    def load(self) -> dict:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {"next": 0, "early": {}, "work": None, "done": False}

    def save(self, s: dict) -> None:
        self.state.update((pickle.dumps(s),))

    def add(self, name: str, pieces: list[bytes]) -> None:
        if pieces:
            self.lists[name].appendValue((b"".join(pieces),))

    def listed(self, name: str) -> list[bytes]:
        return [bytes(x[0]) for x in self.lists[name].get()] if self.lists[name].exists() else []

    def end(self) -> None:
        """Leave nothing of an image but the mark that it is done."""
        for kept in self.lists.values():
            kept.clear()
        self.save({"done": True})

    def close(self) -> None:
        pass


# Inflaters of images that are not finished, by a name that lies in the image's state and changes with each micro-batch:
# a repeated batch finds none and inflates anew.
_inflaters: OrderedDict[str, object] = OrderedDict()
MOST_INFLATERS = 256


class _Decode(_Kept):
    LISTS = ("compressed", "pixels")

    def __init__(self, ttl_ms: int | None, whole: bool):
        super().__init__(ttl_ms)
        self.whole = whole

    def resume(self, work: RowDecoder, name: str) -> None:
        work.inflater = _inflaters.pop(name, None)
        if work.inflater is None:
            work.inflater = zlib.decompressobj()
            for piece in self.listed("compressed"):
                work.inflater.decompress(piece)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self.load(), []
        if s["done"]:
            return
        for pdf in rows:
            s["early"] |= {int(q): bytes(f) for q, f in zip(pdf["seq"], pdf["fragment"]) if q >= s["next"]}
        work, error, pixels = s["work"], None, []
        if work is None:
            work = s["work"] = RowDecoder()
        elif s["next"] in s["early"]:
            self.resume(work, s["name"])
        else:  # nothing to go on with
            self.save(s)
            return
        while s["next"] in s["early"] and not error and not work.is_finished:
            try:
                found = work.feed(s["early"].pop(s["next"]))
                out += [(key[0], y, d, False, None, None, None) for y, d in found]
                pixels += [d for _, d in found] if self.whole else []
            except ImageError as e:
                error = e.label
            s["next"] += 1
        if error or work.is_finished:
            data = None if error or not self.whole else b"".join(self.listed("pixels") + pixels)
            out.append((key[0], None, data, True, error, work.header, work.colours))
            self.end()
        else:
            self.add("compressed", work.fresh)
            self.add("pixels", pixels)
            s["name"] = uuid.uuid4().hex
            self.save(s)
            _inflaters[s["name"]] = work.inflater
            if len(_inflaters) > MOST_INFLATERS:
                _inflaters.popitem(last=False)
        if out:
            yield pd.DataFrame(out, columns=["image", "y", "data", "finished", "error", "header", "palette"]).astype({"y": "Int64"})


class _Encode(_Kept):
    LISTS = ("filtered",)

    def __init__(self, ttl_ms: int | None, level: str, strategy: str):
        super().__init__(ttl_ms)
        self.level, self.strategy = level, strategy

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.load()
        if s["done"]:
            return
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                s.setdefault("header", dict(zip(FIELDS, (int(r.width), int(r.height), int(r.bit_depth), int(r.color_type), 0, 0, 0))))
                if s.get("palette") is None and getattr(r, "palette", None) is not None:
                    s["palette"] = [{c: int(v[c]) for c in "rgb"} for v in r.palette]
                if int(r.y) >= s["next"]:
                    s["early"][int(r.y)] = bytes(r.data)
        h, result = s["header"], None
        try:
            # A palette may come with any of an indexed image's rows.
            if s["work"] is None and (h["color_type"] != 3 or s.get("palette") is not None or len(s["early"]) >= h["height"]):
                s["work"] = RowEncoder(h, s.get("palette"), self.level, self.strategy)
            while s["work"] and s["next"] in s["early"]:
                s["work"].write_row(s["early"].pop(s["next"]))
                s["next"] += 1
            if s["work"] and s["work"].rows_written == h["height"]:
                result = (key[0], s["work"].finish(b"".join(self.listed("filtered"))), None)
        except ImageError as e:
            result = (key[0], None, e.label)
        if result:
            self.end()
            yield pd.DataFrame([result], columns=["image", "content", "error"])
        else:
            self.add("filtered", s["work"].filtered if s["work"] else [])
            self.save(s)


def decode_stream(fragments: DataFrame, ttl_ms: int | None = None, whole: bool = False) -> DataFrame:
    """Rows of images from a stream of (image string, seq long, fragment binary); the session's state store must be STORE.

    The last row of an image (``finished``) has its error, header and palette, and with ``whole`` all its pixels as data,
    for which its rows are kept in the state.
    """
    return fragments.groupBy("image").transformWithStateInPandas(_Decode(ttl_ms, whole), DECODED, "Update", "None")


def encode_stream(rows: DataFrame, level: str = "default", strategy: str = "adaptive", ttl_ms: int | None = None) -> DataFrame:
    """Files from a stream of (image string, y long, data binary, width, height, bit_depth, color_type) and, for indexed
    images, palette, which some row of each must have."""
    return rows.groupBy("image").transformWithStateInPandas(_Encode(ttl_ms, level, strategy), ENCODED, "Update", "None")
