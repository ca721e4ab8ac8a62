"""zlib and DEFLATE: code tables made from their rules, canonical Huffman codes, LZ77 matching, and whole streams.

Whole streams are compressed and inflated by the C library that Python carries; the block reader and the token writer
here serve to look into streams and to produce the block kinds one asks for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ImageError
from .bits import BitReader, BitWriter

WINDOW = 32768
MIN_MATCH, MAX_MATCH = 3, 258
# Search depth and the level of the C library, by level name.
CHAIN = {"store": 0, "fastest": 4, "fast": 16, "default": 64, "best": 256}
ZLIB_LEVEL = {"store": 0, "fastest": 1, "fast": 3, "default": 6, "best": 9}
# The order in which the lengths of the code-length code are sent.
CODE_ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


# Fixed values of RFC 1951: (base, extra bits) of the length codes from 257 and of the distance codes from 0.
# fmt: off
LENGTHS = [
    (3, 0), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (10, 0), (11, 1), (13, 1), (15, 1), (17, 1), (19, 2),
    (23, 2), (27, 2), (31, 2), (35, 3), (43, 3), (51, 3), (59, 3), (67, 4), (83, 4), (99, 4), (115, 4), (131, 5),
    (163, 5), (195, 5), (227, 5), (258, 0),
]
DISTANCES = [
    (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (7, 1), (9, 2), (13, 2), (17, 3), (25, 3), (33, 4), (49, 4), (65, 5),
    (97, 5), (129, 6), (193, 6), (257, 7), (385, 7), (513, 8), (769, 8), (1025, 9), (1537, 9), (2049, 10), (3073, 10),
    (4097, 11), (6145, 11), (8193, 12), (12289, 12), (16385, 13), (24577, 13),
]
# fmt: on


def length_code(n: int) -> tuple[int, int, int]:
    """Code, extra bits and their value for a match length."""
    k = 28 if n == 258 else max(i for i, (b, _) in enumerate(LENGTHS[:28]) if b <= n)
    return 257 + k, LENGTHS[k][1], n - LENGTHS[k][0]


def distance_code(d: int) -> tuple[int, int, int]:
    k = max(i for i, (b, _) in enumerate(DISTANCES) if b <= d)
    return k, DISTANCES[k][1], d - DISTANCES[k][0]


def _code_of(value: Column, per_bits: int, first: int, most: int) -> Column:
    """Codes of values from 0: 2 ** per_bits of them for each further extra bit, after twice as many without any."""
    extra = F
    for e in range(most, 0, -1):
        extra = extra.when(value >= 1 << (e + per_bits), e)
    extra = extra.otherwise(0)
    head = F.call_function("shiftright", value, extra)
    code = F.when(extra > 0, (extra + 1) * (1 << per_bits) + head.bitwiseAND((1 << per_bits) - 1)).otherwise(value)
    rest = value - F.call_function("shiftleft", head, extra)
    return F.struct((code + first).cast("bigint").alias("code"), extra.cast("bigint").alias("extra_bits"), rest.cast("bigint").alias("extra"))


def length_code_of(n: Column) -> Column:
    """struct(code, extra_bits, extra) for a match length of 3 to 258; the longest has a code of its own."""
    longest = F.struct(F.lit(285).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("extra_bits"), F.lit(0).cast("bigint").alias("extra"))
    return F.when(n == 258, longest).when(n.between(3, 257), _code_of(n - 3, 2, 257, 5))


def distance_code_of(d: Column) -> Column:
    return F.when(d.between(1, WINDOW), _code_of(d - 1, 1, 0, 13))


def fixed_length(symbol: Column) -> Column:
    """Bits of a literal or length symbol in the fixed code."""
    return F.when(symbol < 144, 8).when(symbol < 256, 9).when(symbol < 280, 7).otherwise(8).cast("bigint")


def fixed_lengths() -> list[int]:
    return [8] * 144 + [9] * 112 + [7] * 24 + [8] * 8


def zlib_header(level: str) -> bytes:
    """CMF and FLG: 32 KB window, a two-bit level, and the check that makes the pair a multiple of 31."""
    flevel = {"store": 0, "fastest": 0, "fast": 1, "default": 2, "best": 3}[level]
    word = 0x7800 | flevel << 6
    return (word + (31 - word % 31) % 31).to_bytes(2, "big")


def zlib_header_of(level: Column) -> Column:
    """CMF * 256 + FLG as a number, by level name."""
    return F.coalesce(*[F.when(level == k, F.lit(int.from_bytes(zlib_header(k), "big"))) for k in CHAIN]).cast("bigint")


def zlib_header_error(word: Column, available: Column | None = None) -> Column:
    """What is wrong with CMF * 256 + FLG; null if nothing."""
    cmf = F.shiftright(word, 8)
    return F.coalesce(
        F.when(word % 31 != 0, "InvalidChecksum"),
        F.when(cmf.bitwiseAND(15) != 8, "InvalidCompressionMethod"),
        F.when(F.shiftright(cmf, 4) > 7, "InvalidWindowSize"),
        F.when(word.bitwiseAND(32) != 0, "DictNotSupported"),
    )


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of the canonical code; raises for more codes than fit."""
    if sum(1 << (15 - n) for n in lengths if n) > 1 << 15:
        raise ValueError("InvalidCodeLengths")
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (code, n)
        code, last = code + 1, n
    return out


def best_lengths(counts: list[int], limit: int = 15) -> list[int]:
    """Optimal code lengths of at most ``limit`` bits, by package-merge."""
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0][1]] = 1
    if len(used) < 2:
        return out
    coins = [(c, (s,)) for c, s in used]
    row = coins
    for _ in range(limit - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2])]
        row = sorted(coins + pairs, key=lambda x: x[0])
    for _, symbols in row[: 2 * len(used) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def _reverse(code: int, n: int) -> int:
    return int(format(code, f"0{n}b")[::-1], 2)


class Matcher:
    """Longest matches within the last 32768 bytes, over chains of places with the same three bytes."""

    def __init__(self, data: bytes, depth: int):
        self.data, self.depth = data, depth
        self.places: dict[bytes, list[int]] = {}

    def insert(self, start: int, stop: int) -> None:
        for i in range(start, min(stop, len(self.data) - 2)):
            self.places.setdefault(self.data[i : i + 3], []).append(i)

    def find(self, at: int) -> tuple[int, int] | None:
        """(length, distance) of the longest match; the nearest of equal ones."""
        data = self.data
        most = min(MAX_MATCH, len(data) - at)
        best = None
        for tried, i in enumerate(reversed(self.places.get(data[at : at + 3], ()))):
            if tried >= self.depth or at - i > WINDOW:
                break
            if best and data[i + best[0] : i + best[0] + 1] != data[at + best[0] : at + best[0] + 1]:
                continue
            n = 3
            while n < most and data[i + n] == data[at + n]:
                n += 1
            if not best or n > best[0]:
                best = (n, at - i)
                if n == most:
                    break
        return best


def tokens(data: bytes, level: str = "default") -> Iterator[tuple[int, int] | int]:
    """Greedy LZ77: literals as byte values, matches as (length, distance)."""
    matcher, at = Matcher(data, CHAIN[level]), 0
    while at < len(data):
        m = matcher.find(at) if len(data) - at >= MIN_MATCH and matcher.depth else None
        n = m[0] if m else 1
        yield m if m else data[at]
        matcher.insert(at, at + n)
        at += n


def expand(found: Iterator[tuple[int, int] | int]) -> bytes:
    """The bytes that tokens stand for; a match may overlap what it makes."""
    out = bytearray()
    for t in found:
        if isinstance(t, tuple):
            n, d = t
            if not 0 < d <= len(out):
                raise ValueError("InvalidDistance")
            for _ in range(n):
                out.append(out[-d])
        else:
            out.append(t)
    return bytes(out)


def deflate_fixed(data: bytes, level: str = "default") -> bytes:
    """One block in the fixed code; stored blocks at level store."""
    w = BitWriter()
    if level == "store":
        pieces = [data[i : i + 65535] for i in range(0, len(data), 65535)] or [b""]
        for k, p in enumerate(pieces):
            w.write(k == len(pieces) - 1, 1)
            w.write(0, 2)
            w.flush()
            w.write_bytes(len(p).to_bytes(2, "little") + (len(p) ^ 0xFFFF).to_bytes(2, "little") + p)
        return w.written
    code = {s: (_reverse(c, n), n) for s, (c, n) in canonical(fixed_lengths()).items()}
    w.write(1, 1)
    w.write(1, 2)
    for t in tokens(data, level):
        if isinstance(t, tuple):
            s, bits, extra = length_code(t[0])
            w.write(*code[s])
            w.write(extra, bits)
            s, bits, extra = distance_code(t[1])
            w.write(_reverse(s, 5), 5)
            w.write(extra, bits)
        else:
            w.write(*code[t])
    w.write(*code[256])
    w.flush()
    return w.written


class BlockReader:
    """Looks into a DEFLATE stream: one record a block, with its tokens."""

    def __init__(self, data: bytes):
        self.bits, self.out, self.last = BitReader(data), bytearray(), False

    def _symbol(self, table: dict[tuple[int, int], int]) -> int:
        code, n = 0, 0
        while n < 15:
            code, n = code << 1 | self.bits.read(), n + 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("InvalidHuffmanCode")

    @staticmethod
    def _table(lengths: list[int]) -> dict[tuple[int, int], int]:
        return {(n, c): s for s, (c, n) in canonical(lengths).items()}

    def _dynamic(self) -> tuple[dict, dict]:
        read = self.bits.read
        literals, distances, codes = read(5) + 257, read(5) + 1, read(4) + 4
        if literals > 286 or distances > 30:
            raise ValueError("InvalidDynamicHeader")
        lengths = [0] * 19
        for k in CODE_ORDER[:codes]:
            lengths[k] = read(3)
        table, got = self._table(lengths), []
        while len(got) < literals + distances:
            s = self._symbol(table)
            if s < 16:
                got.append(s)
            elif s == 16 and not got:
                raise ValueError("InvalidDynamicHeader")
            else:
                got += [got[-1]] * (3 + read(2)) if s == 16 else [0] * (3 + read(3)) if s == 17 else [0] * (11 + read(7))
        if len(got) > literals + distances:
            raise ValueError("InvalidDynamicHeader")
        return self._table(got[:literals]), self._table(got[literals:])

    def blocks(self) -> Iterator[dict]:
        """kind, the number of literals and matches, and bytes made so far, for each block."""
        read = self.bits.read
        while not self.last:
            self.last, kind = bool(read()), read(2)
            literals = matches = 0
            if kind == 0:
                n = int.from_bytes(self.bits.read_bytes(2), "little")
                if int.from_bytes(self.bits.read_bytes(2), "little") != n ^ 0xFFFF:
                    raise ValueError("InvalidStoredLength")
                self.out += self.bits.read_bytes(n)
                literals = n
            elif kind == 3:
                raise ValueError("InvalidBlockType")
            else:
                lit, dist = (self._table(fixed_lengths()), self._table([5] * 30)) if kind == 1 else self._dynamic()
                while (s := self._symbol(lit)) != 256:
                    if s < 256:
                        self.out.append(s)
                        literals += 1
                        continue
                    if s > 285:
                        raise ValueError("InvalidLengthCode")
                    base, extra = LENGTHS[s - 257]
                    n = base + read(extra)
                    base, extra = DISTANCES[self._symbol(dist)]
                    d = base + read(extra)
                    if d > len(self.out):
                        raise ValueError("InvalidDistance")
                    for _ in range(n):
                        self.out.append(self.out[-d])
                    matches += 1
            yield {"kind": ("stored", "fixed", "dynamic")[kind], "final": self.last, "literals": literals, "matches": matches, "size": len(self.out)}


def compress(data: bytes, level: str = "default") -> bytes:
    """A zlib stream; compressed blocks use the fixed code only."""
    c = zlib.compressobj(ZLIB_LEVEL[level], zlib.DEFLATED, 15, 8, zlib.Z_FIXED if level != "store" else zlib.Z_DEFAULT_STRATEGY)
    return c.compress(data) + c.flush()


def decompress(data: bytes, size: int | None = None) -> bytes:
    """The bytes of a zlib stream; more than ``size`` of them, or a broken stream, is DecompressionFailed."""
    if len(data) < 2:
        raise ImageError("DecompressionFailed", "UnexpectedEndOfStream")
    if data[1] & 32 and int.from_bytes(data[:2], "big") % 31 == 0:
        raise ImageError("DecompressionFailed", "DictNotSupported")
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, 0 if size is None else size + 1)
        if size is not None and len(out) == size and not d.eof:
            out += d.decompress(d.unconsumed_tail, 1)
    except zlib.error as e:
        raise ImageError("DecompressionFailed", str(e)) from None
    if not d.eof and (size is None or len(out) <= size):
        raise ImageError("DecompressionFailed", "UnexpectedEndOfStream")
    return out
