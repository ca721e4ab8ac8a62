"""Words and word shingles of whole Arrow text columns, as numpy arrays over the UTF-8 bytes.

No Python object is made per word: separators are found by a 256-entry table, and a word's 64-bit hash is a polynomial
over its bytes taken from prefix sums modulo 2**64. Texts are processed in slices of about ``SLICE`` bytes so that the
temporary arrays stay in cache and memory stays bounded whatever the batch; one longer text is one slice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 2**64, (2, 256), np.uint64)
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
_PLACE = _rng.integers(0, 2**64, (2, 64), np.uint64) | np.uint64(1)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, which: int, inverse: bool) -> np.ndarray:
    got = _powers.get((which, inverse))
    if got is None or len(got) < n:
        base = int(_BASE[which])
        steps = np.full(max(n, SLICE + 1), pow(base, -1, 2**64) if inverse else base, np.uint64)
        steps[0] = 1
        got = np.cumprod(steps)
        if n <= 4 * SLICE:
            _powers[which, inverse] = got
    return got


@dataclass
class Words:
    """Words of some texts. ``first[d]:first[d + 1]`` are the words of text ``d``; starts and ends are byte places in ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray
    row: int

    def hashes(self, which: int = 0) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[which][self.data] * _power(n, which, False)[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * _power(n + 1, which, True)[self.starts])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, n: int, which: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words of one text, and each text's first in them (len(texts) + 1).

        A text with some, but fewer than ``n`` words gives one: its whole sequence.
        """
        h = self.hashes(which) if hashes is None else hashes
        counts = self.counts
        if not len(h):
            return h, np.zeros(len(self.first), np.int64)
        total = np.zeros(len(h) + n, np.uint64)
        for k in range(n):
            total[n - 1 - k : n - 1 - k + len(h)] += h * _PLACE[which][k]
        full = mix(total[n - 1 : n - 1 + len(h)])
        n_out = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        last = np.repeat(self.first[:-1] + n_out, counts)
        keep = np.arange(len(h)) < last
        out = full[keep]
        first = np.concatenate(([0], np.cumsum(n_out)))
        for d in np.flatnonzero((counts < n) & (counts > 0)):
            a, b = self.first[d], self.first[d + 1]
            out[first[d]] = mix((h[a:b] * _PLACE[which][: b - a]).sum(keepdims=True) + np.uint64(b - a))[0]
        return out, first


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if pa.types.is_string_view(column.type) or pa.types.is_null(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False, slice_bytes: int = SLICE, slice_rows: int = 4096) -> Iterator[Words]:
    """The words of every text, slice by slice; ``row`` is the column's place of a slice's first text.

    A Python worker that has encoded texts before and now does other work drops its cached words here.
    """
    if tokens := sys.modules.get(f"{__package__}.tokens"):
        tokens.forget()
    raw, offsets = text_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1)
        to = min(to, at + slice_rows)
        data, off = raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        yield _slice(_LOWER[data] if lower else data, off, separators, at)
        at = to


def _slice(data: np.ndarray, off: np.ndarray, separators: np.ndarray, row: int) -> Words:
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside))
    after = np.concatenate((inside, [False]))
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return Words(data, starts, ends, np.searchsorted(starts, off), off, row)


def windows(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours in ``h`` (len(h) - n + 1 of them), by prefix sums whatever ``n``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(len(h), which, False)[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * _power(len(h) + 1, which, True)[: len(h) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` neighbours, in about log2(n) passes."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x
