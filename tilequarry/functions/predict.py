"""Row prediction filters as expressions over array<int> rows, and as numpy kernels.

Filtering needs raw neighbours only, so whole tables of rows are filtered in parallel with ``lag``; undoing Average and
Paeth is a recurrence along and across rows, so it runs in one kernel an image (or Adam7 pass).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Whichever of left, above, upper-left is nearest to left + above - upper-left; ties in that order."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - c - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def _at(row: Column, i: Column, bpp: int) -> Column:
    return F.when(i >= bpp, F.get(row, i - bpp)).otherwise(0)


def filtered(row: Column, above: Column, kind: int, bpp: int) -> Column:
    """``row`` under one filter; ``above`` is the raw row before (zeros for the first)."""
    left = lambda i: _at(row, i, bpp)
    up = lambda i: F.get(above, i)
    corner = lambda i: _at(above, i, bpp)
    guess = [
        lambda i: F.lit(0),
        left,
        up,
        lambda i: F.shiftright(left(i) + up(i), 1),
        lambda i: paeth(left(i), up(i), corner(i)),
    ][kind]
    return row if kind == 0 else F.transform(row, lambda x, i: (x - guess(i)).bitwiseAND(255))


def score(row: Column) -> Column:
    """Sum of absolute values of the bytes taken as signed (128 counts 128)."""
    return F.aggregate(row, F.lit(0).cast("bigint"), lambda a, v: a + F.when(v < 128, v).otherwise(256 - v))


def best(scores: list[Column]) -> Column:
    """The filter of the least score; the earlier of equal ones."""
    return F.array_min(F.array(*[F.struct(s.alias("score"), F.lit(k).alias("filter")) for k, s in enumerate(scores)]))["filter"]


def unfiltered_sub(row: Column, bpp: int = 1) -> Column:
    """Undoes Sub: a running sum of each byte column of a pixel, modulo 256."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("i"))
    step = lambda s, x: F.struct(F.concat(s["out"], F.array((x + F.when(s["i"] >= bpp, F.get(s["out"], s["i"] - bpp)).otherwise(0)).bitwiseAND(255))).alias("out"), (s["i"] + 1).alias("i"))
    return F.aggregate(row, zero, step, lambda s: s["out"])


def filter_rows(raw: np.ndarray, bpp: int, strategy: str) -> np.ndarray:
    """Rows of bytes with their filter byte in front. ``strategy``: a filter's name, or adaptive. All rows at once."""
    h, n = raw.shape
    x = raw.astype(np.int16)
    a, b = np.zeros_like(x), np.zeros_like(x)
    a[:, bpp:] = x[:, : n - bpp] if n > bpp else 0
    b[1:] = x[:-1]
    c = np.zeros_like(x)
    c[1:] = a[:-1]
    names = ("none", "sub", "up", "average", "paeth")
    wanted = range(5) if strategy == "adaptive" else [names.index(strategy)]

    def guess(kind: int) -> np.ndarray:
        if kind == 4:
            p, q, r = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
            return np.where((p <= q) & (p <= r), a, np.where(q <= r, b, c))
        return (0, a, b, (a + b) >> 1)[kind]

    tried = [((x - guess(k)) & 255).astype(np.uint8) for k in wanted]
    costs = np.stack([np.abs(t.view(np.int8).astype(np.int64)).sum(1) for t in tried])
    pick = costs.argmin(0)
    out = np.empty((h, n + 1), np.uint8)
    out[:, 0] = np.array(list(wanted), np.uint8)[pick]
    for k, t in enumerate(tried):
        out[pick == k, 1:] = t[pick == k]
    return out


def unfilter_rows(data: np.ndarray, bpp: int) -> np.ndarray:
    """Raw rows from rows with a filter byte. Raises ValueError for a filter byte over 4."""
    kinds = data[:, 0]
    if len(kinds) and kinds.max() > 4:
        raise ValueError("InvalidFilterType")
    h, n = data.shape[0], data.shape[1] - 1
    out = np.zeros((h, n), np.uint8)
    above = np.zeros(n, np.uint8)
    for y in range(h):
        row, kind = data[y, 1:], kinds[y]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            for k in range(bpp):
                out[y, k::bpp] = np.cumsum(row[k::bpp], dtype=np.uint8)
        elif kind == 2:
            out[y] = row + above
        else:
            out[y] = _recur(row.tolist(), above.tolist(), bpp, kind == 4)
        above = out[y]
    return out


def _recur(row: list[int], above: list[int], bpp: int, by_paeth: bool) -> list[int]:
    out = [0] * bpp
    ahead = [0] * bpp + above
    for x, b, c in zip(row, above, ahead):
        a = out[-bpp]
        if by_paeth:
            p, q, r = abs(b - c), abs(a - c), abs(a + b - c - c)
            guess = a if p <= q and p <= r else b if q <= r else c
        else:
            guess = (a + b) >> 1
        out.append((x + guess) & 255)
    return out[bpp:]
