"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the least hash of the ``SEED``-word runs in
it, so equal windows have equal minimisers. Consecutive windows with the same minimiser form a super-k-mer: one packed
string of their words that travels to the minimiser's bucket once, instead of one string for each window. Before that,
equal super-k-mers of one stretch of a task's input are sent as one string with a list of places, so that a document
with a third of all rows as its copies costs places, not text; strings are Zstandard-compressed by bucket.

In a bucket, windows are sorted by a 128-bit hash of their words and, within equal ones, by place; all but the first are
repeats. A bucket returns intervals of words to remove; they are gathered by row and joined to the texts. They are
broadcast only where they are counted to be few (``FEW_SPANS``); beyond, texts and intervals are shuffled by row. A row's own number (its place in the input) tells rows of one doc_id apart.

Defined results: a null or empty text has no words; a null document id sorts before all others and stays null; of rows
with the same doc_id the one stored first counts as earlier; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .jaccard import rows_of
from .words import SPACE, Words, find_words, sliding_min, windows

WINDOW = 20
SEED = 4
STRETCH = 8 << 20
FEW_SPANS = 1 << 22
LEAST = np.iinfo(np.int64).min


def _spaced(w: Words) -> tuple[bytes, np.ndarray]:
    """The words with one space after each, and where each begins."""
    sep_after = np.zeros(len(w.data) + 1, bool)
    sep_after[w.ends] = True
    inside = ~SPACE[w.data]
    keep = inside | sep_after[:-1]
    lengths = w.ends - w.starts
    # A word that ends where the next text begins has no separator of its own to keep; no super-k-mer crosses that place.
    at = np.concatenate(([0], np.cumsum(keep)))[w.starts] if len(w.starts) else lengths
    return np.where(inside, w.data, 32).astype(np.uint8)[keep].tobytes(), at


class _Packer:
    """Super-k-mers of a stretch of rows, packed by bucket."""

    def __init__(self, buckets: int, window: int, seed: int):
        self.buckets, self.window, self.seed = buckets, window, seed
        self.clear()

    def clear(self) -> None:
        self.strings: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, w: Words, doc: np.ndarray, uid: np.ndarray) -> None:
        n, counts = self.window, w.counts
        self.bytes += len(w.data)
        if len(w.starts) < n or counts.max() < n:
            return
        h = w.hashes()
        low = sliding_min(windows(h, self.seed), n - self.seed + 1)  # low[i]: of the window that begins at word i
        valid = np.arange(len(low)) <= np.repeat(w.first[1:], counts)[: len(low)] - n
        new = valid.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
        new[w.first[:-1][counts >= n]] = True
        begin = np.flatnonzero(new)
        end = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1  # after a run's last window
        text = np.searchsorted(w.first, begin, "right") - 1
        words = end - begin + n - 1
        data, at = _spaced(w)
        last = end + n - 2
        a, b = at[begin], at[last] + (w.ends - w.starts)[last]
        self.strings += [data[i:j] for i, j in zip(a.tolist(), b.tolist())]
        self.parts.append((low[begin] % np.uint64(self.buckets), words, doc[text], uid[text], begin - w.first[text]))

    def rows(self) -> Iterator[tuple[int, bytes]]:
        if self.parts:
            bucket, words, doc, uid, start = (np.concatenate(x) for x in zip(*self.parts))
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(s, len(number)) for s in self.strings), np.int64, len(self.strings))
            order = np.lexsort((start, uid, doc, ids, bucket))
            ids, bucket = ids[order], bucket[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            strings = list(number)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            press = zstandard.ZstdCompressor(level=1)
            for i, j in zip(cuts, np.append(cuts[1:], len(bucket))):
                f = first[np.searchsorted(first, i) : np.searchsorted(first, j)]
                own = [strings[k] for k in ids[f].tolist()]
                o = order[i:j]
                head = np.array([len(own), j - i], "<i8").tobytes()
                places = np.diff(np.append(f, j)).astype("<i4").tobytes() + np.array([len(s) for s in own], "<i4").tobytes()
                yield int(bucket[i]), press.compress(b"".join((head, places, doc[o].astype("<i8").tobytes(), uid[o].astype("<i8").tobytes(), start[o].astype("<i4").tobytes(), *own)))
        self.clear()


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    at, out = 16, []
    for kind, size in (("<i4", n), ("<i4", n), ("<i8", m), ("<i8", m), ("<i4", m)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return (*out, np.frombuffer(raw, np.uint8, -1, at))


def repeats(blobs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's super-k-mers: rows and intervals of words that repeats cover."""
    counts, sizes, doc, uid, start, data = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
    n = len(sizes)
    offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    head = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))  # head[s]: the earliest place of super-k-mer s
    column = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    keys, n_words = [[], []], []
    for w in find_words(column):
        n_words.append(w.counts)
        fits = np.arange(len(w.starts)) <= np.repeat(w.first[1:], w.counts) - window
        for which in (0, 1):
            k = windows(w.hashes(which), window, which)
            keys[which].append(k[fits[: len(k)]])
    k1, k2, n_words = (np.concatenate(x) for x in (*keys, n_words))
    n_win = n_words - window + 1
    base = np.concatenate(([0], np.cumsum(n_win)))
    order = np.argsort(k1)
    same = k1[order][1:] == k1[order][:-1]
    several = order[np.append(same, False) | np.append(False, same)]
    later = np.zeros(len(k1), bool)
    if len(several):
        s = np.searchsorted(base, several, "right") - 1
        f = head[s]
        place = start[f] + (several - base[s])
        by = np.lexsort((place, uid[f], doc[f], k2[several], k1[several]))
        o = several[by]
        later[o[1:]] = (k1[o][1:] == k1[o][:-1]) & (k2[o][1:] == k2[o][:-1])
    # The first place of a super-k-mer: runs of its repeated windows. Its other places: all of it.
    edge = np.zeros(len(later) + 1, bool)
    edge[base] = True
    left = np.flatnonzero(later & (~np.append(False, later[:-1]) | edge[:-1]))
    right = np.flatnonzero(later & (~np.append(later[1:], False) | edge[1:]))
    s = np.searchsorted(base, left, "right") - 1
    f = head[s]
    rest = np.ones(len(doc), bool)
    rest[head[:-1]] = False
    whole = np.repeat(n_words, counts)[rest]
    rows = np.concatenate((uid[f], uid[rest]))
    begins = np.concatenate((start[f] + left - base[s], start[rest]))
    stops = np.concatenate((start[f] + right - base[s] + window, start[rest] + whole))
    return rows, begins.astype(np.int64), stops.astype(np.int64)


def repeated_intervals(rows: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """uid, begin, stop: words of a row of ``rows`` (doc_id, text, uid) that some repeated window covers; they may overlap."""
    store.small_batches(rows.sparkSession)
    parts = store.n_partitions(rows.sparkSession)
    buckets = 8 * parts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets, window, seed)

        def out() -> Iterator[pa.RecordBatch]:
            got = list(packer.rows())
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.binary())], ["bucket", "packed"])

        for b in batches:
            doc, uid = b.column(0).fill_null(LEAST).to_numpy(), b.column(2).to_numpy()
            for w in find_words(b.column(1)):
                to = w.row + len(w.counts)
                packer.add(w, doc[w.row : to], uid[w.row : to])
                if packer.bytes >= STRETCH:
                    yield from out()
        yield from out()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        current = None

        def out() -> Iterator[pa.RecordBatch]:
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in repeats(blobs, window)], ["uid", "begin", "stop"])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != current:
                    yield from out()
                    blobs, current = [], bucket
                blobs.append(blob)
        yield from out()

    packed = rows.mapInArrow(pack, "bucket long, packed binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(judge, "uid long, begin long, stop long")


def _finished(b: pa.RecordBatch, with_text: bool) -> pa.RecordBatch:
    spans = b.column(2)
    begin, stop = (spans.values.field(k).to_numpy() for k in (0, 1))
    at = spans.offsets.to_numpy()
    some = spans.is_valid().to_numpy(zero_copy_only=False)
    n, removed, digest, kept = [], [], [], []
    for i, text in enumerate(b.column(1).cast(pa.large_binary()).to_pylist()):
        words = (text or b"").split()
        n.append(len(words))
        if some[i]:
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, begin[at[i] : at[i + 1]], 1)
            np.add.at(step, stop[at[i] : at[i + 1]], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        removed.append(n[-1] - len(words))
        left = b" ".join(words)
        digest.append(hashlib.sha256(left).hexdigest())
        if with_text:
            kept.append(left.decode())
    columns = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * with_text, names + ["kept"] * with_text)


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """Each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by a space."""
    rows = rows_of(docs)
    spans = repeated_intervals(rows, window, seed).groupBy("uid").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield _finished(b.slice(at, 512), with_text)

    spans = store.written(spans, "spans")
    few = (spans.agg(F.sum(F.size("spans") + 2)).first()[0] or 0) <= FEW_SPANS
    joined = rows.join(F.broadcast(spans) if few else spans.hint("shuffle_hash"), "uid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
