"""Order-preserving packing of documents into fixed-size sequences by dynamic programming.

The token stream of a partition (documents in their stored order, each followed by an end id) is cut into windows of at
most ``capacity`` ids. Cuts may stand at document ends and, at a penalty, at sentence ends; a sentence longer than
``longest`` ids counts as several. With c the cut places, the least cost up to cut j is

    f[j] = penalty[j] + min over i with c[j] - c[i] <= capacity of f[i] + capacity - (c[j] - c[i])

and since f[i] + c[i] does not depend on j, the minimum over the sliding range of i is kept in a monotone queue: each
cut enters and leaves once. A partition is streamed in segments of ``segment`` ids; the ids after a segment's best last
cut open the next segment, so no segment adds padding and memory does not grow with the partition.

Nothing is shuffled: windows never cross partitions, and a partition's last window is the only one that must be short.

Defined results: a null or empty text is the end id alone; a null document id stays null; repeated rows are packed as
often as they occur; an empty table gives no pieces; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
SENTENCE_PENALTY = 8
FORCED_PENALTY = 24


def best_cuts(places: list[int], penalties: list[int], capacity: int) -> tuple[list[int], list[float]]:
    """For rising ``places`` with places[0] == 0 and gaps of at most ``capacity``: each place's best predecessor and cost."""
    n = len(places)
    back, cost, rank = [0] * n, [0.0] * n, [0.0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        c = places[j]
        least = c - capacity
        while places[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        f = rank[i] + capacity - c + penalties[j]
        back[j], cost[j] = i, f
        f += c
        rank[j] = f
        while queue and rank[queue[-1]] >= f:
            queue.pop()
        queue.append(j)
    return back, cost


class _Stream:
    """The pieces of one partition's documents."""

    def __init__(self, part: int, enc, capacity: int, end_id: int, segment: int, longest: int):
        self.capacity, self.end_id, self.segment, self.longest = capacity, end_id, segment, min(longest, capacity)
        self.enc, self.sequence = enc, part << 36
        vocabulary = enc.tokenizer.get_vocab()
        size = max(max(vocabulary.values()), end_id) + 1
        self.ends, self.spaces = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocabulary.items():
            # Byte-level files write a space as U+0120 and a line feed as U+010A.
            self.ends[i] = token[-1:] in ".!?Ċ"
            self.spaces[i] = token[:1] in "ĠĊ"
        self.docs: list[tuple[int | None, bytes, int]] = []  # id, ids, first id not yet in a piece
        self.open = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        ids += self.end_id.to_bytes(4, "little")
        self.docs.append((doc_id, ids, 0))
        self.open += len(ids) // 4
        if self.open >= self.segment:
            yield from self.flush(False)

    def _candidates(self) -> tuple[list[int], list[int]]:
        """Places where the open ids may be cut, and the penalty of each."""
        a = np.concatenate([np.frombuffer(ids, "<u4", offset=4 * first) for _, ids, first in self.docs])
        sentence = np.zeros(len(a) + 1, bool)
        sentence[1:-1] = self.ends[a[:-1]] & self.spaces[a[1:]]
        doc = np.cumsum([len(ids) // 4 - first for _, ids, first in self.docs])
        sentence[doc] = sentence[0] = True
        edges = np.flatnonzero(sentence)
        more = (np.diff(edges) - 1) // self.longest  # cuts inside long sentences
        forced = np.repeat(edges[:-1] - self.longest * (np.cumsum(more) - more), more) + self.longest * np.arange(1, more.sum() + 1)
        kind = np.full(len(a) + 1, FORCED_PENALTY)
        kind[edges] = SENTENCE_PENALTY
        kind[doc] = kind[0] = 0
        sentence[forced] = True
        places = np.flatnonzero(sentence)
        return places.tolist(), kind[places].tolist()

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        places, penalties = self._candidates()
        back, cost = best_cuts(places, penalties, self.capacity)
        j = len(places) - 1
        if not last:
            # Any of the last cuts may be followed by what is still to come; the cheapest for its place stays.
            near = [k for k in range(len(places) - 1, 0, -1) if places[-1] - places[k] < self.capacity]
            j = min(near, key=lambda k: cost[k] + places[-1] - places[k])
        cuts = [j]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts = np.array([places[k] for k in reversed(cuts)])
        sizes = np.array([len(ids) // 4 - first for _, ids, first in self.docs])
        ends = np.cumsum(sizes)
        edges = np.unique(np.concatenate((cuts, ends[ends < cuts[-1]])))
        doc = np.searchsorted(ends, edges[:-1], "right")
        window = np.searchsorted(cuts, edges[:-1], "right") - 1
        for a, b, d, w in zip(edges.tolist(), edges[1:].tolist(), doc.tolist(), window.tolist()):
            doc_id, ids, first = self.docs[d]
            start = a - int(ends[d] - sizes[d]) + first
            piece = ids[4 * start : 4 * (start + b - a)]
            yield doc_id, start, b - a, zlib.crc32(piece), len(ids) // 4, self.sequence + w, a - int(cuts[w]), piece
        self.sequence += len(cuts) - 1
        done = int(cuts[-1])
        rest = [(i, ids, max(first, first + done - int(e - s))) for (i, ids, first), e, s in zip(self.docs, ends, sizes) if e > done]
        self.docs, self.open = rest, int(ends[-1]) - done


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, segment: int = 1 << 20, longest: int = 32, with_ids: bool = True, keep_words: int | None = None) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text) in sequences of at most ``capacity`` ids; ``ids`` is little-endian uint32 bytes.

    ``keep_words`` bounds the words that a Python worker caches (about 200 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(TaskContext.get().partitionId(), encoder(tokenizer_path, keep_words), capacity, end_id, segment, longest)
        names = [x.split()[0] for x in SCHEMA.split(", ")][: None if with_ids else -1]
        types = [pa.int64()] * 7 + [pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t, _ in zip(zip(*rows), types, names)], names)

        rows: list[tuple] = []
        for b in batches:
            for at in range(0, b.num_rows, 256):
                ids, texts = b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()
                for i, t in zip(ids, stream.enc.encode_all(texts)):
                    rows.extend(stream.add(i, t))
                if len(rows) >= 4096:
                    yield batch(rows)
                    rows = []
        rows.extend(stream.flush(True))
        if rows:
            yield batch(rows)

    store.small_batches(docs.sparkSession)
    schema = SCHEMA if with_ids else SCHEMA.rpartition(",")[0]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
