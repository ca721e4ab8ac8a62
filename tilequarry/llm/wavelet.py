"""Token shards as wavelet matrices: one compressed file that counts, finds and returns ids.

A matrix over ids of ``bits`` bits has one bit-plane for each bit, highest first. Plane k holds that bit of the ids in
the order left by the planes above, in which ids with a 0 come before ids with a 1, each side in its old order. With
rank and select on the planes, ``access``, ``count`` and ``select`` take one step a plane. A file holds

    magic | bits, ids, documents | ids that occur | document ids, null marks, lengths | for each plane: zeros, ranks, bits

every array Zstandard-compressed where that makes it smaller. Ranks are kept at every 4096th bit.

``write_shards`` deals documents by ranges of their id (ties by their stored place, so that one id with many rows is
still spread), sorts each range and writes its shards to a shared folder, each first under a temporary name and then
renamed: a task that runs twice leaves the same file. ``read_shards`` opens the files one by one.

Defined results: a null or empty text is the end id alone; a null document id sorts first and stays null; repeated rows
are kept, those of one id in their stored order; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .tokens import encoder

MAGIC = b"TQWM\x01"
BLOCK = 4096
SHARD_IDS = 1 << 20


def _put(a: np.ndarray) -> bytes:
    raw = a.tobytes()
    small = zstandard.ZstdCompressor(level=1).compress(raw)
    kind, data = (1, small) if len(small) < len(raw) else (0, raw)
    return struct.pack("<BQQ", kind, len(raw), len(data)) + data


def _take(data: bytes, at: int, dtype: str) -> tuple[np.ndarray, int]:
    kind, raw, n = struct.unpack_from("<BQQ", data, at)
    at += 17
    got = zstandard.ZstdDecompressor().decompress(data[at : at + n], max_output_size=raw) if kind else data[at : at + n]
    return np.frombuffer(got, dtype), at + n


class WaveletMatrix:
    """Rank and select over ids; ``planes`` are packed bits, first bit highest, ``ranks`` the ones before each block."""

    def __init__(self, n: int, bits: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.planes, self.ranks = n, bits, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        a = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            ones = (a & a.dtype.type(1 << k)) != 0
            packed = np.packbits(ones)
            planes.append(packed)
            counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint64)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4"))
            low, high = np.compress(~ones, a), np.compress(ones, a)  # faster than a[ones] where bits are mixed
            zeros.append(len(low))
            a = np.concatenate((low, high))
        return cls(len(ids), bits, zeros, planes, ranks)

    def rank1(self, k: int, i: int) -> int:
        """Ones in plane ``k`` before place ``i``."""
        block = i // BLOCK
        whole, rest = divmod(i - block * BLOCK, 8)
        at = block * BLOCK // 8
        ones = int(self.ranks[k][block]) + int(np.bitwise_count(self.planes[k][at : at + whole]).sum(dtype=np.int64))
        return ones + (int(self.planes[k][at + whole] >> (8 - rest)).bit_count() if rest else 0)

    def _select(self, k: int, bit: int, nth: int) -> int:
        """Place in plane ``k`` of the ``nth`` (from 0) bit equal to ``bit``."""
        ones = self.ranks[k].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(before, nth, "right")) - 1
        at = block * BLOCK
        found = np.unpackbits(self.planes[k][at // 8 : (at + BLOCK) // 8])[: self.n - at] == bit
        return at + int(np.flatnonzero(found)[nth - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            bit = int(self.planes[k][i >> 3] >> (7 - (i & 7))) & 1
            ones = self.rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int, j: int) -> tuple[int, int]:
        for k in range(self.bits):
            a, b = self.rank1(k, i), self.rank1(k, j)
            i, j = (self.zeros[k] + a, self.zeros[k] + b) if value >> (self.bits - 1 - k) & 1 else (i - a, j - b)
        return i, j

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in places ``start`` to ``end``."""
        end = self.n if end is None else min(end, self.n)
        i, j = self._range(value, min(start, end), end)
        return j - i

    def select(self, value: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of an id."""
        i, j = self._range(value, 0, self.n)
        if not 0 <= nth < j - i:
            raise IndexError(nth)
        at = i + nth
        for k in range(self.bits - 1, -1, -1):
            one = value >> (self.bits - 1 - k) & 1
            at = self._select(k, one, at - self.zeros[k] if one else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the lowest up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[k])[: self.n].view(bool)
            b = np.empty_like(a)
            b[np.flatnonzero(~ones)] = a[: self.zeros[k]]
            b[np.flatnonzero(ones)] = a[self.zeros[k] :] | kind(1 << (self.bits - 1 - k))
            a = b
        return a


class Shard:
    """A matrix over the numbers of the ids that occur, which takes fewer planes than over all ids."""

    def __init__(self, matrix: WaveletMatrix, alphabet: np.ndarray):
        self.matrix, self.alphabet = matrix, alphabet

    def _number(self, value: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, value))
        return at if at < len(self.alphabet) and self.alphabet[at] == value else None

    def access(self, i: int) -> int:
        return int(self.alphabet[self.matrix.access(i)])

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in places ``start`` to ``end``."""
        k = self._number(value)
        return 0 if k is None else self.matrix.count(k, start, end)

    def select(self, value: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of an id."""
        k = self._number(value)
        if k is None:
            raise IndexError(nth)
        return self.matrix.select(k, nth)

    def ids(self) -> np.ndarray:
        return self.alphabet[self.matrix.ids()]


def to_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    alphabet = np.flatnonzero(np.bincount(ids, minlength=1)).astype("<u4")
    number = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    m = WaveletMatrix.build(number[ids], max(1, (len(alphabet) - 1).bit_length()))
    out = [MAGIC, struct.pack("<BQQ", m.bits, m.n, len(doc_ids)), _put(alphabet)]
    out += [_put(np.array([x or 0 for x in doc_ids], "<i8")), _put(np.array([x is None for x in doc_ids], "u1")), _put(np.array(lengths, "<u4"))]
    for z, ranks, plane in zip(m.zeros, m.ranks, m.planes):
        out += [struct.pack("<Q", z), _put(ranks), _put(plane)]
    return b"".join(out)


def from_file(data: bytes) -> tuple[Shard, np.ndarray, np.ndarray, np.ndarray]:
    """The shard, document ids, their null marks and lengths."""
    if data[:5] != MAGIC:
        raise ValueError("not a token shard")
    bits, n, _ = struct.unpack_from("<BQQ", data, 5)
    alphabet, at = _take(data, 22, "<u4")
    doc_ids, at = _take(data, at, "<i8")
    nulls, at = _take(data, at, "u1")
    lengths, at = _take(data, at, "<u4")
    zeros, ranks, planes = [], [], []
    for _ in range(bits):
        zeros.append(struct.unpack_from("<Q", data, at)[0])
        r, at = _take(data, at + 8, "<u4")
        p, at = _take(data, at, "u1")
        ranks.append(r)
        planes.append(p)
    return Shard(WaveletMatrix(n, bits, zeros, planes, ranks), alphabet), doc_ids, nulls, lengths


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards in ``folder``; returns the list of files: part, seq, file, n_docs, n_tokens."""
    spark = docs.sparkSession
    store.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer_path)
        fs, root = _fs(folder)
        end = end_id.to_bytes(4, "little")
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        size, seq = 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}.wm"
            data = to_file(np.frombuffer(b"".join(ids), "<u4"), doc_ids, [len(x) // 4 for x in ids])
            temporary = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(ids)], "n_tokens": [size]}, schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for b in batches:
            for at in range(0, b.num_rows, 256):
                keys = b.column(0).slice(at, 256).to_pylist()
                for i, x in zip(keys, enc.encode_all(b.column(1).slice(at, 256).to_pylist())):
                    doc_ids.append(i)
                    ids.append(x + end)
                    size += len(x) // 4 + 1
                    if size >= shard_ids:
                        yield flush()
                        doc_ids, ids, size, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    place = "_tq_place"
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias(place))
        .repartitionByRange(store.n_partitions(spark), "doc_id", place)
        .sortWithinPartitions("doc_id", place)
        .select("doc_id", "text")
    )
    return store.written(dealt.mapInArrow(run, "part long, seq long, file string, n_docs long, n_tokens long"), "shards")


def token_offsets(files: DataFrame) -> DataFrame:
    """Each file and the ids in all files before it. The driver sums one row a partition, not one a shard."""
    from pyspark.sql import Window

    spark = files.sparkSession
    before, rows = 0, []
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        rows.append((part, before))
        before += n
    bases = spark.createDataFrame(rows, "part long, base long")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("inside", F.coalesce(inside, F.lit(0))).join(bases, "part").select("file", (F.col("base") + F.col("inside")).alias("before"))


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """Each document of the shards: doc_id, its first id's place among all ids, its number of ids and their CRC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for b in batches:
            for name, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    shard, doc_ids, nulls, lengths = from_file(f.read())
                raw = shard.ids().astype("<u4").tobytes()
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(starts + before), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return token_offsets(files).repartition(store.n_partitions(files.sparkSession), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = store.fresh_path(spark, "wavelet")
    files = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(files, folder)
