"""Exact Jaccard join of documents' word shingles, with skipping by the relations between sets.

A document's set is that of its distinct five-word shingles (ASCII lower case). Two link at Jaccard 0.75 or more; the
result is each document's component under links.

1. Equal sets are one class, found by two 64-bit sums over their shingles; from here on one member stands for it.
2. Shingles are ordered by how many shingles of all documents fall into the same of 2**22 hash buckets (a table of fixed
   size), then by hash. Any one order makes prefix filtering exact; this one puts frequent shingles last. A set of
   n sends its first floor(n/4) + 1 shingles, with size and position, to an inverted index dealt by shingle. Lists of
   one are dropped there.
3. First answers: in each list, members are paired with the list's first. Each set's most frequent such partner is its
   reference; their overlap is counted exactly. Links found so far make provisional components.
4. Remaining answers: only pairs of one list and different provisional components can still matter. A list is a block
   for each size, sorted by position; whole blocks are skipped by the size filter, and of a block all from the first
   position on that leaves too few shingles (the positional bound). A pair whose two overlaps o, o' with the same
   reference of size r are known is decided from them where possible: at least o + o' - r shingles are common, and at
   most min(o, o') + min(n - o, n' - o'). The rest are counted exactly.

Pairs within a component are never listed, so a group of near copies costs one link a member. In a list, members outside
its commonest component meet all others; both sides are dealt in chunks of about ``CHUNK``, and a cell of two chunks is
the unit of work, so no list is one task's and a task holds a batch of pairs at a time. Texts are not shuffled unless the
number of sets to be compared exceeds ``FEW``; up to that, their row numbers are broadcast.

Defined results: a null, empty or wordless text has an empty set and is linked with nothing (its component is its own
doc_id); repeated rows are equal sets; a null doc_id never names a component that has another; an empty table gives no
rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .components import connected
from .words import SPACE, Words, find_words, mix

N = 5
BITS = 22
SLICES = 256
STRETCH = 8 << 20
CHUNK = 256
FEW = 1 << 20


class Threshold:
    """Jaccard of at least num / den, in whole numbers."""

    def __init__(self, num: int = 75, den: int = 100):
        self.num, self.den = num, den

    def prefix(self, n):
        """How many of the first of ``n`` shingles two linked sets must have one in common among."""
        return n + (-self.num * n // self.den) + 1  # n - ceil(num n / den) + 1

    def overlap(self, n, m):
        """The least number of common shingles of linked sets of sizes ``n`` and ``m``."""
        return -(-self.num * (n + m) // (self.num + self.den))


def rows_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return store.numbered(docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "uid")


def distinct(tokens: np.ndarray, first: np.ndarray, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each text's 64-bit ``tokens`` in order (of ``rarity``, where given, then of value) and without repetitions.

    One sort for all texts of a slice; the later sorts are stable and by small numbers, which numpy does by radix.
    """
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint16), np.diff(first))
    order = np.argsort(tokens)
    if rarity is not None:
        order = order[np.argsort(rarity[order], kind="stable")]
    order = order[np.argsort(text[order], kind="stable")]
    tokens, text = tokens[order], text[order]
    new = np.append(True, (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1]))[: len(tokens)]
    return tokens[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(first) - 1))))


def _shingles(w: Words, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes and each text's first; texts of fewer than ``least`` words have none."""
    s, first = w.shingles(n)
    if least > 1 and len(s):
        short = w.counts < least
        s = s[~np.repeat(short, np.diff(first))]
        first = np.concatenate(([0], np.cumsum(np.where(short, 0, np.diff(first)))))
    return s, first


def survey(rows: DataFrame, n: int = N, least: int = 1, extra: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """In one pass: uid, doc_id, n (set size) and two sums that tell sets apart (null where the set is empty), with the
    long columns named in ``extra``; and for each of 2**BITS hash buckets how many shingles fall into it, as a byte on a
    quarter-octave scale. Executors add the counts and scale them, so that no more than those bytes reach the driver."""
    store.small_batches(rows.sparkSession)
    width = (1 << BITS) // SLICES
    names = ["uid", "doc_id", *extra, "n", "sig1", "sig2", "slice", "counts"]
    kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for b in batches:
            for w in find_words(b.column(1), SPACE, lower=True):
                s, first = _shingles(w, n, least)
                np.add.at(total, (s >> np.uint64(64 - BITS)).astype(np.int64), np.uint32(1))
                s, first = distinct(s, first)
                size = np.diff(first)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(seed))))) for seed in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                sig = [pa.array((x[first[1:]] - x[first[:-1]]).view(np.int64), mask=size == 0) for x in sums]
                m = len(size)
                own = [b.column(k).slice(w.row, m) for k in (2, 0, *range(3, 3 + len(extra)))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), *sig, pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], names)
        if total.any():
            press = zstandard.ZstdCompressor(level=1)
            tail = [pa.array(range(SLICES), pa.int64()), pa.array([press.compress(total[i * width : (i + 1) * width].tobytes()) for i in range(SLICES)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(SLICES, t) for t in kinds[:-2]], *tail], names)

    def scale(counts: np.ndarray) -> np.ndarray:
        return np.floor(4 * np.log2(counts + 1.0)).astype(np.uint8)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.frombuffer(zstandard.ZstdDecompressor().decompress(c), np.uint32).astype(np.int64)
                sums[i] = sums[i] + got if i in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array([scale(x).tobytes() for x in sums.values()], pa.binary())], ["slice", "rarity"])

    table = store.written(rows.select("doc_id", "text", "uid", *extra).mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", counts binary"), "survey")
    parts = min(SLICES, store.n_partitions(rows.sparkSession))
    rarity = np.zeros(1 << BITS, np.uint8)
    for i, c in table.where("slice IS NOT NULL").select("slice", "counts").repartition(parts, "slice").mapInArrow(add, "slice long, rarity binary").collect():
        rarity[i * width : (i + 1) * width] = np.frombuffer(c, np.uint8)
    return table.where("slice IS NULL").select(*names[:-2]), rarity


def _only(rows: DataFrame, uids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of texts by row number; the numbers are broadcast only where they are counted to be few."""
    if uids.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(uids), "uid", how).select(rows.columns)
    return rows.join(uids.hint("shuffle_hash"), "uid", how).select(rows.columns)


def index_lists(rows: DataFrame, rarity: np.ndarray, limit: Threshold, n: int = N, least: int = 1) -> DataFrame:
    """token, doc, uid, n, pos of the prefixes of all sets of ``rows``, without lists of one member, and each list's first
    member (by doc, then uid) with its size: first, first_n."""
    spark = rows.sparkSession
    store.small_batches(spark)
    parts = store.n_partitions(spark)
    buckets = 8 * parts
    # Equally rare shingles are ordered by hash.
    known = spark.sparkContext.broadcast(rarity)
    kinds = ("<u8", "<i8", "<i8", "<i4", "<i4")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        press = zstandard.ZstdCompressor(level=1)

        def out() -> Iterator[pa.RecordBatch]:
            if not size:
                return
            columns = [np.concatenate(x) for x in zip(*held)]
            bucket = (columns[0] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((columns[0], bucket))
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)).tolist() if len(order) else []
            keys, blobs = [], []
            for i, j in zip(cuts, [*cuts[1:], len(order)]):
                o = order[i:j]
                keys.append(int(bucket[o[0]]))
                blobs.append(press.compress(np.array([j - i], "<i8").tobytes() + b"".join(c[o].astype(k).tobytes() for c, k in zip(columns, kinds))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "packed"])

        for b in batches:
            docs, uids = b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), b.column(2).to_numpy()
            for w in find_words(b.column(1), SPACE, lower=True):
                s, first = _shingles(w, n, least)
                tokens, first = distinct(s, first, known.value[(s >> np.uint64(64 - BITS)).astype(np.int64)])
                sizes = np.diff(first)
                pos = np.arange(len(tokens)) - np.repeat(first[:-1], sizes)
                text = np.repeat(np.arange(len(sizes)), sizes)
                keep = pos < limit.prefix(sizes)[text]
                text, place = text[keep], w.row + text[keep]
                held.append((tokens[keep], docs[place], uids[place], sizes[text], pos[keep]))
                size += len(w.data)
                if size >= STRETCH:
                    yield from out()
                    held, size = [], 0
        yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        current = None

        def out() -> Iterator[pa.RecordBatch]:
            if not blobs:
                return
            got: list[list[np.ndarray]] = [[] for _ in kinds]
            for blob in blobs:
                raw = zstandard.ZstdDecompressor().decompress(blob)
                m = int(np.frombuffer(raw, "<i8", 1)[0])
                at = 8
                for k, kind in enumerate(kinds):
                    got[k].append(np.frombuffer(raw, kind, m, at))
                    at += got[k][-1].nbytes
            token, *rest = map(np.concatenate, got)
            order = np.argsort(token)
            same = token[order][1:] == token[order][:-1]
            o = order[np.append(same, False) | np.append(False, same)]
            if len(o):
                token, (doc, uid, sizes, pos) = token[o], [x[o].astype(np.int64) for x in rest]
                by = np.lexsort((uid, doc, token))
                new = np.append(True, token[by][1:] != token[by][:-1])
                first = np.empty(len(o), np.int64)
                first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), doc, uid, sizes, pos, uid[first], sizes[first])], ["token", "doc", "uid", "n", "pos", "first", "first_n"])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if bucket != current:
                    yield from out()
                    blobs, current = [], bucket
                blobs.append(blob)
        yield from out()

    dealt = rows.select("doc_id", "text", "uid").mapInArrow(send, "bucket long, packed binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "token long, doc long, uid long, n long, pos long, first long, first_n long")


def overlaps(pairs: DataFrame, rows: DataFrame, n: int = N) -> DataFrame:
    """``pairs`` (a, b, ...) with ``o``, the exact number of common shingles."""
    uids = store.written(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "compared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in find_words(b.column(1), SPACE, lower=True):
                s, first = _shingles(w, n, 1)
                values, first = distinct(s, first)
                yield pa.RecordBatch.from_arrays([b.column(2).slice(w.row, len(first) - 1), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))], ["uid", "s"])

    sets = _only(rows, uids, "left_semi").select("doc_id", "text", "uid").mapInArrow(run, "uid long, s array<long>")
    left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b")
    return both.withColumn("o", F.size(F.array_intersect("sa", "sb")).cast("long")).drop("sa", "sb")


def _need(limit: Threshold, n, m):
    return F.ceil(F.lit(limit.num) * (n + m) / F.lit(limit.num + limit.den) - F.lit(1e-9))


def references(lists: DataFrame, limit: Threshold) -> DataFrame:
    """a, b, na, nb: each set ``a`` and the one set ``b`` that comes first in most of its lists."""
    pairs = lists.where("uid <> first").select(F.col("uid").alias("a"), F.col("first").alias("b"), F.col("n").alias("na"), F.col("first_n").alias("nb"))
    near = pairs.where((F.col("na") * limit.den >= F.col("nb") * limit.num) & (F.col("nb") * limit.den >= F.col("na") * limit.num))
    counted = near.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    best = counted.groupBy("a", "na").agg(F.max(F.struct(F.col("c"), (-F.col("b")).alias("b"), F.col("nb"))).alias("x"))
    return best.select("a", (-F.col("x.b")).alias("b"), "na", F.col("x.nb").alias("nb"))


def remaining(lists: DataFrame, known: DataFrame, roots: DataFrame, limit: Threshold) -> DataFrame:
    """a, b, na, nb, sure: pairs of one list and different provisional components that no filter or bound excludes.

    ``known``: a, ref, o, nr (overlap with the reference of size nr); ``roots``: node, root. ``sure`` pairs are linked.
    """
    spark = lists.sparkSession
    told = lists.join(known.withColumnRenamed("a", "uid"), "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    told = told.select(
        "token", "uid", "n", "pos", F.coalesce("root", "uid").alias("root"),
        # A set without a reference is its own, as are the references of others.
        F.coalesce("ref", "uid").alias("ref"), F.coalesce("o", "n").alias("o"), F.coalesce("nr", "n").alias("nr"),
    )
    told = store.written(told, "members")
    by_root = told.groupBy("token", "root").agg(F.count("*").alias("c"))
    mixed = by_root.groupBy("token").agg(F.sum("c").alias("m"), F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("k")).where("k > 1")
    # Members of the commonest component need not meet each other: the others, ``minor``, meet all. Both sides of a list
    # are dealt in chunks, and each pair of chunks is a cell.
    mixed = mixed.select("token", F.col("top.root").alias("major"), F.ceil((F.col("m") - F.col("top.c")) / CHUNK).alias("nx"), F.ceil(F.col("m") / CHUNK).alias("ny"))
    members = told.join(mixed, "token").withColumn("minor", F.col("root") != F.col("major"))
    chunk = lambda salt, count: F.pmod(F.xxhash64("uid", F.lit(salt)), F.col(count))
    all_of = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    kept = ["token", "uid", "n", "pos", "root", "ref", "o", "nr", "minor"]
    asked = members.where("minor").select(*kept, F.lit(True).alias("asks"), chunk(1, "nx").alias("i"), F.explode(all_of("ny")).alias("j"))
    met = members.select(*kept, F.lit(False).alias("asks"), chunk(2, "ny").alias("j"), F.explode(all_of("nx")).alias("i"))
    members = asked.unionByName(met)
    schema = "a long, b long, na long, nb long, sure boolean"

    def pairs(t: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        """Of one cell: arrays a, b, na, nb, sure."""
        x_side = np.flatnonzero(t["asks"])
        order = np.flatnonzero(~t["asks"])
        order = order[np.lexsort((t["pos"][order], t["n"][order]))]
        root, uid, n, pos, ref, o, nr, minor = (t[k][order] for k in ("root", "uid", "n", "pos", "ref", "o", "nr", "minor"))
        sizes, starts = np.unique(n, return_index=True)
        ends = np.append(starts[1:], len(n))
        for x in x_side.tolist():
            nx = int(t["n"][x])
            for block in range(np.searchsorted(sizes, -(-nx * limit.num // limit.den)), np.searchsorted(sizes, nx * limit.den // limit.num, "right")):
                ny = int(sizes[block])
                need = int(limit.overlap(nx, ny))
                if nx - int(t["pos"][x]) < need:
                    continue
                a, b = int(starts[block]), int(ends[block])
                b = a + int(np.searchsorted(pos[a:b], ny - need, "right"))
                if a == b:
                    continue
                y = np.arange(a, b)
                # Two minor members meet twice; the one with the lesser number speaks.
                y = y[(root[y] != t["root"][x]) & (~minor[y] | (uid[y] > t["uid"][x]))]
                if not len(y):
                    continue
                together = ref[y] == t["ref"][x]
                ox, oy = int(t["o"][x]), o[y]
                most = np.minimum(ox, oy) + np.minimum(nx - ox, ny - oy)
                sure = together & (ox + oy - nr[y] >= need)
                keep = ~together | (most >= need)
                y, sure = y[keep], sure[keep]
                ux, uy = np.full(len(y), t["uid"][x]), uid[y]
                yield np.array([np.minimum(ux, uy), np.maximum(ux, uy), np.where(ux < uy, nx, ny), np.where(ux < uy, ny, nx), sure])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["asks", "uid", "n", "pos", "root", "ref", "o", "nr", "minor"]
        left: pa.Table | None = None

        def cells_of(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            keys = [table.column(k).to_numpy() for k in ("token", "i", "j")]
            new = np.append(True, (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1]))
            cuts = [*np.flatnonzero(new).tolist(), table.num_rows]
            whole = len(cuts) - 1 - (not last)
            return [table.slice(cuts[c], cuts[c + 1] - cuts[c]) for c in range(whole)], table.slice(cuts[whole])

        def answers(table: pa.Table, last: bool) -> tuple[Iterator[pa.RecordBatch], pa.Table]:
            got, rest = cells_of(table, last)
            found = [p for t in got for p in pairs({k: t.column(k).to_numpy() for k in names})]
            out = []
            if found:
                p = np.unique(np.concatenate(found, axis=1), axis=1)
                out = [pa.RecordBatch.from_arrays([*[pa.array(r) for r in p[:4]], pa.array(p[4].astype(bool))], ["a", "b", "na", "nb", "sure"])]
            return iter(out), rest

        for b in batches:
            t = pa.Table.from_batches([b])
            out, left = answers(pa.concat_tables([left, t]) if left is not None and left.num_rows else t, False)
            yield from out
        if left is not None and left.num_rows:
            yield from answers(left, True)[0]

    dealt = members.repartition(store.n_partitions(spark), "token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(run, schema).groupBy("a", "b", "na", "nb").agg(F.max("sure").alias("sure"))


def links(rows: DataFrame, rarity: np.ndarray, limit: Threshold, n: int = N) -> DataFrame:
    """u, v: links whose components are those of all links among the sets of ``rows`` (which are distinct)."""
    lists = store.written(index_lists(rows, rarity, limit, n), "lists")
    refs = store.written(references(lists, limit), "references")
    first = store.written(overlaps(refs, rows, n), "overlaps")
    linked = lambda o, a, b: F.col(o) * (limit.num + limit.den) >= F.lit(limit.num) * (F.col(a) + F.col(b))
    found = first.where(linked("o", "na", "nb")).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected(found)
    known = first.select("a", F.col("b").alias("ref"), "o", F.col("nb").alias("nr"))
    rest = store.written(remaining(lists, known, roots, limit), "remaining")
    # A pair that was counted as set and reference is not counted again.
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_pairs = store.written(rest.where(~F.col("sure")).select("a", "b", "na", "nb").join(done, ["a", "b"], "left_anti"), "open")
    store.drop_written(lists, refs)
    more = overlaps(open_pairs, rows, n).where(linked("o", "na", "nb"))
    all_links = found.unionByName(rest.where("sure").select(F.col("a").alias("u"), F.col("b").alias("v"))).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    out = store.written(all_links, "links")
    store.drop_written(first, rest, open_pairs, roots)
    return out


def near_duplicates(docs: DataFrame, n: int = N, limit: Threshold | None = None, key: str = "doc_id") -> DataFrame:
    """Each row of ``docs``: uid, doc_id, n_shingles, component_id (the least doc_id) and ``first``, true for one row of each."""
    return components_of(rows_of(docs, key), n, limit)


def components_of(rows: DataFrame, n: int = N, limit: Threshold | None = None) -> DataFrame:
    """As :func:`near_duplicates`, of rows (doc_id, text, uid) that are numbered already."""
    limit = limit or Threshold()
    sets, rarity = survey(rows, n)
    some = sets.where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    classes = store.written(some.groupBy("sig1", "sig2", "n").agg(F.min(place).alias("p")).select("sig1", "sig2", "n", F.col("p.doc_id").alias("rep_doc"), F.col("p.uid").alias("rep")), "classes")
    # Rows that do not stand for their class, and rows without a set, take no part in the join.
    single = store.written(sets.join(classes.select(F.col("rep").alias("uid")), "uid", "left_anti").select("uid"), "others")
    linked = links(_only(rows, single, "left_anti"), rarity, limit, n)
    roots = connected(linked)
    store.drop_written(single, linked)
    reps = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = F.min(F.struct(F.col("rep_doc").isNull().alias("none"), F.col("rep_doc").alias("doc_id"), F.col("rep").alias("uid"))).alias("p")
    named = reps.groupBy("root").agg(least).select("root", F.col("p.doc_id").alias("component_id"), F.col("p.uid").alias("keeper"))
    by_class = reps.join(named, "root").select("sig1", "sig2", "n", "component_id", "keeper")
    # A class of many rows is one row here; AQE splits its rows on the other side.
    told = some.join(by_class, ["sig1", "sig2", "n"]).select("uid", "doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("keeper")).alias("first"))
    return told.unionByName(sets.where("n = 0").select("uid", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first")))


def keep_first(docs: DataFrame, n: int = N, limit: Threshold | None = None) -> DataFrame:
    """The rows of ``docs`` that are the first (least doc_id) of their component, with their own columns."""
    told = store.numbered(docs, "_j_uid")
    rows = told.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("_j_uid").alias("uid"))
    later = store.written(components_of(rows, n, limit).where(~F.col("first")).select(F.col("uid").alias("_j_uid")), "later")
    few = later.limit(FEW + 1).count() <= FEW
    return told.join(F.broadcast(later) if few else later.hint("shuffle_hash"), "_j_uid", "left_anti").drop("_j_uid")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
