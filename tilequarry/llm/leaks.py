"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks, in DataFrame expressions only.

Words are maximal runs of letters, digits and non-ASCII characters, lower-cased. An item of L words is compared with all
windows of L words of a document; a shorter document is one window.

1. A document and a length L are held if the document has a five-word shingle of an item of L words. Where there is
   none, no window of that length shares anything with such an item, so this loses nothing; documents without any cost
   one hash lookup a word and move nothing.
2. Of what is held, every window gets a 64-bit SimHash of its shingles, weighted by their characters. The 64 sums of
   weights roll from window to window (running sums of what enters and leaves), four to a 64-bit number in 16-bit lanes.
3. Fingerprints are cut into four blocks of 16 bits. Two within ``RADIUS`` = 15 bits of each other differ by at most
   three bits in one block at least, so the items' blocks are indexed with all their neighbours within three bits (697
   entries a block), and each block of a window is looked up once. The exact distance is checked after.
4. Candidates are verified by weighted Jaccard of their distinct shingle strings, at least ``SIMILARITY``.

What passes 4 is lost only where its fingerprints are further apart than the radius: shingles that agree to 6/7 (0.75 as
Jaccard) differ by 11 bits on average. Tests measure this share. Items of fewer than five words are one shingle of all
their words. Tables that are broadcast (shingles and index of the items) are so up to ``FEW`` rows, which is checked;
beyond, the same joins are shuffled. Fingerprints of windows of more than 32,000 shingles use a part of them chosen by
hash, as the lanes hold no larger sums.

Defined results: a null or empty text or item meets nothing; rows with a null doc_id or item_id are compared as others;
repeated rows are found each; an empty table on either side gives no rows; other columns are ignored by ``leaks`` and
kept by ``decontaminate``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

N = 5
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
LANES = 16
MOST_WEIGHT = 32_000
STEP = 1 << 16
SIMILARITY = 0.75
FEW = 1 << 20
FEW_ROWS = 1 << 20
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: str) -> Column:
    cut = F.split(F.lower(F.col(text).cast("string")), _NOT_WORD)
    return F.filter(F.coalesce(cut, F.array().cast("array<string>")), lambda x: x != "")


def _clean_words(text: str) -> Column:
    """As ``_words`` without a test of every word: only the ends of a split can be empty."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), _NOT_WORD, " ")), " ", -1)


def _hashes(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words; none if there are fewer."""
    w = F.col(words)
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _strings(words: str, k: Column) -> Column:
    """The runs of ``k`` words as strings."""
    w = F.col(words)
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))


def _items(benchmark: DataFrame) -> DataFrame:
    words = benchmark.select("item_id", _words("text").alias("w"), F.monotonically_increasing_id().alias("item")).withColumn("len", F.size("w")).where("len > 0")
    return words.withColumn("k", F.least(F.lit(N), F.col("len"))).withColumn("s", F.array_distinct(_strings("w", F.col("k"))))


def _fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (``len`` among them), start and fp: every window of ``len`` words of the arrays ``w``; a shorter ``w`` is one.

    A row for each shingle holds what enters and what leaves the sums there, so that running sums are the windows' sums.
    Texts are dealt in stretches of ``STEP`` windows, so that no sum runs over more.
    """
    k = "least(%d, len)" % N
    df = df.where(f"size(w) >= {k}").select(*keys, _strings("w", F.expr(k)).alias("s"), F.expr(f"least(len - {k} + 1, size(w) - {k} + 1)").alias("m"))
    df = df.withColumn("hs", F.expr("transform(s, x -> xxhash64(x))"))
    part = f"CASE WHEN m <= {MOST_WEIGHT} THEN least(char_length(x), {MOST_WEIGHT} div m) WHEN pmod(get(hs, i), 1 + m div {MOST_WEIGHT // 2}) = 0 THEN 1 ELSE 0 END"
    df = df.withColumn("cs", F.expr(f"transform(s, (x, i) -> CAST({part} AS bigint))")).drop("s")
    df = df.withColumn("base", F.expr(f"explode(sequence(0, size(hs) - m, greatest({STEP}, m)))"))
    own = lambda c: f"slice({c}, base + 1, greatest({STEP}, m) + m - 1)"
    df = df.withColumn("hs", F.expr(own("hs"))).withColumn("cs", F.expr(own("cs")))
    gone = lambda c: F.expr(f"slice(concat(array_repeat(0L, m), {c}), 1, size({c}))")
    zipped = F.arrays_zip(F.col("hs"), F.col("cs"), gone("hs").alias("hg"), gone("cs").alias("cg"))
    rows = df.select(*keys, "m", "base", F.posexplode_outer(zipped).alias("i", "x")).select(*keys, "m", "base", "i", "x.*")
    spread = sum(1 << (16 * x) for x in range(4))
    lane = lambda h, c, j: F.shiftrightunsigned(h, j).bitwiseAND(F.lit(spread)) * F.col(c)
    over = Window.partitionBy(*keys, "base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.try_sum(lane("hs", "cs", j) - lane("hg", "cg", j)).over(over).alias(f"s{j}") for j in range(LANES)]
    rows = rows.select(*keys, "m", "base", "i", F.try_sum(F.col("cs") - F.col("cg")).over(over).alias("weight"), *sums).where("i >= m - 1")
    # A lane's sum is over half of the weight if adding the rest to 2**14 - 1 sets bit 14.
    bit = lambda j: f"((s{j} + (16383 - weight div 2) * {spread}L) & {spread << 14}L)"
    moved = [f"shiftrightunsigned({bit(j)}, {14 - j})" if j < 15 else f"shiftleft({bit(j)}, 1)" for j in range(LANES)]
    return rows.select(*keys, F.expr("base + i - m + 1").alias("start"), F.expr(f"coalesce({' | '.join(moved)}, 0L)").alias("fp"))


def _keys(fp: str) -> Column:
    """A number for each block of a fingerprint: length, block and the block's bits."""
    return F.array(*[(F.col("len").cast("long") * BLOCKS + b) * (1 << BLOCK_BITS) + F.shiftrightunsigned(F.col(fp), b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for b in range(BLOCKS)])


def _index(items: DataFrame) -> DataFrame:
    """key, item, ifp: each block of the items' fingerprints and all that differ from it by few enough bits."""
    near = [x for x in range(1 << BLOCK_BITS) if x.bit_count() <= RADIUS // BLOCKS]
    return items.select("item", F.col("fp").alias("ifp"), F.explode(_keys("fp")).alias("block")).select("item", "ifp", F.explode(F.lit(near)).alias("flip"), "block").select(F.col("block").bitwiseXOR(F.col("flip").cast("long")).alias("key"), "item", "ifp")


def _held(rows: DataFrame, items: DataFrame) -> DataFrame:
    """uid, doc_id, len, w: documents, and lengths of items of which they have a shingle."""
    out = []
    for k in sorted(r[0] for r in items.select("k").distinct().collect()):
        entry = items.where(F.col("k") == k).select("len", F.explode(_hashes("w", k)).alias("hash")).distinct()
        docs = _words_of(rows, k)
        if entry.limit(FEW + 1).count() <= FEW:
            met = docs.select("uid", "doc_id", "w", F.explode("h").alias("hash")).join(F.broadcast(entry), "hash")
            out.append(met.groupBy("uid", "doc_id", "len").agg(F.any_value("w").alias("w")))
        else:
            met = docs.select("uid", F.explode("h").alias("hash")).join(entry, "hash").select("uid", "len").distinct()
            out.append(docs.select("uid", "doc_id", "w").join(met, "uid").select("uid", "doc_id", "len", "w"))
    if not out:
        return _words_of(rows, N).select("uid", "doc_id", F.lit(0).alias("len"), "w").where(F.lit(False))
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _words_of(rows: DataFrame, k: int) -> DataFrame:
    """uid, doc_id, w, h. No filter is pushed through a column that depends on a row's place, which would split texts anew
    for each word."""
    held = rows.select("uid", "doc_id", _clean_words("text").alias("w")).select("uid", "doc_id", "w", _hashes("w", k).alias("h"))
    return held.select(F.when(F.monotonically_increasing_id() >= 0, F.col("uid")).alias("uid"), "doc_id", "w", "h")


def met_windows(windows: DataFrame, items: DataFrame) -> DataFrame:
    """uid, len, start, item of windows (uid, len, start, fp) and items whose fingerprints share a block's neighbourhood, with ``distance``."""
    index = _index(items)
    few = index.limit(FEW + 1).count() <= FEW
    probes = windows.select("uid", "len", "start", "fp", F.explode(_keys("fp")).alias("key"))
    return probes.join(F.broadcast(index) if few else index, "key").select("uid", "len", "start", "item", F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))).alias("distance"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """uid, doc_id, item_id, start (word), len, similarity: the best window of each row of ``docs`` and item over the threshold."""
    return _leaks(store.numbered(docs.select("doc_id", "text"), "uid"), benchmark, similarity)


def _leaks(rows: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    items = store.written(_items(benchmark.select("item_id", "text")), "items")
    items = store.written(items.join(_fingerprints(items.select("item", "len", "w"), ["item", "len"]).select("item", "fp"), "item"), "items")
    held = store.written(_held(rows, items), "held")
    windows = _fingerprints(held.select("uid", "len", "w"), ["uid", "len"])
    near = met_windows(windows, items).where(F.col("distance") <= RADIUS).select("uid", "len", "start", "item").distinct()
    own = _strings("w", F.least(F.lit(N), F.col("len")))
    both = near.join(held, ["uid", "len"]).withColumn("w", F.slice("w", F.col("start") + 1, F.col("len"))).withColumn("own", F.array_distinct(own)).join(items.select("item", "item_id", F.col("s").alias("t")), "item")
    weight = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    alike = weight(F.array_intersect("own", "t")) / weight(F.array_union("own", "t"))
    best = both.withColumn("similarity", alike).where(F.col("similarity") >= similarity)
    return best.groupBy("uid", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "len")).alias("b")).select("uid", "doc_id", "item_id", (-F.col("b.start")).cast("long").alias("start"), F.col("b.len").cast("long").alias("len"), F.col("b.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    told = store.numbered(docs, "_b_uid")
    rows = told.select("doc_id", "text", F.col("_b_uid").alias("uid"))
    bad = store.written(_leaks(rows, benchmark, similarity).select(F.col("uid").alias("_b_uid")).distinct(), "leaks")
    few = bad.limit(FEW_ROWS + 1).count() <= FEW_ROWS
    return told.join(F.broadcast(bad) if few else bad.hint("shuffle_hash"), "_b_uid", "left_anti").drop("_b_uid")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.col("start").alias("first_word"), F.col("len").alias("n_words"), "similarity")
