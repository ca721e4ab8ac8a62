"""Secret scan: fixed patterns, and a battery of randomness tests under length-aware false-discovery control.

DataFrame expressions only. A text is split once by each pattern; the pieces between matches give the matches' places.
Matches then travel as small rows without their text. Runs of at least ``MIN_RUN`` encoded characters that hold a letter
are candidates. A run is cut at each ``=`` that is not at its end, and a part that fits no alphabet below at ``/``, at ``-``
and ``_``, and at all three; every part of that length is a candidate by itself. Each gets the narrowest encoding that fits (hex, base32, base36, base62, base64) and three tests of the
hypothesis that its symbols are drawn uniformly and independently from that alphabet:

* chi-squared over equal bins of the alphabet (as many bins as give five expected symbols each; Wilson-Hilferty),
* Wald-Wolfowitz runs above and below the middle of the alphabet,
* serial correlation at lag one,

joined by Fisher's method, whose tail has a closed form for three tests. Two rules then work within each stratum of
encoding and length octave, so short and long candidates are never pooled:

* The Benjamini-Hochberg step-up rule at ``ALPHA`` rejects what is *not* random, which bounds the secrets among the rejected.
* The share of false ones among the reported is held to ``FALSE``. p-values of random tokens are uniform, so those above
  one half tell how many random tokens there can be (two standard deviations are added, in favour of reporting). What
  is reported beyond that number's share is false, and the least p-value that is reported rises until few enough are.
  Long words of prose, whose p-values are small but not tiny, fall here.

p-values are rounded up to steps of ``10 ** -0.02`` for counting. Counts cover all documents; a token that occurs often
counts once, as copies say nothing about chance. What neither rule drops is reported as kind ``random``.

Defined results: a null or empty text has no spans; a null document id stays null; repeated rows are scanned alike, each
giving its row; an empty table gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

MIN_RUN = 20
ALPHA = 0.05
FALSE = 0.05
STEP = 50
UPPER = 15  # steps below this one have p-values above about one half
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN
# Parts of a run between inner '='; and what a part that fits no alphabet is cut to.
PART = r"[^=]{%d,}(?:=+$)?|[^=]+=+$" % MIN_RUN
PIECES = [r"[^%s]{%d,}" % (cut, MIN_RUN) for cut in ("/", "_-", "/_-")]
ALPHABETS = {
    "hex": ("0123456789abcdef", r"^[0-9a-f]+$"),
    "HEX": ("0123456789ABCDEF", r"^[0-9A-F]+$"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$"),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", r"^[0-9a-z]+$"),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", r"^[A-Za-z0-9]+$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^[A-Za-z0-9+/]+=*$"),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^[A-Za-z0-9_-]+=*$"),
}


def _found(text: Column, kind: int, pattern: str, group: int | None, least: int) -> Column:
    """Matches of ``pattern`` as structs: kind, idx, gap (code points since the match before), len, ok, token."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)]
    if group:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    zipped = F.filter(F.arrays_zip(*parts), lambda x: x["0"].isNotNull())
    judged = "2" if group else "0"
    out = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("idx"),
            F.char_length(x["1"]).cast("long").alias("gap"),
            F.char_length(x["0"]).cast("long").alias("len"),
            (F.char_length(x[judged]) >= least).alias("ok"),
            (x["0"] if kind == 3 else F.lit(None).cast("string")).alias("token"),
        ),
    )
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<kind:int,idx:int,gap:bigint,len:bigint,ok:boolean,token:string>>"))


def matches(docs: DataFrame) -> DataFrame:
    """One row for each match, and one with a null kind for a document without any: uid, doc_id, kind, start, stop, ok, token."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text")).withColumn("uid", F.monotonically_increasing_id())
    t = F.col("text")
    # A maximal run of hex digits is one match of both patterns when it is long enough.
    every = F.concat(_found(t, 0, ASSIGN, 2, 12), _found(t, 1, ACCESS, None, 18), _found(t, 2, HEX_LONG, None, 16), _found(t, 3, RUN, None, MIN_RUN))
    flat = rows.select("uid", "doc_id", F.explode_outer(every).alias("m")).select("uid", "doc_id", "m.*")
    w = Window.partitionBy("uid", "kind").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("len")).over(w)
    return flat.select("uid", "doc_id", "kind", (stop - F.col("len")).alias("start"), stop.alias("stop"), "ok", "token")


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution, by the Zelen-Severo polynomial (error below 1e-7)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _encoding(token: str) -> Column:
    """The narrowest encoding that fits, or null."""
    return F.coalesce(*[F.when(F.col(token).rlike(pattern), name) for name, (_, pattern) in ALPHABETS.items()])


def _pieces(token: Column, pattern: str) -> Column:
    """Matches of ``pattern`` that are long enough, as structs: at (characters before), token."""
    met, gaps = F.regexp_extract_all(token, F.lit(pattern), F.lit(0)), F.split(token, pattern, -1)
    length = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return F.filter(F.transform(met, lambda x, i: F.struct((length(gaps, i + 1) + length(met, i)).alias("at"), x.alias("token"))), lambda x: F.char_length(x["token"]) >= MIN_RUN)


def parts(runs: DataFrame) -> DataFrame:
    """The candidates of runs (uid, doc_id, start, token): uid, doc_id, start, stop, token."""
    cut = lambda rows, pieces: rows.select("uid", "doc_id", "start", F.explode(pieces).alias("p")).select("uid", "doc_id", (F.col("start") + F.col("p.at")).alias("start"), F.col("p.token").alias("token"))
    token = F.col("token")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), token.alias("token")))
    rows = cut(runs, F.when(token.rlike("=[^=]"), _pieces(token, PART)).otherwise(whole))
    rows = cut(rows, F.when(_encoding("token").isNotNull(), whole).otherwise(F.array_distinct(F.concat(*[_pieces(token, x) for x in PIECES]))))
    return rows.select("uid", "doc_id", "start", (F.col("start") + F.char_length("token")).alias("stop"), "token")


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``n`` and ``p`` (Fisher's joint p-value) to rows with ``token``; rows that fit no encoding go."""
    alphabet = F.coalesce(*[F.when(F.col("encoding") == name, a) for name, (a, _) in ALPHABETS.items()])
    df = tokens.where(F.col("token").rlike("[A-Za-z]")).withColumn("encoding", _encoding("token")).where(F.col("encoding").isNotNull())
    df = df.withColumn("alphabet", alphabet).withColumn("size", F.length("alphabet").cast("double"))
    body = F.rtrim(F.col("token"), F.lit("="))
    df = df.withColumn("x", F.transform(F.split(body, ""), lambda c: F.instr(F.col("alphabet"), c) - 1)).withColumn("n", F.size("x").cast("double"))
    n, k = F.col("n"), F.col("size")
    bins = F.greatest(F.lit(2.0), F.least(k, F.floor(n / 5).cast("double")))
    df = df.withColumn("bins", bins).withColumn("placed", F.transform("x", lambda v: F.floor(v * F.col("bins") / k)))
    symbol_bins = F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda v: F.floor(v * F.col("bins") / k))
    df = df.withColumn("symbol_bins", symbol_bins)
    chi = F.aggregate(
        F.transform(
            F.sequence(F.lit(0), F.col("bins").cast("int") - 1),
            lambda j: F.struct(F.size(F.filter("placed", lambda v: v == j)).cast("double").alias("o"), (n * F.size(F.filter("symbol_bins", lambda v: v == j)) / k).alias("e")),
        ),
        F.lit(0.0),
        lambda a, x: a + (x["o"] - x["e"]) * (x["o"] - x["e"]) / x["e"],
    )
    free = F.col("bins") - 1
    z_chi = (F.cbrt(F.col("chi") / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n
    df = df.withColumn("chi", chi).withColumn("mean", mean)
    pairs = F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    df = df.withColumn("pairs", pairs)
    turns = F.size(F.filter("pairs", lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2)))
    z_runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    spread = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    lagged = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + (p["a"] - F.col("mean")) * (p["b"] - F.col("mean")))
    z_serial = F.when(spread > 0, (lagged / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
    tiny = F.lit(1e-300)
    logs = [F.ln(F.greatest(p, tiny)) for p in (_tail(z_chi), 2 * _tail(F.abs(z_runs)), 2 * _tail(F.abs(z_serial)))]
    half = -(logs[0] + logs[1] + logs[2])
    return df.withColumn("half", half).withColumn("p", F.greatest(F.exp(-F.col("half")) * (1 + F.col("half") + F.col("half") * F.col("half") / 2), tiny)).drop("alphabet", "size", "x", "bins", "placed", "symbol_bins", "chi", "mean", "pairs", "half")


def not_rejected(tested: DataFrame, alpha: float = ALPHA, false: float = FALSE) -> DataFrame:
    """The rows of ``tested`` that are reported: randomness is not rejected by the step-up rule, and the estimated share of
    false ones among all that are reported of a stratum is at most ``false``.

    A stratum is an encoding and a length octave: a few hundred at most, so its limits are small enough to broadcast.
    """
    octave = F.floor(F.log2("n")).cast("int").alias("octave")
    step = F.floor(-F.log10("p") * STEP).cast("int").alias("step")
    marked = tested.select("*", octave, step)
    stratum = ["encoding", "octave"]
    once = marked.select(*stratum, "step", F.xxhash64("token").alias("token")).distinct()
    counts = once.groupBy(*stratum, "step").agg(F.count("*").alias("c"))
    below = Window.partitionBy(*stratum).orderBy(F.desc("step"))
    above = Window.partitionBy(*stratum).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    all_of = Window.partitionBy(*stratum)
    upper = F.sum(F.when(F.col("step") < UPPER, F.col("c")).otherwise(0)).over(all_of) + 1
    ranked = counts.select(*stratum, "step", F.sum("c").over(below).alias("rank"), F.sum("c").over(above).alias("kept"), F.sum("c").over(all_of).alias("m"), upper.alias("upper"))
    at = lambda s: F.pow(F.lit(10.0), -s / STEP)
    random = (F.col("upper") + 2 * F.sqrt("upper")) / (1 - at(F.lit(UPPER))) * (1 - at(F.col("step") + 1))
    rejected = F.when(at(F.col("step")) <= alpha * F.col("rank") / F.col("m"), F.col("step"))
    reported = F.when(F.col("kept") - random <= false * F.col("kept"), F.col("step") + 1)
    limits = ranked.groupBy(*stratum).agg(F.min(rejected).alias("rejected"), F.max(reported).alias("reported"))
    limits = limits.select(*stratum, F.least("rejected", F.coalesce("reported", F.lit(0))).alias("limit"))
    # Every stratum has a limit. An outer join, as an inner one would have the long expressions of the tests repeated in filters.
    return marked.join(F.broadcast(limits), stratum, "left").where(F.col("limit").isNull() | (F.col("step") < F.col("limit"))).drop("limit", "octave", "step")


def scan(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, the base spans and all spans as sorted arrays of (start, order, stop, kind)."""
    found = store.written(matches(docs), "secrets")
    random = not_rejected(randomness(parts(found.where((F.col("kind") == 3) & F.col("ok")))))
    base = found.where(F.col("kind").isNull() | ((F.col("kind") < 3))).select("uid", "doc_id", F.when(F.col("ok"), F.col("kind")).alias("kind"), "start", "stop")
    rows = base.unionByName(random.select("uid", "doc_id", F.lit(3).alias("kind"), "start", "stop"))
    # Documents whose only matches are failing ones still need their row.
    rows = rows.unionByName(found.where(F.col("kind") == 3).select("uid", "doc_id", F.lit(None).cast("int").alias("kind"), "start", "stop"))
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", F.col("kind").alias("order"), "stop", name.alias("kind")))
    grouped = rows.groupBy("uid", "doc_id").agg(F.collect_list(span).alias("s"))
    # A random run that is already a base span of the same extent is not told twice.
    before = lambda i: F.get(F.col("ordered"), i - 1)
    fresh = F.filter("ordered", lambda x, i: (x["order"] < 3) | (i == 0) | (before(i)["start"] != x["start"]) | (before(i)["stop"] != x["stop"]))
    return grouped.select("doc_id", F.sort_array("s").alias("ordered")).select("doc_id", F.filter("ordered", lambda x: x["order"] < 3).alias("base"), fresh.alias("spans"))


def _of_kind(k: int):
    return lambda x: x["order"] == k


def _told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *n, F.sha2(_told("base"), 256).alias("base_sha256"), _told("spans").alias("spans"))
