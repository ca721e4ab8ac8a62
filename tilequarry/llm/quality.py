"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

A rule is a few named measures and a condition under which it rejects. On a bounded sample (``SAMPLE_ROWS`` texts, taken
evenly from up to ``SAMPLE_FILES`` files) each measure is timed, warm and without the cost of a job, and each rule's
verdicts are taken. Rules are then put in order one by one: next is the rule with the most rejections among what is left
of the sample per second of what it needs and is not yet computed. A rule's measures are computed only for rows that no
earlier rule has rejected. The order changes the work, never the verdict: a document is kept if no rule rejects it.

Defined results: a null or empty text has no words and zero measures, and is rejected by ``few_words``; a null document
id stays null; repeated rows are judged alike; an empty table gives no rows; other columns pass through ``cascade``
untouched unless they bear a measure's name, which is prefixed with ``_q_`` and so does not clash.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SAMPLE_ROWS = 256
SAMPLE_FILES = 8
SAMPLE_CHARS = 1 << 18
PRE = "_q_"
_SPACES = " \t\n\x0b\f\r"
_BULLETS = ("-", "*", "•")


@dataclass
class Rule:
    """Rejects where ``rejects`` holds over the named ``measures``; cost and share are those at its place, by :func:`estimated`."""

    name: str
    measures: list[str]
    rejects: Column
    cost: float = field(default=0.0, compare=False)
    share: float = field(default=0.0, compare=False)


def _m(name: str) -> Column:
    return F.col(PRE + name)


def _ends(line: Column) -> Column:
    return F.endswith(line, F.lit("...")) | F.endswith(line, F.lit("…"))


_K = f"greatest(CAST({PRE}n_words AS int) - 2, 0)"


def _sql(template: str) -> Callable[[], Column]:
    """An expression in which ``{m}`` names the measure m."""
    return lambda: F.expr(re.sub(r"\{(\w+)\}", PRE + r"\1", template))


# Each measure: the measures that it uses, and its expression.
_MEASURES: dict[str, tuple[list[str], Callable[[], Column]]] = {
    "trimmed": ([], lambda: F.btrim(_m("text"), F.lit(_SPACES))),
    "words": (["trimmed"], lambda: F.when(_m("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split(_m("trimmed"), "[ \\t-\\r]+"))),
    "n_words": (["words"], _sql("CAST(size({words}) AS bigint)")),
    "word_chars": (["words"], _sql("CAST(char_length(array_join({words}, '')) AS bigint)")),
    "n_symbols": ([], lambda: sum((F.octet_length(_m("text")) - F.octet_length(F.replace(_m("text"), F.lit(c), F.lit(""))) for c in "#*$%&|<>"), F.lit(0)).cast("long")),
    "lines": ([], lambda: F.filter(F.split(_m("text"), "\n", -1), lambda x: F.btrim(x, F.lit(_SPACES)) != "")),
    "n_lines": (["lines"], _sql("CAST(size({lines}) AS bigint)")),
    "n_dup_lines": (["lines"], _sql("CAST(size({lines}) - size(array_distinct({lines})) AS bigint)")),
    # Windows of three words in order of their words; equal ones stand side by side.
    "sorted": (["words", "n_words"], _sql(f"CASE WHEN {_K} > 0 THEN sort_array(arrays_zip(slice({{words}}, 1, {_K}), slice({{words}}, 2, {_K}), slice({{words}}, 3, {_K}), sequence(0, greatest({_K} - 1, 0)))) END")),
    "places": (["sorted"], lambda: F.sort_array(F.transform(F.filter(_m("sorted"), lambda x, i: ((i > 0) & _same(F.get(_m("sorted"), i - 1), x)) | ((i < F.size(_m("sorted")) - 1) & _same(F.get(_m("sorted"), i + 1), x))), lambda x: x["3"]))),
    "n_repeat_words": (
        ["places"],
        _sql("coalesce(CASE WHEN size({places}) > 0 THEN aggregate({places}, named_struct('n', 0L, 'at', -3), (a, x) -> named_struct('n', a.n + least(3, x - a.at), 'at', x), a -> a.n) END, 0L)"),
    ),
    "n_top": (["words"], _sql("aggregate(sort_array({words}), named_struct('w', '', 'run', 0L, 'most', 0L), (a, x) -> named_struct('w', x, 'run', IF(a.w = x, a.run + 1, 1L), 'most', greatest(a.most, IF(a.w = x, a.run + 1, 1L))), a -> a.most)")),
    "n_letters": (["words"], lambda: F.size(F.filter(_m("words"), lambda x: x.rlike("\\p{L}"))).cast("long")),
    "n_bullets": (["lines"], lambda: F.size(F.filter(_m("lines"), lambda x: F.btrim(x, F.lit(_SPACES)).substr(1, 1).isin(*_BULLETS))).cast("long")),
    "n_cut_lines": (["lines"], lambda: F.size(F.filter(_m("lines"), lambda x: _ends(F.btrim(x, F.lit(_SPACES))))).cast("long")),
}


def _same(a: Column, b: Column) -> Column:
    return (a["0"] == b["0"]) & (a["1"] == b["1"]) & (a["2"] == b["2"])


def default_rules() -> list[Rule]:
    """The base rules (too few words; half of the words in repeated windows) and bounds far outside ordinary prose."""
    w = _m("n_words")
    return [
        Rule("few_words", ["n_words"], w < 50),
        Rule("repeats", ["n_repeat_words"], 100 * _m("n_repeat_words") > 50 * w),
        Rule("symbols", ["n_symbols", "n_words"], 2 * _m("n_symbols") > w),
        Rule("word_length", ["word_chars", "n_words"], (_m("word_chars") < 2 * w) | (_m("word_chars") > 15 * w)),
        Rule("lines", ["n_dup_lines", "n_lines"], 2 * _m("n_dup_lines") > _m("n_lines")),
        Rule("top_word", ["n_top", "n_words"], 100 * _m("n_top") > 30 * w),
        Rule("letters", ["n_letters", "n_words"], 100 * _m("n_letters") < 60 * w),
        Rule("bullets", ["n_bullets", "n_lines"], 100 * _m("n_bullets") > 90 * _m("n_lines")),
        Rule("cut_lines", ["n_cut_lines", "n_lines"], 100 * _m("n_cut_lines") > 30 * _m("n_lines")),
    ]


DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _add(df: DataFrame, names: list[str], done: set[str], when: Column | None = None) -> DataFrame:
    """``df`` with the named measures and what they use; ``when``: only for rows where it holds."""
    for name in names:
        if name not in done:
            uses, expression = _MEASURES[name]
            df = _add(df, uses, done, when)
            df = df.withColumn(PRE + name, expression() if when is None else F.when(when, expression()))
            done.add(name)
    return df


def _closure(names: list[str]) -> set[str]:
    """The named measures and all that they use."""
    out, todo = set(), list(names)
    while todo:
        if (name := todo.pop()) not in out:
            out.add(name)
            todo += _MEASURES[name][0]
    return out


def _sample(docs: DataFrame, rows: int) -> list[str]:
    """Texts of ordinary length from the beginning of a few files that lie evenly in the table."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.char_length("text") < SAMPLE_CHARS)
    files = sorted(docs.inputFiles())
    some = [files[i * len(files) // SAMPLE_FILES] for i in range(SAMPLE_FILES)] if len(files) > SAMPLE_FILES else files
    got: list[str] = []
    if len(some) > 1 and store.is_scan(docs):
        for f in some:
            # A filter on a file's name leaves out all other files before they are read.
            got += [r[0] for r in texts.where(docs.metadataColumn("_metadata")["file_path"] == f).limit(-(-rows // len(some))).collect()]
    return got or [r[0] for r in texts.limit(rows).collect()]


def estimated(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, done: tuple[str, ...] = ()) -> list[Rule]:
    """``rules`` in order, as timed on a sample; the measures ``done`` are computed anyway. Only the order of work depends on it."""
    spark = docs.sparkSession
    sample = spark.createDataFrame([(t,) for t in _sample(docs, sample_rows)], f"{PRE}text string").coalesce(1).cache()
    hits = list(zip(*[[r[0] for r in _add(sample, r.measures, set()).select(F.coalesce(r.rejects, F.lit(False))).collect()] for r in rules]))

    def seconds(name: str | None) -> float:
        def once() -> float:
            began = time.perf_counter()
            (_add(sample, [name], set()).agg(F.max(F.hash(PRE + name))) if name else sample.agg(F.max(F.length(f"{PRE}text")))).collect()
            return time.perf_counter() - began

        return min(once() for _ in range(2))

    # What rules name, and the splits that they share.
    timed = sorted({m for r in rules for m in r.measures} | (_closure([m for r in rules for m in r.measures]) & {"words", "lines"}))
    base = seconds(None)
    cost = {m: max(seconds(m) - base, 1e-4) for m in timed}
    sample.unpersist()
    ordered, known, left = [], _closure(list(done)), set(range(len(hits)))
    todo = list(range(len(rules)))

    def needs(r: Rule) -> float:
        """Seconds of the measures that ``r`` needs over those that it needs and are known."""
        every = _closure(r.measures)
        return max((cost[m] for m in every & cost.keys()), default=0.0) - max((cost[m] for m in every & known & cost.keys()), default=0.0) if every - known else 0.0

    while todo:
        for k in todo:
            rules[k].cost, rules[k].share = max(needs(rules[k]), 1e-6), sum(hits[i][k] for i in left) / max(1, len(hits))
        # Rules that need nothing new come first; a rule that rejects nothing of the sample comes by its cost.
        k = min(todo, key=lambda k: (bool(_closure(rules[k].measures) - known), -rules[k].share / rules[k].cost, rules[k].cost))
        todo.remove(k)
        ordered.append(rules[k])
        known |= _closure(rules[k].measures)
        left = {i for i in left if not hits[i][k]}
    return ordered


def cascade(docs: DataFrame, rules: list[Rule] | None = None, measure_all: bool = False, always: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``_q_kept``, ``_q_rejected_by`` (the first rule in the order chosen) and the measures.

    The measures named in ``always`` are there for every row (with ``measure_all`` all are), the others only for rows that
    no rule before had rejected, and null elsewhere.
    """
    rules = default_rules() if rules is None else rules
    if measure_all:
        always = tuple(m for r in rules for m in r.measures)
    rules = estimated(docs, rules, done=always)
    df = docs.withColumn(f"{PRE}text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    done: set[str] = set()
    df = _add(df, list(always), done)
    # Rules on what is there for every row are one step.
    free = [r for r in rules if set(r.measures) <= done]
    df = df.withColumn(f"{PRE}rejected_by", _once(F.coalesce(*[F.when(r.rejects, r.name) for r in free])) if free else F.lit(None).cast("string"))
    for r in rules[len(free) :]:
        df = _add(df, r.measures, done, _m("rejected_by").isNull())
        df = df.withColumn(f"{PRE}rejected_by", _once(F.coalesce(_m("rejected_by"), F.when(r.rejects, r.name))))
    return df.withColumn(f"{PRE}kept", _once(_m("rejected_by").isNull()))


def _once(c: Column) -> Column:
    """``c``, computed where it stands: the optimizer neither copies a row number into what uses it nor pushes filters
    through it. Copied into one another, the steps of a cascade would be computed again and again."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their own columns."""
    return cascade(docs).where(_m("kept")).select(*[f"`{c}`" for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = cascade(docs, always=DIGEST)
    base = (_m("n_words") < 50) | (100 * _m("n_repeat_words") > 50 * _m("n_words"))
    return judged.select("doc_id", *[_m(c).alias(c) for c in DIGEST], base.alias("base_failed"), _m("kept").alias("kept"))


_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]+"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SPACE_CLASS}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: [w[j], w[j + 1], w[j + 2]])) AS g FROM w),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM r WHERE n > 1) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, coalesce(t.n, 0) AS n_top,
        len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letters,
        len(list_filter(l, lambda x: substr(trim(x, {_SPACES_SQL}), 1, 1) IN ('-', '*', '•'))) AS n_bullets,
        len(list_filter(l, lambda x: ends_with(trim(x, {_SPACES_SQL}), '...') OR ends_with(trim(x, {_SPACES_SQL}), '…'))) AS n_cut_lines
      FROM w LEFT JOIN p ON p.doc_id = w.doc_id
      LEFT JOIN (SELECT doc_id, max(c) AS n FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2) GROUP BY 1) t ON t.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 2 * n_symbols > n_words OR word_chars < 2 * n_words
       OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines OR 100 * n_top > 30 * n_words
       OR 100 * n_letters < 60 * n_words OR 100 * n_bullets > 90 * n_lines OR 100 * n_cut_lines > 30 * n_lines) AS kept
FROM m
"""
