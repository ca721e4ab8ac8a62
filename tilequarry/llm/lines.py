"""Removal of lines that match an earlier line, by an exact set-similarity join.

A line's set is that of its distinct five-word shingles (ASCII lower case), a shorter line's the one shingle of all its
words; lines match at Jaccard 0.75 or more. Lines without words are left alone. "Earlier" is by doc_id, then by the row's
and the line's place.

The join is that of :mod:`jaccard` over lines as rows: equal sets are found by digest and all but the earliest go;
shingles are ordered by rarity over the whole corpus; a set's prefix meets others in an inverted index; pairs are cut by
the length and positional filters and what remains is verified by counting. Each line is first compared with the
earliest member that most of its lists share; lines that match it are done. Only the others are compared with all
earlier members of their lists, so a group of near copies costs one comparison a line.

Defined results: a null text stays null and has no lines; an empty text has one empty line; repeated rows lose their
later lines; a null doc_id sorts first; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .jaccard import N, Threshold, _only, index_lists, overlaps, references, survey

FEW_BYTES = 1 << 25


def _lines(rows: DataFrame) -> DataFrame:
    """doc_id, text (of a line), uid (of a line: its row's number and its place there), row, line."""
    text = F.col("text").cast("string")
    most = rows.agg(F.max(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))), F.max("row")).first()
    bits = (most[0] or 0).bit_length()
    if bits + (most[1] or 0).bit_length() > 63:
        raise ValueError(f"{most[1]} rows of up to {most[0]} lines cannot be numbered")
    split = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.posexplode(F.split(text, "\n", -1)).alias("line", "text"))
    line = F.col("line").cast("long")
    return split.select("doc_id", "text", (F.shiftleft("row", bits) + line).alias("uid"), "row", line.alias("line"))


def later_lines(rows: DataFrame, limit: Threshold | None = None, n: int = N) -> DataFrame:
    """row, line of every line of ``rows`` (doc_id, text, row) that matches an earlier one."""
    limit = limit or Threshold()
    lines = _lines(rows)
    sets, rarity = survey(lines, n, 1, ("row", "line"))
    held = sets.where("n > 0")
    doc = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first = store.written(held.groupBy("sig1", "sig2", "n").agg(F.min(F.struct(doc.alias("doc"), "uid")).alias("p")).select(F.col("p.uid").alias("uid")), "earliest")
    equal = store.written(held.join(first, "uid", "left_anti").select("uid", "row", "line"), "equal")
    distinct = _only(lines.select("doc_id", "text", "uid"), equal.select("uid"), "left_anti")
    lists = store.written(index_lists(distinct, rarity, limit, n), "lists")
    match = F.col("o") * (limit.num + limit.den) >= F.lit(limit.num) * (F.col("na") + F.col("nb"))
    best = references(lists, limit)
    compared = store.written(overlaps(best, lines.select("doc_id", "text", "uid"), n).withColumn("match", match), "compared")
    done = compared.where("match").select(F.col("a").alias("uid"))
    need = F.ceil(F.lit(limit.num) * (F.col("x.n") + F.col("y.n")) / F.lit(limit.num + limit.den) - F.lit(1e-9))
    # A list's first member has nothing before it there.
    x, y = lists.where("uid <> first").join(done, "uid", "left_anti").alias("x"), lists.alias("y")
    earlier = (F.col("y.doc") < F.col("x.doc")) | ((F.col("y.doc") == F.col("x.doc")) & (F.col("y.uid") < F.col("x.uid")))
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    sizes = (F.col("x.n") * limit.den >= F.col("y.n") * limit.num) & (F.col("y.n") * limit.den >= F.col("x.n") * limit.num)
    open_pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & earlier & sizes & (left >= need))
    open_pairs = open_pairs.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    rest = store.written(open_pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "open")
    more = overlaps(rest, lines.select("doc_id", "text", "uid"), n).where(match).select(F.col("a").alias("uid"))
    near = done.unionByName(more).distinct()
    return equal.select("row", "line").unionByName(held.join(near, "uid", "left_semi").select("row", "line"))


def _marks(gone: DataFrame) -> DataFrame:
    """_l_row, _l_marks: a byte for each line up to the last removed one, 1 where it goes, so that a line is looked up in
    constant time; and how many go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for places in b.column(1).to_pylist():
                m = bytearray(max(places) + 1)
                for k in places:
                    m[k] = 1
                marks.append(bytes(m))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks, pa.binary())], ["_l_row", "_l_marks"])

    listed = gone.groupBy(F.col("row").alias("_l_row")).agg(F.collect_set("line").alias("lines"))
    return listed.mapInArrow(run, "_l_row long, _l_marks binary")


def with_marks(docs: DataFrame, limit: Threshold | None = None, n: int = N) -> DataFrame:
    """``docs`` and ``_l_marks`` (null: no line goes)."""
    told = store.numbered(docs, "_l_row")
    gone = store.written(_marks(later_lines(told.select("doc_id", "text", F.col("_l_row").alias("row")), limit, n)), "gone")
    # The marks are broadcast only where their bytes are counted to be few.
    few = (gone.agg(F.sum(F.length("_l_marks") + 64)).first()[0] or 0) <= FEW_BYTES
    return told.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), "_l_row", "left").drop("_l_row")


def _count(marks: Column) -> Column:
    """How many lines are marked: of the digits of 01 and 00, the ones."""
    return F.length(F.regexp_replace(F.hex(marks), "00|0(?=1)", ""))


def _kept(text: Column, marks: Column) -> Column:
    """``text`` without its marked lines."""
    stays = F.filter(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.substring(marks, i + 1, 1) != F.lit(b"\x01"), F.lit(True)))
    return F.when(marks.isNull(), text).otherwise(F.array_join(stays, "\n"))


def without_later_lines(docs: DataFrame, limit: Threshold | None = None, n: int = N) -> DataFrame:
    """``docs`` with those lines taken out of ``text``; ``n_chars``, where there is one, follows the text."""
    kept = with_marks(docs, limit, n).withColumn("text", _kept(F.col("text"), F.col("_l_marks")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the SHA-256 of what is kept (lines joined by a line feed)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = with_marks(docs)
    text = F.col("text")
    return told.select(
        "doc_id",
        F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(_count(F.col("_l_marks")), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.encode(_kept(text, F.col("_l_marks")), "utf-8"), 256).alias("kept_sha256"),
    )
