"""Removal of runs of lines that repeat, by winnowing over line hashes.

A text's lines are its pieces between newlines; lines without a word take no
part and always stay.  A line is deleted if it lies in a run of successive lines
with ``WORDS`` words or more in all that has occurred before: in an earlier
document, or earlier in its own without overlap.

1. Winnowing.  The window at a line is the shortest run of lines from it, or up
   to it, with ``WORDS`` words.  Each window's least line hash is a fingerprint;
   only these minima and their places are kept.  Two equal runs of ``WORDS``
   words are guaranteed to share one.
2. Places are joined by fingerprint; those alone with theirs are dropped.
3. Each place left is extended line by line both ways, as far as a window around
   it goes.  Every line of a repeated run lies in a window that starts at it or
   in one that ends at it, so the extended windows of a run cover all of it.
4. Of equal windows around one fingerprint the first in order of document and
   line stays.  The lines of every later one that does not overlap it go.

All steps are aggregates and joins by hash.  A common line or passage is a hot
key only in aggregates, which add up on the map side, and in joins between
checkpointed tables, whose large partitions adaptive execution splits.
Windows are compared by two 64-bit hashes of independent kinds: the window's
and its fingerprint line's.  The lines of a single document are ordered in one
task, however long it is: eight numbers a line, without its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwater.llm.common import checkpointed as saved
from headwater.llm.common import let_go

#: Words that a run holds at least to count as a repeat.
WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: DataFrame, words: int) -> DataFrame:
    """The windows from and up to each of ``lines``: document, first and last line, fingerprint, its place, hash of all lines."""
    document = Window.partitionBy("doc_id", "mark")
    past = document.orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("before", F.coalesce(F.sum("words").over(past), F.lit(0)).cast("long")).withColumn("place", F.row_number().over(document.orderBy("line")))
    placed = placed.withColumn("through", F.col("before") + F.col("words"))
    found = []
    for key, reach in (("before", (0, words - 1)), ("through", (1 - words, 0))):
        run = document.orderBy(key).rangeBetween(*reach)
        window = placed.select(
            "doc_id", "mark", F.min("line").over(run).alias("line"), F.max("line").over(run).alias("end"), F.min("place").over(run).alias("start"),
            F.sum("words").over(run).alias("held"), F.collect_list("hash").over(run).alias("run"),
        )
        window = window.where(F.col("held") >= words).withColumn("print", F.array_min("run"))
        spot = F.col("start") + F.array_position("run", F.col("print")) - 1
        found.append(window.select("doc_id", "mark", "line", "end", "print", spot.alias("spot"), F.xxhash64("run").alias("whole")))
    return found[0].union(found[1])


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, mark, gone``: for each document with deleted lines, their numbers from 0; mark is its text's hash."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    lines = base.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(_lines(F.col("text"))).alias("line", "x"))
    lines = lines.select("doc_id", "mark", "line", F.xxhash64("x").alias("hash"), F.regexp_count("x", F.lit("[^ \\x09-\\x0d]+")).alias("words")).where("words > 0")
    # a row given twice is one document: its lines count once
    lines = saved(lines.repartition("doc_id", "mark").dropDuplicates(["doc_id", "mark", "line"]))
    prints = saved(_windows(lines, words).select("print", "doc_id", "mark", "spot").distinct())
    shared = prints.groupBy("print").count().where("count > 1").select("print")
    places = saved(prints.join(saved(shared), "print", "left_semi"))
    open_ = saved(places.select("doc_id", "mark").distinct())
    own = lines.withColumnsRenamed({"doc_id": "of", "mark": "key"}).join(open_, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("mark")), "left_semi")
    windows = _windows(own.withColumnsRenamed({"of": "doc_id", "key": "mark"}), words).distinct()
    at = places.select(F.col("doc_id").alias("of"), F.col("mark").alias("key"), F.col("spot").alias("here"))
    met = F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("mark")) & (F.col("here") == F.col("spot"))
    # saved, so that the aggregate below deals its rows anew: by fingerprint alone a common line is one task's work
    let_go(docs.sparkSession)
    extended = saved(windows.join(at, met, "left_semi"))
    first = F.min(F.struct("doc_id", "mark", "line", "end")).alias("first")
    known = saved(extended.groupBy("print", "whole").agg(F.count("*").alias("n"), first).where("n > 1").select("print", "whole", "first"))
    found = extended.join(known, ["print", "whole"])
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.mark") == F.col("mark"))
    later = found.where(~same | (F.col("line") > F.col("first.end"))).select("doc_id", "mark", F.explode(F.sequence("line", "end")).alias("line"))
    return later.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("gone"))


def dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """All columns of ``docs`` (doc_id, text), the text without its repeated lines, and ``n_lines`` and ``n_removed`` (long).

    Documents are ordered by doc_id, nulls first, then by their text's hash.  A
    row given several times, with equal doc_id and text, is one document: its
    copies get equal results.  Every row stays: a null text stays null, with 0
    lines, and an empty one empty, with 1; a text all of whose lines repeat
    becomes empty.  A blank line between deleted ones goes with them.  No rows
    give none.  A column of ``docs`` with a new column's name is replaced.
    """
    text = F.col("text").cast("string")
    gone = saved(repeats(docs, words).select(F.col("doc_id").alias("__of"), F.col("mark").alias("__mark"), F.col("gone").alias("__gone")))
    rows = docs.withColumn("__key", F.xxhash64(text))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__of"]) & (rows["__key"] == gone["__mark"]), "left")
    # the array holds the split text once, for the inner function to index
    kept = F.transform(F.array(_lines(text)), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__gone")), lambda i: F.get(x, i)), "\n"))
    return (
        joined.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long"))
        .withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
        .withColumn("text", F.when(F.col("__gone").isNotNull(), kept[0]).otherwise(text))
        .drop("__key", "__of", "__mark", "__gone")
    )
