"""Repeated-passage removal over overlapping windows of three consecutive lines.

Each line opens a window of itself and the next two. Windows are found again anywhere in the corpus
by two 64-bit hashes; the first one, by doc_id and position, stays, and the lines that any later one
covers go. All steps are DataFrame functions: only hashes and positions are shuffled to find the
repeats, and a window that fills a third of the corpus is reduced on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

SPAN = 3
#: Windows that are told to all tasks.
HOT = 1000


def _windows(docs: DataFrame) -> DataFrame:
    """doc, code, pos, k1, k2 for each window. A text of fewer lines than a window is one window; blank windows are left out."""
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text_of()).alias("code"), F.split(text_of(), "\n").alias("lines"))
    # a line is hashed once, not once in each window; null marks a blank one
    hashed = rows.select(
        "doc", "code",
        F.transform("lines", lambda x: F.when(~F.trim(x).rlike(r"^\s*$"), F.xxhash64(x))).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("b"),
    )

    def window(i):
        a, b = F.slice("a", i + 1, SPAN), F.slice("b", i + 1, SPAN)
        return F.struct(
            i.alias("pos"),
            F.when(F.exists(a, lambda x: x.isNotNull()), F.xxhash64(a)).alias("k1"),
            F.xxhash64(b).alias("k2"),
        )

    starts = F.sequence(F.lit(0), F.greatest(F.size("a") - SPAN, F.lit(0)))
    return (
        hashed.select("doc", "code", F.explode(F.transform(starts, window)).alias("w"))
        .where(F.col("w.k1").isNotNull())
        .select("doc", "code", "w.pos", "w.k1", "w.k2")
    )


def repeated_positions(docs: DataFrame) -> DataFrame:
    """doc, code, gone, mask: for each text that loses lines, their positions from 0 in order, and whether each line up to the last of them goes. code is the text's hash.

    The most frequent windows, at most HOT of them, are told to all tasks; a window that fills a third of the corpus so
    never meets on one key. All others have at most a HOT-th of the windows each.
    """
    windows = _windows(docs)
    place = F.struct("doc", "code", "pos")
    first = cut(windows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "windows")
    hot = first.orderBy(F.desc("n"), "k1", "k2").limit(HOT).select("k1", "k2", F.col("first").alias("hot"))
    known = windows.join(F.broadcast(hot), ["k1", "k2"], "left")
    # keys of the known ones are spread out and meet nothing
    free = F.col("hot").isNull()
    known = known.withColumns({"k1": F.when(free, F.col("k1")).otherwise(F.xxhash64("doc", "code", "pos")), "k2": F.when(free, F.col("k2"))})
    rest = first.join(F.broadcast(hot), ["k1", "k2"], "left_anti").drop("n")
    later = known.join(rest, ["k1", "k2"], "left").where(place > F.coalesce("hot", "first"))
    gone = (
        later.groupBy("doc", "code")
        .agg(F.collect_set("pos").alias("starts"))
        .select("doc", "code", F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + SPAN - 1))))).alias("gone"))
    )
    # covered positions are merged into runs, and runs into one flag a line, so taking lines out is linear
    begins = F.filter("gone", lambda p, i: F.coalesce(F.get("gone", i - 1) != p - 1, F.lit(True)))
    ends = F.filter("gone", lambda p, i: F.coalesce(F.get("gone", i + 1) != p + 1, F.lit(True)))
    runs = gone.select("doc", "code", "gone", begins.alias("begins"), ends.alias("ends"))
    zipped = F.arrays_zip("begins", "ends", F.concat(F.array(F.lit(-1)), F.slice("ends", F.lit(1), F.size("ends") - 1)).alias("before"))
    flags = F.flatten(F.transform(zipped, lambda r: F.concat(F.array_repeat(F.lit(False), r["begins"] - r["before"] - 1), F.array_repeat(F.lit(True), r["ends"] - r["begins"] + 1))))
    return runs.select("doc", "code", "gone", flags.alias("mask"))


def line_dedup(docs: DataFrame, n_lines: str = "n_lines", removed: str = "removed") -> DataFrame:
    """docs with text less its repeated lines, and the columns n_lines and removed (positions from 0, array<int>), under the names given.

    docs(doc_id, text, ...): every other column stays, whatever its name, unless it is called like one of the two
    new ones. A null text counts as empty and has one empty line. Rows that repeat both doc_id and text are one
    document, so they lose nothing to each other; rows with the same id but other texts are ordered
    by the texts' hashes. A null doc_id comes before all others. A text of one or two lines is one
    window and meets only texts that equal it. No input rows give no rows.
    """
    gone = repeated_positions(docs).select(F.col("doc").alias("__doc"), F.col("code").alias("__code"), F.col("gone").alias("__gone"), F.col("mask").alias("__mask"))
    same = docs["doc_id"].eqNullSafe(gone["__doc"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == gone["__code"])
    lines = F.split(text_of(), "\n")
    # the one window of a text of fewer lines covers them all
    missing = F.when(F.col("__gone").isNull(), F.array().cast("array<int>")).when(F.size(lines) < SPAN, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.col("__gone"))
    left = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", F.filter(lines, lambda line, i: ~F.coalesce(F.get("__mask", i), F.lit(False)))))
    return docs.drop(n_lines, removed).join(gone, same, "left").withColumns({n_lines: F.size(lines), removed: missing}).withColumn("text", left).drop("__doc", "__code", "__gone", "__mask")
