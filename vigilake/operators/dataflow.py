"""Values followed through assignments of a file: definitions and uses as rows, chains by repeated joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import contains_any
from ..streaming.runs import shared_path

_NAME = r"\b([A-Za-z_]\w*)\b"


def _any(text: Column, words: list[str]) -> Column:
    """The words that stand in a text."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _after(text: Column, sink: str) -> Column:
    return F.regexp_extract(text, f"{re.escape(sink)}(.*)", 1)


def statements(files: DataFrame, entries: list[str], sinks: list[str]) -> DataFrame:
    """path, line, name, used, entries, sink: a row for each assignment (name, the names its value has, the entries in it) and for each sink on a line (the names behind it).

    files(path, text). An assignment begins its line; comparisons are none.
    """
    rows = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "body")).select("path", (F.col("at") + 1).alias("line"), "body")
    assigned = rows.select("path", "line", F.regexp_extract("body", r"^\s*(?:(?:const|let|var)\s+)?([A-Za-z_]\w*)\s*=(?!=)(.*)$", 1).alias("name"), F.regexp_extract("body", r"^\s*(?:(?:const|let|var)\s+)?[A-Za-z_]\w*\s*=(?!=)(.*)$", 1).alias("value"))
    given = assigned.where("name <> ''").select("path", "line", "name", F.array_distinct(F.regexp_extract_all("value", F.lit(_NAME))).alias("used"), _any(F.col("value"), entries).alias("entries"), F.lit(None).cast("string").alias("sink"))
    ends = F.array_compact(F.array(*[F.when(F.contains("body", F.lit(s)), F.struct(F.lit(s).alias("sink"), _after(F.col("body"), s).alias("rest"))) for s in sinks]))
    met = rows.where(contains_any(F.col("body"), sinks)).select("path", "line", F.explode(ends).alias("e"))
    used = met.select("path", "line", F.lit(None).cast("string").alias("name"), F.array_distinct(F.regexp_extract_all("e.rest", F.lit(_NAME))).alias("used"), F.array().cast("array<string>").alias("entries"), F.col("e.sink").alias("sink"))
    return given.unionByName(used)


def reaching(told: DataFrame) -> DataFrame:
    """path, line, name, sink, source: for each use in statements() the line of the definition that reaches it, the last one of that name on an earlier line."""
    given = told.where("name is not null").select("path", F.col("name").alias("variable"), "line", F.col("line").alias("defined"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("sink"))
    used = told.select("path", F.explode("used").alias("variable"), "line", F.lit(None).cast("int").alias("defined"), "name", "sink")
    before = Window.partitionBy("path", "variable").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)
    both = given.unionByName(used).withColumn("source", F.max("defined").over(before))
    return both.where("defined is null and source is not null").select("path", "line", "name", "sink", "source")


def flows(files: DataFrame, entries: list[str], sinks: list[str], sanitizers: list[str]) -> DataFrame:
    """path, entry, sink, first, last, hops, sanitized: values that come from an entry on line first and stand behind a sink on line last, over so many assignments at least.

    A definition carries on what the definitions carry that reach its value; a later one of the same name ends it. Each round follows all chains by one assignment, in one join, until
    none is longer; sanitized tells whether a sanitizer stands anywhere in the file. Files with one path count as one. Null texts have no flows.
    """
    spark = files.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    told = kept(statements(files.where(contains_any(F.col("text"), entries) & contains_any(F.col("text"), sinks)), entries, sinks), "statements")
    edges = kept(reaching(told), "edges")
    copies = edges.where("sink is null").select("path", F.col("source").alias("at"), F.col("line").alias("to")).distinct()
    new = kept(told.where(F.size("entries") > 0).select("path", F.explode("entries").alias("entry"), F.col("line").alias("first"), F.col("line").alias("at"), F.lit(0).alias("hops")).distinct(), "carried")
    seen, hops = new, 0
    while not new.isEmpty():
        hops += 1
        on = new.join(copies, ["path", "at"]).select("path", "entry", "first", F.col("to").alias("at"), F.lit(hops).alias("hops")).distinct()
        new = kept(on.join(seen.select("path", "entry", "first", "at"), ["path", "entry", "first", "at"], "left_anti"), "carried")
        seen = seen.unionByName(new)
    ends = edges.where("sink is not null").select("path", F.col("source").alias("at"), "sink", F.col("line").alias("last"))
    met = seen.join(ends, ["path", "at"]).groupBy("path", "entry", "sink", "first", "last").agg(F.min("hops").alias("hops"))
    clean = files.groupBy("path").agg(F.bool_or(F.coalesce(contains_any(F.col("text"), sanitizers), F.lit(False))).alias("sanitized"))
    return met.join(clean, "path").select("path", "entry", "sink", "first", "last", "hops", "sanitized")
