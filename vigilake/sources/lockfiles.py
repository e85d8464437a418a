"""Components of lockfiles. Frames have path and text; results have path, name, version."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scanning import lines_of


def requirements(files: DataFrame) -> DataFrame:
    """Only == gives a version; blank lines, comments and options are passed over."""
    rows = lines_of(files).select("path", "line", F.regexp_replace("body", r"^\s+|\s+#.*$|\s+$", "").alias("b")).where("b <> '' and b not like '#%' and b not like '-%'")
    name = F.regexp_extract("b", r"^([A-Za-z0-9._-]+)", 1)
    version = F.nullif(F.regexp_extract("b", r"^[^=<>~!;]+==\s*([^\s;,]+)", 1), F.lit(""))
    return rows.where(name != "").select("path", name.alias("name"), version.alias("version"))


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, name, version of all dependencies of dependencies, each file parsed once."""
    for b in batches:
        rows = []
        for path, text in zip(*(c.to_pylist() for c in b.columns)):
            stack = [json.loads(text)]
            while stack:
                for name, own in stack.pop().items():
                    if isinstance(own, dict):
                        rows.append((path, name, own.get("version") if isinstance(own.get("version"), str) else None))
                        if isinstance(own.get("dependencies"), dict):
                            stack.append(own["dependencies"])
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["path", "name", "version"])


def package_lock(files: DataFrame) -> DataFrame:
    """The packages map of versions 2 and 3, or the nested dependencies of version 1, to any depth. Files that cannot be parsed give nothing."""
    plain = "map<string,struct<version:string>>"
    doc = files.select("path", F.from_json(F.get_json_object("text", "$.packages"), plain).alias("packages"), F.get_json_object("text", "$.dependencies").alias("nested"))
    flat = doc.where("packages is not null").select("path", F.explode("packages").alias("k", "v")).where("k <> ''")
    out = flat.select("path", F.element_at(F.split("k", "node_modules/"), -1).alias("name"), F.col("v.version").alias("version"))
    nested = doc.where("packages is null and nested like '{%'").select("path", "nested")
    return out.unionByName(nested.mapInArrow(_nested, "path string, name string, version string"))


def cargo_lock(files: DataFrame) -> DataFrame:
    blocks = files.select("path", F.explode(F.split("text", r"\[\[package\]\]")).alias("b"))

    def value(key):
        return F.nullif(F.regexp_extract("b", rf'(?m)^{key}\s*=\s*"([^"]*)"', 1), F.lit(""))

    return blocks.where(value("name").isNotNull()).select("path", value("name").alias("name"), value("version").alias("version"), value("checksum").alias("checksum"))


def go_mod(files: DataFrame) -> DataFrame:
    """Single and block requires, comments stripped."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)\brequire\s*\((.*?)\)"), 1)
    single = F.regexp_extract_all("text", F.lit(r"(?m)^\s*require\s+([^\s(][^\n]*)$"), 1)
    rows = files.select("path", F.explode(F.split(F.concat_ws("\n", blocks, single), "\n")).alias("b")).select("path", F.regexp_replace("b", r"//.*$|^\s+|\s+$|\s+//.*$", "").alias("b"))
    return rows.where(F.col("b").rlike(r"^\S+\s+v\S+$")).select("path", F.split("b", r"\s+")[0].alias("name"), F.split("b", r"\s+")[1].alias("version"))


def sbom_counts(components: DataFrame) -> DataFrame:
    return components.groupBy("path").agg(F.count("*").alias("components"), F.count_if(F.col("threat_severity").isNotNull()).alias("threats"))
