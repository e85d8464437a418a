"""Source trees, rule packs and feeds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scanning import RULES

# Folders that are never read, and the largest file that is.
EXCLUDED = ["node_modules", ".git", "target", "dist", "build", ".next", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache"]
MOST_BYTES = 10_000_000
#: Endings of names that are text, as they are written.
TEXT_EXTENSIONS = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yml", ".yaml", ".toml", ".cfg", ".ini", ".sh", ".bash", ".zsh", ".md", ".rst", ".txt", ".html", ".css", ".scss", ".xml", ".csv", ".env", ".lock",
    ".conf", ".rb", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".hpp", ".cs", ".php", ".pl", ".lua", ".r", ".R", ".swift", ".kt", ".gradle", ".cmake", ".make", ".Makefile",
]


def source_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """path (below root), length, text of the files below root that are text: no excluded folder, no NUL byte, not too large, not ignored.

    ignore: further folder names; rules: as for ignored(). Folders, rules and sizes are tested on the listing, before contents are read into
    columns. Spark's listing passes over names that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), F.concat(F.lit(r"^[a-z]*:?/*\Q"), F.ltrim(base, F.lit("/")), F.lit(r"\E/")), F.lit(""))
    rows = files.withColumn("path", path).where((F.col("length") <= MOST_BYTES) & ~excluded(F.col("path"), ignore or []) & ~ignored(F.col("path"), rules or []))
    return rows.where(~F.contains(F.col("content"), F.lit(b"\x00"))).select("path", "length", F.try_validate_utf8(F.col("content").cast("string")).alias("__ok"), "content").select(
        "path", "length", F.coalesce("__ok", F.make_valid_utf8(F.col("content").cast("string"))).alias("text")
    )


def excluded(path: Column, ignore: list[str]) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), F.array(*[F.lit(x) for x in [*EXCLUDED, *ignore]])) & (F.size(parts) > 1)


def ignore_parts(base: str, line: str) -> tuple[bool, str, bool] | None:
    """(kept, pattern, only folders) of a line of an ignore file that stands in folder base ("" for the root); None for blank lines and comments.

    A leading ! keeps what earlier lines ignored; a trailing slash means folders; a slash elsewhere ties the line to base; * and ? stop at
    slashes, ** does not. The pattern is of a whole path.
    """
    body = line.rstrip()
    if not body or body.startswith("#"):
        return None
    kept, body = body.startswith("!"), body.removeprefix("!")
    folder, body = body.endswith("/"), body.rstrip("/")
    tied, body = "/" in body, body.lstrip("/")
    signs = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]/]+\])", body)
    glob = "".join(signs.get(x) or (x.replace("[!", "[^") if x.startswith("[") else re.escape(x)) for x in parts if x)
    start = "^" + (re.escape(base.rstrip("/") + "/") if base else "")
    return kept, start + ("" if tied else "(?:.*/)?") + glob + "$", folder


def ignore_pattern(base: str, line: str) -> tuple[bool, str] | None:
    """(kept, pattern) of a line as in ignore_parts, for the path of a file; a folder takes all that is below it."""
    found = ignore_parts(base, line)
    return found and (found[0], found[1].removesuffix("$") + ("/.*$" if found[2] else "(?:/.*)?$"))


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether the last of the lines (folder, line) of ignore files that matches a path ignores it."""
    out = F.lit(False)
    for base, line in rules:
        found = ignore_pattern(base, line)
        if found:
            out = F.when(path.rlike(found[1]), not found[0]).otherwise(out)
    return out


def scannable(path: Column, length: Column) -> Column:
    """A known ending of the name, or none and under a million bytes; a dot that opens a name begins no ending."""
    ending = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1)
    return ending.isin(TEXT_EXTENSIONS) | ((ending == "") & (length < 1_000_000))


def rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """The rules of the JSON packs below path; packs that cannot be read are passed over."""
    schema = T.StructType([T.StructField("meta", T.StructType([T.StructField("id", T.StringType()), T.StructField("version", T.StringType())])), T.StructField("rules", T.ArrayType(RULES))])
    packs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return packs.where("rules is not null").select(F.col("meta.id").alias("pack"), F.inline("rules"))


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """Signatures of JSON files that hold a list, or an object with the list under 'signatures'."""
    schema = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "phase", "severity", "pattern", "description")]))
    raw = spark.read.text(path, wholetext=True)
    both = F.coalesce(F.from_json(F.get_json_object("value", "$.signatures"), schema), F.when(F.ltrim("value").startswith("["), F.from_json("value", schema)))
    rows = raw.select(F.inline(both))
    return rows.where("pattern is not null").withColumns({"severity": F.coalesce("severity", F.lit("LOW")), "phase": F.coalesce("phase", F.lit("code_patterns"))})


def kev(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("vulnerabilities array<struct<cveID:string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("vulnerabilities.cveID").alias("cve")).distinct()


def epss(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("data array<struct<cve:string,epss:string>>").option("multiLine", True).json(path)
    return rows.select(F.inline("data")).select("cve", F.expr("try_cast(epss as float)").alias("epss")).where("epss is not null")
