"""Rules over the lines of files. Rules are rows; files are rows of path and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N

FILTER = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("filename_exact", "extensions", "filename_suffix")])
SUPPRESS = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("path_contains", "filename_suffix", "line_contains", "nearby_contains", "file_header_contains", "safe_domains")])
RULES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "phase", "severity", "pattern", "description")] + [T.StructField("weight", T.IntegerType()), T.StructField("file_filter", FILTER), T.StructField("suppress", SUPPRESS)]
)


def lines_of(files: DataFrame, text: str = "text", nearby: int = 3) -> DataFrame:
    """files with line (from 1), body and nearby: the line and the next few, as they are split at line feeds; no empty last line.

    Each file is split in its own row, so lines need no shuffle and no window.
    """
    parts = F.split(F.col(text), "\r?\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    keep = [c for c in files.columns if c != text]
    rows = files.select(*keep, parts.alias("__lines"), F.substring(text, 1, 1024).alias("__header"))
    rows = rows.select(*keep, "__lines", "__header", F.posexplode("__lines").alias("__at", "body"))
    return rows.select(*keep, (F.col("__at") + 1).alias("line"), "body", F.concat_ws("\n", F.slice("__lines", F.col("__at") + 1, nearby + 1)).alias("nearby"), F.col("__header").alias("header"))


def file_allowed(path: Column, rule: dict) -> Column:
    """Whether a rule's file filter lets the path through: no filter, or any of name, extension and suffix."""
    f = rule.get("file_filter") or {}
    name = F.element_at(F.split(path, "/"), -1)
    tests = []
    if f.get("filename_exact"):
        tests.append(name.isin(f["filename_exact"]))
    if f.get("extensions"):
        tests.append(F.element_at(F.split(name, r"\."), -1).isin([e.lstrip(".") for e in f["extensions"]]))
    tests += [name.endswith(s) for s in f.get("filename_suffix") or []]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)


def suppressed(path: Column, body: Column, nearby: Column, header: Column, rule: dict) -> Column:
    s = rule.get("suppress") or {}
    tests = [path.contains(x) for x in s.get("path_contains") or []]
    tests += [path.endswith(x) for x in s.get("filename_suffix") or []]
    tests += [body.contains(x) for x in (s.get("line_contains") or []) + (s.get("safe_domains") or [])]
    tests += [nearby.contains(x) for x in s.get("nearby_contains") or []]
    tests += [header.contains(x) for x in s.get("file_header_contains") or []]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def scan_lines(files: DataFrame, rules: list[dict], path: str = "path", text: str = "text", phases: list[str] | None = None, least_severity: str | None = None) -> DataFrame:
    """One finding for each rule and line that matches: the files' columns, line, rule, phase, severity, weight, snippet.

    Each rule becomes a literal test in one projection, cheap tests before the pattern, so a file is
    read and split once whatever the number of rules, and nothing is shuffled. rules: rows of the
    RULES schema as dictionaries; phases and least_severity drop rules before anything is read.
    """
    from ..functions.severity import RANK

    used = [r for r in rules if (not phases or r["phase"] in phases) and (not least_severity or RANK[r["severity"]] >= RANK[least_severity])]
    rows = lines_of(files, text)
    p, body = F.col(path), F.col("body")
    found = [
        F.when(
            file_allowed(p, r) & body.rlike(r["pattern"]) & ~suppressed(p, body, F.col("nearby"), F.col("header"), r),
            F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["phase"]).alias("phase"), F.lit(r["severity"]).alias("severity"), F.lit(r.get("weight") or 1).alias("weight"), F.lit(r.get("description") or "").alias("description")),
        )
        for r in used
    ]
    keep = [c for c in rows.columns if c not in ("nearby", "header")]
    hits = rows.select(*keep, F.explode(F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<rule:string,phase:string,severity:string,weight:int,description:string>>")).alias("__f"))
    return hits.select(*[c for c in keep if c != "body"], "__f.rule", "__f.phase", "__f.severity", "__f.weight", F.concat_ws(": ", "__f.description", N.snippet(F.col("body"))).alias("snippet"))


def hidden_characters(files: DataFrame, path: str = "path", text: str = "text", name: Column | None = None) -> DataFrame:
    """path, rule, severity, weight, line: the first line with private-use, bidirectional or zero-width characters, one row each. name: the path, where the column is a key of more parts."""
    rows = lines_of(files, text)
    body = F.col("body")
    # a byte order mark may open the file
    marked = F.when(F.col("line") == 1, F.substring(body, 2, 2**31 - 1)).otherwise(body).contains(N.BYTE_ORDER_MARK)
    classes = {"UNICODE-1": body.rlike(f"[{N.PRIVATE}]"), "UNICODE-2": body.rlike(f"[{N.BIDI}]"), "UNICODE-3": body.rlike(f"[{N.ZERO_WIDTH}]|{N.JOINER}") | marked}
    hits = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in classes.items()]))
    first = rows.select(path, "line", F.explode(hits).alias("rule")).groupBy(path, "rule").agg(F.min("line").alias("line"))
    strong = N.is_instruction_file(F.col(path) if name is None else name)
    return first.select(path, "rule", F.when(strong, "HIGH").otherwise("MEDIUM").alias("severity"), F.when(strong, 5).otherwise(2).alias("weight"), "line")


def provenance(files: DataFrame, rules: list[dict], keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """path (or the columns to keep), rule, severity, weight by name and size alone. Kinds: filename_regex, hidden_file, binary_extension, file_size."""
    p = F.col("path")
    name = F.element_at(F.split(p, "/"), -1)
    tests = []
    for r in rules:
        kind = r["kind"]
        if kind == "filename_regex":
            test, weight = name.rlike(r["pattern"]), 3
        elif kind == "hidden_file":
            test, weight = name.startswith(".") & ~name.isin(r.get("excluded_filenames") or [""]), 1
        elif kind == "binary_extension":
            inside = reduce(lambda a, b: a | b, [p.startswith(x) for x in r.get("allowed_path_prefixes") or []], F.lit(False))
            test, weight = name.rlike(r["pattern"]) & ~inside, 2
        else:
            test, weight = F.col("length") > (r.get("size_threshold") or 5_000_000), 1
        tests.append(F.when(test, F.struct(F.lit(r["id"]).alias("rule"), F.lit(r["severity"]).alias("severity"), F.lit(weight).alias("weight"))))
    return files.select(*keep, F.explode(F.array_compact(F.array(*tests))).alias("f")).select(*keep, "f.*")


def tree_provenance(paths: DataFrame) -> DataFrame:
    """tree, rule, severity, weight of paths(tree, path) as a whole: PROV-5 for a shallow clone, PROV-6 for a manifest without a .git folder."""
    has = lambda test: F.bool_or(test)
    p = F.col("path")
    by = paths.groupBy("tree").agg(has(p == ".git/shallow").alias("shallow"), has(p.startswith(".git/") | (p == ".git")).alias("git"), has(p.isin("package.json", "setup.py")).alias("manifest"))
    found = F.when(F.col("shallow"), F.struct(F.lit("PROV-5").alias("rule"), F.lit("LOW").alias("severity"), F.lit(1).alias("weight"))).when(
        ~F.col("git") & F.col("manifest"), F.struct(F.lit("PROV-6").alias("rule"), F.lit("MEDIUM").alias("severity"), F.lit(2).alias("weight"))
    )
    return by.select("tree", found.alias("f")).where("f is not null").select("tree", "f.*")


def first_per_bucket(rows: DataFrame, bucket: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each bucket."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def timeline(changes: DataFrame, key: str, at: str, ties: list[str]) -> DataFrame:
    """changes with position from 1: by the time told as text, which counts as empty where it is missing, so those come first."""
    order = Window.partitionBy(key).orderBy(F.coalesce(at, F.lit("")), *ties)
    return changes.withColumn("position", F.row_number().over(order))


def directory(servers: DataFrame, key: str, page: int) -> DataFrame:
    """The first page by most stars, then least risk, with the position; the limit runs before the window."""
    order = [F.desc("stars"), F.asc("risk_score"), F.asc(key)]
    return servers.orderBy(*order).limit(page).withColumn("position", F.row_number().over(Window.orderBy(*order)))


# Commands that fetch and run code, in the order in which they are tried. A tool and its verbs may be parted by options
# where the third entry says so; the last tells what must follow: a package, a blank, or the end of the word.
BORDER, OPTIONS, PACKAGE, END = r"""(^|[\s;&|("'])""", r"(\s+-\S+(\s+[^-\s]\S*)?)*", r"(\s+-\S+)*\s+[^-\s]", r"(\s|$)"
PIPED = r"(curl|wget)[^|]*\|\s*(sudo\s+)?(\S*/)?(sh|bash|zsh)(\s|$)"
REQUIREMENTS = r"(^|\s)(-r|--requirement)(\s|$)"
COMMANDS = [
    ("deny", "git", True, "clone", END),
    ("deny", "gh", True, r"repo\s+clone", END),
    ("deny", "npm", True, "(install|i|add)", PACKAGE),
    ("ask", "npm", True, "(install|i|add|ci)", END),
    ("deny", "(yarn|pnpm|bun)", True, r"(global\s+)?add", PACKAGE),
    ("ask", "(pnpm|yarn)", True, "dlx", r"\s"),
    ("ask", "(yarn|pnpm)", True, "install", END),
    ("pip", "pip[0-9.]*", True, "install", END),
    ("pip", r"(python[0-9.]*\s+-m|uv)\s+pip", False, "install", END),
    ("deny", "uv", True, "add", PACKAGE),
    ("deny", "cargo", True, "(install|add)", PACKAGE),
    ("deny", "gem", True, "install", PACKAGE),
    ("deny", "go", True, "(install|get)", PACKAGE),
    ("ask", "bundle", False, "install", END),
    ("ask", "(npx|bunx|uvx)", False, None, r"\s"),
    ("ask", "pipx", False, "run", r"\s"),
]


def _invokes(tool: str, options: bool, verb: str | None, end: str) -> str:
    return BORDER + tool + (OPTIONS if options else "") + (r"\s+" + verb if verb else "") + end


def command_decision(command: Column, scanner: str = "vigilake") -> Column:
    """allow, ask or deny: the first rule that matches decides.

    A command that goes through the scanner itself, or sets SCANNER_BYPASS=1 (its name in capitals), is allowed. An
    install of Python packages is asked for where it reads a requirements file or names none, else denied.
    """
    chain = F.when(command.rlike(rf"(^\s*|[;&|]\s*){scanner}\s") | command.rlike(BORDER + scanner.upper() + "_BYPASS=1" + END), "allow")
    chain = chain.when(command.rlike(BORDER + PIPED), "deny")
    for decision, tool, options, verb, end in COMMANDS:
        met = command.rlike(_invokes(tool, options, verb, end))
        if decision == "pip":
            named = command.rlike(_invokes(tool, options, verb, PACKAGE))
            chain = chain.when(met, F.when(named & ~command.rlike(REQUIREMENTS), "deny").otherwise("ask"))
        else:
            chain = chain.when(met, decision)
    return chain.otherwise("allow")


# What a finding's lower-case snippet says of permissions. A category is looked for where its words stand in the
# rule's name (any rule without words); items are what the patterns find, or the one item that stands for any find.
PERMISSIONS = {
    "environment": ([], [r"process\.env\.([a-z_][a-z0-9_]*)", r"os\.environ\[?['\"]([a-z_][a-z0-9_]*)['\"]?\]?", r"getenv\(['\"]([a-z_][a-z0-9_]*)['\"]?\)", r"\$\{?([a-z_][a-z0-9_]*)\}?"]),
    "filesystem": (["file", "path", "directory", "read", "write"], [r"([~/]\S+\.\w+)", r"(/[a-zA-Z0-9/_.-]+)", r"(\./[a-zA-Z0-9/_.-]+)"]),
    "network": (["network", "http", "url", "request"], [r"https?://([^/\s]+)", r"localhost:(\d+)", r":(\d+)"]),
    "process": (["exec", "process", "spawn", "command"], [r"exec\(['\"]([^'\"]+)['\"]", r"spawn\(['\"]([^'\"]+)['\"]", r"system\(['\"]([^'\"]+)['\"]"]),
}
DATABASE_WORDS, DATABASE_ITEM = ["database", "sql", "postgres", "mysql", "mongodb", "redis", "sqlite"], "Database connection required"
CREDENTIALS, CREDENTIALS_ITEM = r"api[_-]?key|access[_-]?token|secret[_-]?key|password|token|credential", "Requires authentication"
PERMISSION_WEIGHTS = {"process": 10, "credentials": 8, "filesystem": 6, "database": 6, "network": 4, "environment": 2}


#: Plain signs of the patterns of PERMISSIONS.
PERMISSION_SIGNS = {p: next(sign for sign in ("process.env", "os.environ", "getenv(", "http", "localhost", "exec(", "spawn(", "system(", "$", ":", "/") if sign in p.replace("\\", "")) for _, patterns in PERMISSIONS.values() for p in patterns}


def _named(category: str, items: Column) -> Column:
    return F.transform(items, lambda item: F.struct(F.lit(category).alias("category"), item.alias("item")))


def permissions(findings: DataFrame) -> DataFrame:
    """scan_id, category, items (sorted, distinct) from the rules and snippets of findings(scan_id, rule, snippet); variables in capitals. Null counts as empty."""
    low, rule = F.lower(F.coalesce("snippet", F.lit(""))), F.lower(F.coalesce("rule", F.lit("")))

    def any_in(text: Column, words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words])

    none = F.array().cast("array<string>")
    found = {}
    for category, (words, patterns) in PERMISSIONS.items():
        # a plain sign that a pattern can't do without is looked for first
        items = F.concat(*[F.when(low.contains(PERMISSION_SIGNS[p]), F.regexp_extract_all(low, F.lit(p), 1)).otherwise(none) for p in patterns])
        found[category] = F.when(any_in(rule, words), items).otherwise(none) if words else F.transform(items, F.upper)
    found["database"] = F.when(any_in(rule, DATABASE_WORDS) | any_in(low, DATABASE_WORDS), F.array(F.lit(DATABASE_ITEM))).otherwise(none)
    found["credentials"] = F.when(low.rlike(CREDENTIALS), F.array(F.lit(CREDENTIALS_ITEM))).otherwise(none)
    pairs = F.flatten(F.array(*[_named(k, v) for k, v in found.items()]))
    rows = findings.select("scan_id", F.explode(pairs).alias("p"))
    return rows.groupBy("scan_id", F.col("p.category").alias("category")).agg(F.array_sort(F.collect_set("p.item")).alias("items"))


def permission_risk(granted: DataFrame) -> DataFrame:
    """scan_id, score, level: weight of the category times its items."""
    from ..functions.severity import lookup

    scored = granted.groupBy("scan_id").agg(F.sum(lookup(F.col("category"), PERMISSION_WEIGHTS, 0) * F.size("items")).cast("long").alias("score"))
    return scored.withColumn("level", F.when(F.col("score") >= 20, "HIGH").when(F.col("score") >= 10, "MEDIUM").otherwise("LOW"))


def policy(findings: DataFrame, stop: list[str]) -> DataFrame:
    """scan_id, network, filesystem, preset, environment: what a scan's verdict and phases allow, and the variables its snippets name."""
    ids = F.array_except(F.regexp_extract_all("snippet", F.lit(r"\b([A-Z][A-Z0-9_]{2,})\b"), 1), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))
    by = findings.groupBy("scan_id").agg(
        F.bool_or(F.col("phase") == "network_exfil").alias("exfil"), F.bool_or(F.col("phase") == "install_hooks").alias("hooks"), F.max(F.col("severity") == "CRITICAL").alias("critical")
    )
    named = findings.select("scan_id", F.explode(ids).alias("v")).distinct().groupBy("scan_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("v"))).alias("environment"))
    return by.join(named, "scan_id", "left").select(
        "scan_id", (~F.col("exfil")).alias("network"), F.when(F.col("hooks"), "read_only").otherwise("workspace").alias("filesystem"),
        F.when(F.col("critical"), "strict").otherwise("standard").alias("preset"), F.coalesce("environment", F.lit("")).alias("environment"),
    )
