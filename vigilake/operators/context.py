"""What stands around a finding: strings, comments, definitions and uses, users' own rules, and rescans."""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache, reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.severity import contains_any

QUOTED = r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"
COMMENT = r"/\*[\s\S]*?(?:\*/|$)|//[^\n]*|#[^\n]*"
_DECODE = r"(?:base64\.(?:b64decode|decodebytes)|atob)"
# How wrapped modules, bundles and minified libraries begin, and packages that fill in for old engines.
WRAPPERS = ["typeof exports === 'object' && typeof module !== 'undefined'", "typeof define === 'function' && define.amd", "Function('return this')()", "function (global, factory)", "(function (root, factory)"]
BUNDLES = ["webpackJsonp", "__webpack_require__", "__webpack_modules__", "__webpack_exports__", "webpackChunkName", "webpack/bootstrap", "!function(modules){", "/******/ (function(modules)"]
LIBRARIES = ["/*! jQuery", "/*! React", "/*! Vue", "/*! Angular", "/*! Lodash", '!function(e,t){"use strict"', '!function(e,t){"object"==typeof exports']
POLYFILLS = ["core-js", "@babel", "regenerator-runtime", "tslib", "polyfill-library", "es5-shim", "es6-shim"]
#: The wrapper that does not count where code makes code.
GLOBAL = "Function('return this')()"


def live_calls(text: Column, call: str = r"\beval\s*\(") -> Column:
    """How often the call stands outside of strings and comments.

    One pattern takes strings and comments as whole pieces, so a call inside one is never a piece
    of its own; this replaces a scan of every character with a state.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"{QUOTED}|{COMMENT}|{call}"), F.lit(0))
    return F.size(F.filter(pieces, lambda x: x.rlike(f"^(?:{call})")))


def decode_chain(text: Column) -> Column:
    """Whether a name that is given a decoded value is decoded again further on."""
    return text.rlike(rf"(?s)\b(\w+)\s*=\s*{_DECODE}\s*\(.*?{_DECODE}\s*\([^)]*\b\1\b")


def hex_chain(text: Column) -> Column:
    """Whether a name that is given bytes from hexadecimal digits is decoded further on."""
    return text.rlike(rf"(?s)\b(\w+)\s*=\s*bytes\.fromhex\s*\([^)]+\)\.decode\s*\(\s*\).*?{_DECODE}\s*\(\s*\1\s*\)")


def tainted(text: Column, entries: list[str], sinks: list[str]) -> Column:
    """Whether a name that is given a value from an entry stands after a sink on a later line."""
    entry, sink = "|".join(rf"\Q{e}\E" for e in entries), "|".join(rf"\Q{s}\E" for s in sinks)
    return text.rlike(rf"(?s)\b(\w+)\s*=[^\n]*(?:{entry}).*?(?:{sink})[^\n]*\b\1\b")


def taint_flows(files: DataFrame, entries: list[str], sinks: list[str], sanitizers: list[str]) -> DataFrame:
    """path, entry, sink, sanitized of the flows in files(path, text)."""
    pairs = F.array(*[F.when(tainted(F.col("text"), [e], [s]), F.struct(F.lit(e).alias("entry"), F.lit(s).alias("sink"))) for e in entries for s in sinks])
    return files.where(contains_any(F.col("text"), entries) & contains_any(F.col("text"), sinks)).select("path", F.explode(F.array_compact(pairs)).alias("f"), contains_any(F.col("text"), sanitizers).alias("sanitized")).select("path", "f.*", "sanitized")


def bundled(path: Column, text: Column) -> Column:
    """Built or vendored scripts: known packages below node_modules, wrappers and bundles by their first 1000 characters, and .min.js files by a library's mark in the first 500."""
    low, start = F.lower(path), F.substring(text, 1, 1000)
    vendored = low.contains("node_modules/") & contains_any(low, [f"/{p}/" for p in POLYFILLS])
    wrapped = contains_any(start, [w for w in WRAPPERS if w != GLOBAL]) | (start.contains(GLOBAL) & ~text.rlike(r"\b(macro|__macro__|eval)\b"))
    return vendored | wrapped | contains_any(start, BUNDLES) | (low.endswith(".min.js") & contains_any(F.substring(text, 1, 500), LIBRARIES))


def token_gate(text: Column, tokens: list[str], pattern: str) -> Column:
    """A costly pattern that runs only where a cheap token stands."""
    return contains_any(text, tokens) & text.rlike(pattern)


def without_suppressed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings(pattern_type, rule, file, evidence, ...) that no suppressing rule of apply_user_rules matches; one anti-join, whatever the adjustments."""
    r = rules.where("suppress").select(F.col("pattern_type").alias("__t"), F.col("rule").alias("__r"), "file_pattern", "evidence_pattern")
    hit = (F.col("pattern_type") == F.col("__t")) & (F.col("rule") == F.col("__r")) & F.expr("coalesce(file rlike file_pattern, true) and coalesce(evidence rlike evidence_pattern, true)")
    return findings.join(r, hit, "left_anti")


def apply_user_rules(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings(id, pattern_type, rule, file, evidence, confidence) that no rule suppresses, with confidence adjusted into 0 to 1.

    rules(pattern_type, rule, file_pattern, evidence_pattern, suppress, adjustment): null patterns match anything.
    """
    r = rules.select(F.col("pattern_type").alias("__t"), F.col("rule").alias("__r"), "file_pattern", "evidence_pattern", "suppress", "adjustment")
    hit = (F.col("pattern_type") == F.col("__t")) & (F.col("rule") == F.col("__r")) & F.expr("coalesce(file rlike file_pattern, true) and coalesce(evidence rlike evidence_pattern, true)")
    found = findings.join(r, hit).groupBy("id").agg(F.bool_or("suppress").alias("__s"), F.sum("adjustment").alias("__a"))
    out = findings.join(found, "id", "left").where(~F.coalesce("__s", F.lit(False)))
    return out.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + F.coalesce("__a", F.lit(0.0))))).drop("__s", "__a")


# How far a rule's findings are kept on a rescan.
RESCAN_FACTORS = {"regexp-exec": 0.8, "eval-usage": 0.6, "base64-decode": 0.7, "network-request": 0.5}


def rescan_filter(findings: DataFrame) -> DataFrame:
    """findings(rule, file, severity, confidence, weight, ...) after a rescan: likely false ones go, doubtful ones drop a step."""
    from ..functions.severity import lookup

    quiet = contains_any(F.lower("file"), ["/docs/", "/test/", "/spec/", "readme", ".md"])
    rows = findings.withColumn("__f", F.coalesce(lookup(F.col("rule"), RESCAN_FACTORS), F.lit(1.0)) * F.when(quiet, 0.5).otherwise(1.0)).where("__f > 0.3")
    lower = lookup(F.col("severity"), {"CRITICAL": "HIGH", "HIGH": "MEDIUM", "MEDIUM": "LOW"})
    less = lookup(F.col("confidence"), {"HIGH": "MEDIUM", "MEDIUM": "LOW"})
    doubtful = F.col("__f") <= 0.7
    return rows.withColumns(
        {"severity": F.when(doubtful, F.coalesce(lower, "severity")).otherwise(F.col("severity")), "confidence": F.when(doubtful, F.coalesce(less, "confidence")).otherwise(F.col("confidence")), "weight": F.col("weight") * F.col("__f")}
    ).drop("__f")


def snake_phase(name: Column) -> Column:
    """CamelCase to snake_case."""
    return F.lower(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", "_"))



def stable_id(*parts: Column) -> Column:
    """A UUID from a hash of the parts, and the same for the same parts."""
    h = F.sha2(F.concat_ws(":", *parts), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def iso_week(time: Column) -> Column:
    """Year and week of ISO 8601, as 2026-W09."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), time).cast("int"), F.weekofyear(time))


# What makes a question simple or demanding.
SIMPLE_WORDS = ["is this safe", "what is", "explain", "describe", "list", "show", "tell me", "how many", "yes or no", "true or false", "quick check", "brief", "summary", "basic"]
COMPLEX_WORDS = ["trace", "attack chain", "deep dive", "exhaustive", "comprehensive", "analyze all", "full investigation", "root cause", "exploit chain", "kill chain", "advanced", "detailed analysis", "complete audit"]
COMPLEX_PATTERNS = ["how.*exploit", "trace.*attack", "analyze.*flow", "investigate.*thoroughly", "deep.*analysis", "comprehensive.*review", "full.*audit"]
QUESTIONS = ["why", "how", "analyze", "investigate", "trace"]


def complexity(query: Column, base: Column, findings: Column, files: Column, critical: Column) -> Column:
    """How demanding a question is, 0 to 1, by its words, patterns and length, and the findings, files and critical findings that it is about."""
    low = F.lower(query)

    def found(words):
        return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])

    patterns = reduce(lambda a, b: a + b, [low.rlike(p).cast("int") for p in COMPLEX_PATTERNS])
    words = F.size(F.split(F.trim(query), r"\s+"))
    score = base - 0.1 * found(SIMPLE_WORDS) + 0.2 * found(COMPLEX_WORDS) + 0.15 * patterns + F.when(words < 10, -0.05).when(words > 50, 0.1).otherwise(0.0) + F.when(found(QUESTIONS) >= 2, 0.1).otherwise(0.0) + F.when(findings > 20, 0.1).otherwise(0.0) + F.when(files > 10, 0.05).otherwise(0.0) + F.when(critical > 0, 0.1).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def remediation(violations: DataFrame, top: int = 20) -> DataFrame:
    """The most urgent violations(priority, severity, pattern, file, line), each pattern and file once."""
    from ..functions.severity import RANK, lookup

    order = F.struct("priority", (-lookup(F.col("severity"), RANK, 0)).alias("s"), "line")
    first = violations.groupBy("pattern", "file").agg(F.min(order).alias("o"))
    return first.select("pattern", "file", "o.priority", (-F.col("o.s")).alias("rank"), "o.line").orderBy("priority", F.desc("rank"), "pattern", "file").limit(top)


@lru_cache(1 << 16)
def _items(name: str) -> frozenset[str]:
    """The items of a class, without null."""
    return frozenset(json.dumps(x, sort_keys=True) for x in json.loads(name) if x is not None)


@lru_cache(1 << 16)
def _rounded(share: float) -> float:
    """To six places, halves up, as Spark rounds."""
    return float(Decimal(repr(share)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


class _History:
    """The last few scans of each class of a user, and which classes are alike."""

    def __init__(self, least: float, top: int):
        self.least, self.top = least, top
        self.last: dict[str, deque] = {}
        self.items: dict[str, frozenset[str]] = {}
        self.holding: dict[str, list[str]] = {}
        self.alike: dict[str, list[tuple[float, str]]] = {}

    def near(self, name: str) -> list[tuple[float, str]]:
        """(jaccard, class) of the classes so far that are like this one, the likest first, and it."""
        if name not in self.alike:
            own = _items(name)
            shared = Counter(other for item in own for other in self.holding.get(item, ()))
            self.alike[name] = [(1.0, name)]
            for other, n in shared.items():
                share = n / (len(own) + len(self.items[other]) - n)
                rounded = _rounded(share) if share >= self.least else 0.0
                if rounded > self.least:
                    self.alike[name].append((rounded, other))
                    self.alike[other].append((rounded, name))
                    self.alike[other].sort(reverse=True)
            self.alike[name].sort(reverse=True)
            self.items[name], self.last[name] = own, deque(maxlen=self.top)
            for item in own:
                self.holding.setdefault(item, []).append(name)
        return self.alike[name]

    def best(self, name: str, since: int) -> list[tuple[float, tuple]]:
        """The most similar scans since a day, the latest of equals first; a scan is (number, day, time, id)."""
        out: list[tuple[float, tuple]] = []
        for jaccard, classes in groupby(self.near(name), key=itemgetter(0)):
            some = [scan for _, c in classes for scan in self.last[c] if scan[1] >= since]
            some.sort(key=itemgetter(0), reverse=True)
            out += [(jaccard, scan) for scan in some[: self.top - len(out)]]
            if len(out) == self.top:
                break
        return out


def recent_correlations(scans: DataFrame, days: int = 30, least: float = 0.3, top: int = 5) -> DataFrame:
    """a, b, jaccard: for each scan the most similar earlier ones of the same user in the days before, the latest of equals first; scans have scan_id, user_id, seen_at, items (array).

    Earlier is by time, then by scan_id. Scans of equal items are one class, and only classes are compared. A user's scans of some months, and those of the days
    before, go through a task in their order; of each class the last few are held, so a scan is shuffled once or
    twice, work is in proportion to the scans however many a user has, and a busy user's months are in many tasks.
    """
    rows = scans.select("scan_id", "user_id", "seen_at", F.array_sort(F.array_distinct("items")).alias("items")).where(F.size("items") > 0)
    months, day = 4 * max(days, 1), F.datediff(F.to_date("seen_at"), F.lit("1970-01-01").cast("date"))
    own, last = F.floor(day / months), F.floor((day + days) / months)
    dealt = rows.select("user_id", F.explode(F.sequence(own, last)).alias("months"), "seen_at", "scan_id", day.alias("day"), F.to_json("items").alias("class"))
    kind = scans.schema["scan_id"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("jaccard", T.DoubleType()), T.StructField("then", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, at, number, history, waiting = to_arrow_schema(out), None, None, 0, None, []
        for batch in batches:
            found: list[tuple] = []
            users, spans, times, ids, dates, classes = batch.columns
            times = times.cast(pa.int32() if pa.types.is_date32(times.type) else pa.int64())
            for user, span, time, scan, date, name in zip(*(c.to_pylist() for c in (users, spans, times, ids, dates, classes))):
                if history is None or (user, span) != now:
                    now, at, history, waiting = (user, span), None, _History(least, top), []
                if (time, scan) != at:
                    # Rows of one time and id are not earlier than each other.
                    for held, kept in waiting:
                        history.last[held].append(kept)
                    at, waiting = (time, scan), []
                if date // months == span:
                    found += [(scan, kept[3], jaccard, kept[2]) for jaccard, kept in history.best(name, date - days)]
                else:
                    history.near(name)
                number += 1
                waiting.append((name, (number, date, time, scan)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    met = dealt.repartition("user_id", "months").sortWithinPartitions("user_id", "months", "seen_at", "scan_id").mapInArrow(run, out)
    # A scan has no more than its rows here, unless several have one id.
    order = Window.partitionBy("a").orderBy(F.desc("jaccard"), F.desc("then"), F.desc("b"))
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def improvement(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, improvement: the mean of how many likely false findings went, as a share of all before, and the share of confirmed ones after, from 0 to 1; keys without findings before have 0.

    before and after have key and description, which tells false and confirmed ones.
    """
    def told(rows: DataFrame, name: str) -> DataFrame:
        low = F.lower(F.coalesce("description", F.lit("")))
        return rows.groupBy(key).agg(F.count("*").alias(name), F.count_if(low.contains("false")).alias(f"{name}_false"), F.count_if(low.contains("confirmed")).alias(f"{name}_confirmed"))

    rows = told(before, "b").join(told(after, "a"), key, "full").na.fill(0)
    gone = F.when(F.col("b") > 0, (F.col("b_false") - F.col("a_false")) / F.col("b"))
    sure = F.when(F.col("a") > 0, F.col("a_confirmed") / F.col("a")).otherwise(0.0)
    return rows.select(key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((gone + sure) / 2, F.lit(0.0)))), 6).alias("improvement"))
