"""Queries over the context of findings, users' rules, signatures and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import severity as S
from ..operators import context as C
from ..operators import registry
from .inputs import frame, read, source

FINDINGS, SCANS, USAGE, TOOLS, SUBS = (source(n) for n in ("findings", "scans", "usage", "tools", "subscriptions"))
CODE = [
    "x = eval(y)", "s = 'eval(y)'", "// eval(y)", "/* eval( */ eval(z)", "a = atob(b)\nc = atob(a)", "q = input()\nprint(1)\neval(q)", "q = input()\neval(escape(q))",
    "h = bytes.fromhex('00').decode()\nbase64.b64decode(h)", "p = \"it's\" + eval(k) + `eval(`", "# eval(x)\nf = 1",
]
LIVE = [1, 0, 0, 1, 0, 1, 1, 0, 1, 0]


def _code(spark, sf):
    pick = F.element_at(F.array(*[F.lit(c) for c in CODE]), (F.col("event_id") % len(CODE) + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", F.concat(F.lit("f"), (F.col("event_id") % len(CODE)).cast("string")).alias("path"), pick.alias("text"))


def p16_live_calls(spark, sf):
    return _code(spark, sf).groupBy("path", C.live_calls(F.col("text")).alias("live")).agg(F.count("*").alias("n"))


def p21_chains(spark, sf):
    return _code(spark, sf).groupBy("path", C.decode_chain(F.col("text")).alias("decoded"), C.hex_chain(F.col("text")).alias("hexed")).agg(F.count("*").alias("n"))


def p33_taint(spark, sf):
    return C.taint_flows(_code(spark, sf), ["input()"], ["eval("], ["escape("]).groupBy("path", "entry", "sink", "sanitized").agg(F.count("*").alias("n"))


#: Paths and texts of scripts, and whether they are built or vendored.
BUILT = [
    ("a.min.js", "/*! jQuery v3", True), ("b.min.js", "steal()", False), ("c.min.js", "x" * 500 + "/*! React", False), ("d.js", "/*! Vue", False), ("e.js", "x = __webpack_require__(1)", True),
    ("f.js", "y" * 1000 + "webpackJsonp", False), ("g.js", "(function (root, factory) {", True), ("h.js", "Function('return this')()", True), ("i.js", "Function('return this')(); eval(x)", False),
    ("NODE_MODULES/core-js/i.js", "", True), ("node_modules/tslib/x.js", "", True), ("node_modules/evil/x.js", "", False), ("core-js/x.js", "", False), ("j.MIN.JS", '!function(e,t){"use strict"', True),
]


def p17_p22_bundled(spark, sf):
    path, text = _picked([p for p, _, _ in BUILT], "tool_id"), _picked([t for _, t, _ in BUILT], "tool_id")
    return frame(spark, sf, "tools").select("tool_id", C.bundled(path, text).alias("bundled"), F.col("name").rlike(r"^(red|blue)-").alias("named"))


def _picked(items, by):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.col(by) % len(items) + 1).cast("int"))


def p34_user_rules(spark, sf):
    rules = spark.createDataFrame([("code_patterns", "R-1", None, None, True, 0.0), ("code_patterns", "R-2", r"\.md$", None, False, -0.3), ("code_patterns", "R-2", None, "HIGH", False, 0.25), ("network_exfil", "R-4", "main", "LOW", True, 0.0)], "pattern_type string, rule string, file_pattern string, evidence_pattern string, suppress boolean, adjustment double")
    kept = C.apply_user_rules(frame(spark, sf, "findings").select(F.concat_ws("/", "scan_id", "line", "rule", "file", "phase", "severity", "weight").alias("id"), F.col("phase").alias("pattern_type"), "rule", "file", F.col("severity").alias("evidence"), (F.col("weight") / 4).alias("confidence")).dropDuplicates(["id"]), rules)
    return kept.groupBy("rule", F.round("confidence", 4).alias("confidence")).agg(F.count("*").alias("n"))


def p44_rescan_filter(spark, sf):
    rule = F.expr("case cast(substr(rule, 3) as int) % 6 when 0 then 'regexp-exec' when 1 then 'eval-usage' when 2 then 'base64-decode' when 3 then 'network-request' else 'other' end")
    rows = frame(spark, sf, "findings").select(rule.alias("rule"), "file", "severity", F.when(F.col("scan_id") % 2 == 0, "HIGH").otherwise("MEDIUM").alias("confidence"), F.col("weight").cast("double").alias("weight"))
    return C.rescan_filter(rows).groupBy("rule", "severity", "confidence").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def p45_normalized(spark, sf):
    name = F.expr("case phase when 'install_hooks' then 'InstallHooks' when 'code_patterns' then 'CodePatterns' else 'NetworkExfil' end")
    return frame(spark, sf, "findings").groupBy(C.snake_phase(name).alias("phase"), F.upper(F.lower("severity")).alias("severity")).agg(F.count("*").alias("n"))


def risk_rules(spark, sf):
    rows = frame(spark, sf, "findings").groupBy("scan_id").agg(*[F.array_sort(F.collect_set(F.when(c, v))).alias(n) for n, c, v in (("code", F.col("phase") == "code_patterns", F.col("rule")), ("risks", F.col("severity").isin("MEDIUM", "HIGH", "CRITICAL"), F.col("rule")))])
    return rows.select("scan_id", F.array_join("code", ",").alias("code"), F.array_join("risks", ",").alias("risks"))


def p47_capabilities(spark, sf):
    return frame(spark, sf, "subscriptions").groupBy("plan").agg(F.count("*").alias("n")).select("plan", S.lookup(F.col("plan"), {"free": 50, "pro": 500, "team": 2000, "enterprise": 1_000_000}, 0).alias("scans"), F.col("plan").isin("team", "enterprise").alias("shared"), "n")


def identifiers(spark, sf):
    return frame(spark, sf, "tools").select("tool_id", C.stable_id(F.col("ecosystem"), F.col("name")).alias("uuid"), C.slug(F.concat(F.lit("--"), "name", F.lit(" (x)!"))).alias("slug"))


def iso_weeks(spark, sf):
    return frame(spark, sf, "scans").groupBy(C.iso_week(F.col("scanned_at")).alias("week")).agg(F.count("*").alias("scans"))


def complexity_scores(spark, sf):
    rows = frame(spark, sf, "tools").select("tool_id", F.expr("concat(case tool_id % 5 when 0 then 'Why and how did we investigate ' when 1 then 'list ' when 2 then 'Trace the root cause of ' when 3 then 'Explain how to exploit, with a full audit of ' else '' end, description)").alias("q"))
    return rows.select("tool_id", C.complexity(F.col("q"), F.lit(0.5), F.col("tool_id") % 30, F.col("tool_id") % 13, F.col("tool_id") % 3).alias("score"))


def t8_remediation(spark, sf):
    rows = frame(spark, sf, "findings").select((F.col("scan_id") % 3 + 1).alias("priority"), "severity", F.col("rule").alias("pattern"), "file", F.coalesce("line", F.lit(0)).alias("line"))
    return C.remediation(rows)


def j30_r8_u6_correlations(spark, sf):
    rows = frame(spark, sf, "scans").select("scan_id", "user_id", F.col("scanned_at").alias("seen_at"), F.expr("array(concat('v', verdict), concat('e', ecosystem), concat('f', cast(findings_count % 5 as string)))").alias("items"))
    return C.recent_correlations(rows)


def a38_signature_stats(spark, sf):
    out = frame(spark, sf, "findings").select("rule", "severity", "phase").distinct().groupingSets([("severity",), ("phase",)], "severity", "phase").agg(F.grouping("severity").alias("g"), F.count("*").alias("n"))
    return out.select(F.when(F.col("g") == 0, "severity").otherwise("phase").alias("by"), F.coalesce("severity", "phase").alias("value"), "n")


def a39_r15_u4_signature_merge(spark, sf):
    built = frame(spark, sf, "findings").groupBy(F.col("rule").alias("id")).agg(F.max("found_at").alias("updated_at"), F.max("severity").alias("severity"))
    own = frame(spark, sf, "findings").where("scan_id % 10 = 0").groupBy(F.col("rule").alias("id")).agg(F.min("found_at").alias("updated_at"), F.min("severity").alias("severity")).where("id < 'R-15'")
    return built.join(own.select("id"), "id", "left_anti").withColumn("origin", F.lit("built")).unionByName(own.withColumn("origin", F.lit("own"))).where("updated_at >= timestamp_ntz'1995-02-01 00:00:00'")


def a40_malicious_authors(spark, sf):
    rows = frame(spark, sf, "scans").where("verdict = 'CRITICAL_RISK'").select("user_id", "package").distinct()
    return rows.groupBy("user_id").agg(F.count("*").alias("packages"), F.array_join(F.array_sort(F.collect_list("package")), ",").alias("names"))


def a45_w12_drift(spark, sf):
    s = frame(spark, sf, "scans")
    last = registry.latest_scan(s).select("ecosystem", "package", F.col("verdict").alias("now"))
    first = s.groupBy("ecosystem", "package").agg(F.min(F.struct("scanned_at", "scan_id", "verdict")).alias("f")).select("ecosystem", "package", F.col("f.verdict").alias("before"))
    return first.join(last, ["ecosystem", "package"]).groupBy("before", "now", F.col("before").eqNullSafe(F.col("now")).alias("same")).agg(F.count("*").alias("packages"))


def a34_timespan(spark, sf):
    return frame(spark, sf, "scans").groupBy("user_id").agg(F.datediff(F.max("scanned_at"), F.min("scanned_at")).alias("days"), F.round(F.avg("confidence") * F.least(F.count("*") / 5, F.lit(1.0)), 4).alias("strength"))


def a61_weighted_trust(spark, sf):
    got = frame(spark, sf, "findings").groupBy("scan_id").agg((F.sum(S.lookup(F.col("severity"), S.CLI_SEVERITY, 0) * F.col("weight")) * 20).alias("s"), F.sum("weight").alias("w"))
    return got.select("scan_id", F.when(F.col("w") == 0, 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.col("s") / F.col("w"))))).cast("int").alias("trust"))


def a59_improvement(spark, sf):
    said = F.expr("case weight when 1 then 'Likely FALSE positive' when 2 then 'Confirmed threat' else 'Unclear' end")
    rows = frame(spark, sf, "findings").select((F.col("scan_id") % 5000).alias("scan_id"), "line", said.alias("description"))
    return C.improvement(rows.where("line is null or line < 5"), rows.where("line > 2 and scan_id % 9 > 0"), "scan_id")


def j21_j31_recent_threats(spark, sf):
    s = frame(spark, sf, "scans")
    campaigns = s.where("scan_id % 5 = 0").groupBy("user_id").agg(F.count("*").alias("campaign"))
    return s.where("verdict = 'CRITICAL_RISK' and scanned_at >= timestamp_ntz'2001-07-03 00:00:00'").join(campaigns, "user_id", "left").select("scan_id", "user_id", "campaign")


def j28_false_positives(spark, sf):
    f, s = frame(spark, sf, "findings"), frame(spark, sf, "scans")
    return f.join(s.select("scan_id", "scanner"), "scan_id").groupBy("scanner").agg(F.count_distinct(F.when(F.col("severity") == "CRITICAL", F.col("scan_id"))).alias("critical"), F.count_distinct(F.when(F.col("severity") == "LOW", F.col("scan_id"))).alias("low"), F.count("*").alias("findings"))


def t2_ecosystem_list(spark, sf):
    rows = frame(spark, sf, "scans")
    pages = [registry.ecosystem_page(rows, "npm", mode, 2, 25).withColumn("mode", F.lit(mode)) for mode in registry.LIST_ORDERS]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).select("mode", "position", "scan_id", "package", "has_more")


def t6_pending_rescans(spark, sf):
    rank = S.lookup(F.col("verdict"), {"CRITICAL_RISK": 1, "HIGH_RISK": 2, "MEDIUM_RISK": 3}, 4)
    return frame(spark, sf, "scans").where("scanner like '1.%'").select("scan_id", "verdict", rank.alias("rank")).orderBy("rank", "scan_id").limit(80)


def t14_newest_then_filter(spark, sf):
    newest = frame(spark, sf, "scans").orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(200)
    rows = newest.select("scan_id", "scanned_at", F.explode(F.expr("sequence(1, findings_count % 3 + 1)")).alias("k")).where("k > 1")
    return rows.orderBy(F.desc("scanned_at"), F.desc("scan_id"), "k").limit(30).select("scan_id", "k")


def s15_select(spark, sf):
    return frame(spark, sf, "scans").where("ecosystem = 'pypi' and verdict = 'LOW_RISK'").orderBy(F.desc("risk_score"), "scan_id").offset(5).limit(25).select("scan_id", "risk_score")


def s16_parameters(spark, sf):
    return spark.sql("SELECT user_id, count(*) AS n FROM {u} WHERE kind = :kind AND tokens >= :least GROUP BY user_id", args={"kind": "click", "least": 50}, u=frame(spark, sf, "usage"))


def s23_cache_prune(spark, sf):
    return frame(spark, sf, "scans").where("scanner = '2.1.0'").select(F.substring(F.sha2(F.concat_ws("|", "package", "version"), 256), 1, 16).alias("key"), "scanned_at", "scan_id").orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(100).select("key", "scan_id")


def r12_scheduler(spark, sf):
    due = registry.rescan_due(frame(spark, sf, "scans"), F.expr("timestamp_ntz'2001-08-02 00:00:00'"))
    return due.groupBy("ecosystem").agg(F.count("*").alias("due"), F.max("days").alias("oldest"))


_PARTS = f"(VALUES {', '.join(f'({k}, {n})' for k, n in enumerate(LIVE))}) c(k, live)"
_N = len(CODE)
_FILE_RULES = "CASE WHEN file LIKE '%.md' THEN -0.3::DOUBLE ELSE 0 END + CASE WHEN severity = 'HIGH' THEN 0.25::DOUBLE ELSE 0 END"
_FACTOR = "CASE CAST(substr(rule, 3) AS INTEGER) % 6 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 1 END * CASE WHEN lower(file) LIKE '%readme%' OR lower(file) LIKE '%.md%' THEN 0.5::DOUBLE ELSE 1 END"

QUERIES = {
    "p16_live_calls": (p16_live_calls, f"SELECT 'f' || CAST(k AS VARCHAR) AS path, CAST(live AS INTEGER) AS live, count(*) AS n FROM events JOIN {_PARTS} ON event_id % {_N} = k GROUP BY 1, 2"),
    "p21_chains": (p21_chains, f"SELECT 'f' || CAST(event_id % {_N} AS VARCHAR) AS path, event_id % {_N} = 4 AS decoded, event_id % {_N} = 7 AS hexed, count(*) AS n FROM events GROUP BY 1, 2, 3"),
    "p33_taint": (p33_taint, f"SELECT 'f' || CAST(event_id % {_N} AS VARCHAR) AS path, 'input()' AS entry, 'eval(' AS sink, event_id % {_N} = 6 AS sanitized, count(*) AS n FROM events WHERE event_id % {_N} IN (5, 6) GROUP BY 1, 4"),
    "p17_p22_bundled": (p17_p22_bundled, f"SELECT tool_id, tool_id % {len(BUILT)} IN ({', '.join(str(k) for k, (_, _, b) in enumerate(BUILT) if b)}) AS bundled, starts_with(name, 'red-') OR starts_with(name, 'blue-') AS named FROM {TOOLS}"),
    "p34_user_rules": (
        p34_user_rules,
        f"""WITH d AS (SELECT DISTINCT scan_id, line, rule, file, phase, severity, weight FROM {FINDINGS})
SELECT rule, round(CASE WHEN phase = 'code_patterns' AND rule = 'R-2' THEN greatest(0, least(1, weight / 4::DOUBLE + {_FILE_RULES})) ELSE weight / 4::DOUBLE END, 4) AS confidence, count(*) AS n FROM d
WHERE NOT (phase = 'code_patterns' AND rule = 'R-1') AND NOT (phase = 'network_exfil' AND rule = 'R-4' AND contains(file, 'main') AND severity = 'LOW') GROUP BY 1, 2""",
    ),
    "p44_rescan_filter": (
        p44_rescan_filter,
        f"""WITH r AS (SELECT CASE CAST(substr(rule, 3) AS INTEGER) % 6 WHEN 0 THEN 'regexp-exec' WHEN 1 THEN 'eval-usage' WHEN 2 THEN 'base64-decode' WHEN 3 THEN 'network-request' ELSE 'other' END AS rule, severity, scan_id, weight, {_FACTOR} AS f FROM {FINDINGS})
SELECT rule, CASE WHEN f <= 0.7::DOUBLE THEN CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LOW' ELSE severity END ELSE severity END AS severity,
 CASE WHEN f <= 0.7::DOUBLE THEN CASE WHEN scan_id % 2 = 0 THEN 'MEDIUM' ELSE 'LOW' END ELSE CASE WHEN scan_id % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END END AS confidence, count(*) AS n, round(sum(weight * f), 4) AS weight FROM r WHERE f > 0.3::DOUBLE GROUP BY 1, 2, 3""",
    ),
    "p45_normalized": (p45_normalized, f"SELECT phase, severity, count(*) AS n FROM {FINDINGS} GROUP BY 1, 2"),
    "risk_rules": (
        risk_rules,
        f"SELECT scan_id, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (phase = 'code_patterns'), '') AS code, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (severity <> 'LOW'), '') AS risks FROM {FINDINGS} GROUP BY 1",
    ),
    "p47_capabilities": (p47_capabilities, f"SELECT plan, CAST(CASE plan WHEN 'free' THEN 50 WHEN 'pro' THEN 500 WHEN 'team' THEN 2000 ELSE 1000000 END AS INTEGER) AS scans, plan IN ('team', 'enterprise') AS shared, count(*) AS n FROM {SUBS} GROUP BY plan"),
    "identifiers": (
        identifiers,
        f"SELECT tool_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid, slug FROM (SELECT tool_id, sha256(ecosystem || ':' || name) AS h, trim(regexp_replace(lower('--' || name || ' (x)!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {TOOLS})",
    ),
    "iso_weeks": (iso_weeks, f"SELECT strftime(scanned_at, '%G-W%V') AS week, count(*) AS scans FROM {SCANS} GROUP BY 1"),
    "complexity_scores": (
        complexity_scores,
        f"""WITH q AS (SELECT tool_id, tool_id % 5 AS k, CASE tool_id % 5 WHEN 0 THEN 'Why and how did we investigate ' WHEN 1 THEN 'list ' WHEN 2 THEN 'Trace the root cause of ' WHEN 3 THEN 'Explain how to exploit, with a full audit of ' ELSE '' END || description AS q FROM {TOOLS})
SELECT tool_id, round(greatest(0, least(1, 0.5::DOUBLE + CASE k WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN -0.1::DOUBLE WHEN 2 THEN 0.4::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(string_split(q, ' ')) < 10 THEN -0.05::DOUBLE ELSE 0 END + CASE WHEN tool_id % 30 > 20 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN tool_id % 13 > 10 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN tool_id % 3 > 0 THEN 0.1::DOUBLE ELSE 0 END)), 6) AS score FROM q""",
    ),
    "t8_remediation": (
        t8_remediation,
        f"""WITH v AS (SELECT scan_id % 3 + 1 AS priority, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS rank, rule AS pattern, file, coalesce(line, 0) AS line FROM {FINDINGS})
SELECT pattern, file, priority, CAST(rank AS INTEGER) AS rank, line FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pattern, file ORDER BY priority, rank DESC, line) = 1) ORDER BY priority, rank DESC, pattern, file LIMIT 20""",
    ),
    "j30_r8_u6_correlations": (
        j30_r8_u6_correlations,
        f"""WITH s AS (SELECT * FROM {SCANS}), p AS (SELECT x.scan_id AS a, y.scan_id AS b, y.scanned_at AS t, (x.verdict = y.verdict)::INT + (x.ecosystem = y.ecosystem)::INT + (x.findings_count % 5 = y.findings_count % 5)::INT AS s FROM s x JOIN s y ON x.user_id = y.user_id AND (y.scanned_at, y.scan_id) < (x.scanned_at, x.scan_id) AND date_diff('day', CAST(y.scanned_at AS DATE), CAST(x.scanned_at AS DATE)) <= 30)
SELECT a, b, round(s / CAST(6 - s AS DOUBLE), 6) AS jaccard FROM p WHERE s / CAST(6 - s AS DOUBLE) > 0.3::DOUBLE QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, t DESC, b DESC) <= 5""",
    ),
    "a38_signature_stats": (a38_signature_stats, f"WITH d AS (SELECT DISTINCT rule, severity, phase FROM {FINDINGS}) SELECT 'severity' AS by, severity AS value, count(*) AS n FROM d GROUP BY severity UNION ALL SELECT 'phase', phase, count(*) FROM d GROUP BY phase"),
    "a39_r15_u4_signature_merge": (
        a39_r15_u4_signature_merge,
        f"""WITH b AS (SELECT rule AS id, max(found_at) AS updated_at, max(severity) AS severity FROM {FINDINGS} GROUP BY 1), o AS (SELECT rule AS id, min(found_at) AS updated_at, min(severity) AS severity FROM {FINDINGS} WHERE scan_id % 10 = 0 AND rule < 'R-15' GROUP BY 1)
SELECT * FROM (SELECT *, 'built' AS origin FROM b WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT *, 'own' FROM o) WHERE updated_at >= TIMESTAMP '1995-02-01 00:00:00'""",
    ),
    "a40_malicious_authors": (a40_malicious_authors, f"SELECT user_id, count(DISTINCT package) AS packages, string_agg(DISTINCT package, ',' ORDER BY package) AS names FROM {SCANS} WHERE verdict = 'CRITICAL_RISK' GROUP BY 1"),
    "a45_w12_drift": (
        a45_w12_drift,
        f"WITH d AS (SELECT arg_min(verdict, (scanned_at, scan_id)) AS before, arg_max(verdict, (scanned_at, scan_id)) AS now FROM {SCANS} GROUP BY ecosystem, package) SELECT before, now, before = now AS same, count(*) AS packages FROM d GROUP BY 1, 2, 3",
    ),
    "a34_timespan": (a34_timespan, f"SELECT user_id, CAST(date_diff('day', CAST(min(scanned_at) AS DATE), CAST(max(scanned_at) AS DATE)) AS INTEGER) AS days, round(avg(confidence) * least(count(*) / 5::DOUBLE, 1), 4) AS strength FROM {SCANS} GROUP BY 1"),
    "a61_weighted_trust": (a61_weighted_trust, f"SELECT scan_id, CAST(greatest(0, least(100, floor(sum(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 5 END * weight) * 20 / CAST(sum(weight) AS DOUBLE)))) AS INTEGER) AS trust FROM {FINDINGS} GROUP BY 1"),
    "a59_improvement": (
        a59_improvement,
        f"""WITH f AS (SELECT scan_id % 5000 AS scan_id, line, weight FROM {FINDINGS}), b AS (SELECT scan_id, count(*) AS n, count(*) FILTER (weight = 1) AS wrong FROM f WHERE line IS NULL OR line < 5 GROUP BY 1),
a AS (SELECT scan_id, count(*) AS n, count(*) FILTER (weight = 1) AS wrong, count(*) FILTER (weight = 2) AS sure FROM f WHERE line > 2 AND scan_id % 9 > 0 GROUP BY 1)
SELECT coalesce(a.scan_id, b.scan_id) AS scan_id, CASE WHEN b.n IS NULL THEN 0 ELSE round(greatest(0, least(1, ((b.wrong - coalesce(a.wrong, 0)) / b.n::DOUBLE + coalesce(a.sure / a.n::DOUBLE, 0)) / 2)), 6) END AS improvement FROM b FULL JOIN a ON a.scan_id = b.scan_id""",
    ),
    "j21_j31_recent_threats": (
        j21_j31_recent_threats,
        f"WITH c AS (SELECT user_id, count(*) AS campaign FROM {SCANS} WHERE scan_id % 5 = 0 GROUP BY 1), t AS (SELECT scan_id, user_id FROM {SCANS} WHERE verdict = 'CRITICAL_RISK' AND scanned_at >= TIMESTAMP '2001-07-03 00:00:00') SELECT t.scan_id, t.user_id, campaign FROM t LEFT JOIN c ON t.user_id = c.user_id",
    ),
    "j28_false_positives": (
        j28_false_positives,
        f"SELECT scanner, count(DISTINCT f.scan_id) FILTER (severity = 'CRITICAL') AS critical, count(DISTINCT f.scan_id) FILTER (severity = 'LOW') AS low, count(*) AS findings FROM {FINDINGS} f JOIN {SCANS} s ON f.scan_id = s.scan_id GROUP BY 1",
    ),
    "t2_ecosystem_list": (
        t2_ecosystem_list,
        " UNION ALL ".join(f"SELECT '{mode}' AS mode, CAST(n - 25 AS INTEGER) AS position, scan_id, package, total > 50 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY {order}, scan_id) AS n, count(*) OVER () AS total FROM {SCANS} WHERE ecosystem = 'npm' AND verdict <> 'ERROR') WHERE n BETWEEN 26 AND 50" for mode, order in (("recent", "scanned_at DESC"), ("risk", "risk_score DESC"), ("name", "package"))),
    ),
    "t6_pending_rescans": (t6_pending_rescans, f"SELECT scan_id, verdict, CAST(CASE verdict WHEN 'CRITICAL_RISK' THEN 1 WHEN 'HIGH_RISK' THEN 2 WHEN 'MEDIUM_RISK' THEN 3 ELSE 4 END AS INTEGER) AS rank FROM {SCANS} WHERE scanner LIKE '1.%' ORDER BY rank, scan_id LIMIT 80"),
    "t14_newest_then_filter": (
        t14_newest_then_filter,
        f"SELECT scan_id, CAST(k AS INTEGER) AS k FROM (SELECT scan_id, scanned_at, unnest(range(1, findings_count % 3 + 2)) AS k FROM (SELECT * FROM {SCANS} ORDER BY scanned_at DESC, scan_id DESC LIMIT 200)) WHERE k > 1 ORDER BY scanned_at DESC, scan_id DESC, k LIMIT 30",
    ),
    "s15_select": (s15_select, f"SELECT scan_id, risk_score FROM {SCANS} WHERE ecosystem = 'pypi' AND verdict = 'LOW_RISK' ORDER BY risk_score DESC, scan_id LIMIT 25 OFFSET 5"),
    "s16_parameters": (s16_parameters, f"SELECT user_id, count(*) AS n FROM {USAGE} WHERE kind = 'click' AND tokens >= 50 GROUP BY 1"),
    "s23_cache_prune": (s23_cache_prune, f"SELECT substr(sha256(package || '|' || version), 1, 16) AS key, scan_id FROM {SCANS} WHERE scanner = '2.1.0' ORDER BY scanned_at DESC, scan_id DESC LIMIT 100"),
    "r12_scheduler": (
        r12_scheduler,
        f"""WITH l AS (SELECT *, CAST(date_diff('day', CAST(scanned_at AS DATE), DATE '2001-08-02') AS INTEGER) AS days FROM {SCANS} WHERE verdict <> 'ERROR' QUALIFY row_number() OVER (PARTITION BY ecosystem, package ORDER BY scanned_at DESC, scan_id DESC) = 1)
SELECT ecosystem, count(*) AS due, max(days) AS oldest FROM l WHERE days >= 90 OR days >= 7 AND verdict IN ('HIGH_RISK', 'CRITICAL_RISK') GROUP BY 1""",
    ),
}
