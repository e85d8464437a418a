"""Queries over stored scans and tools."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import registry as R
from .inputs import frame, source

SCANS, TOOLS = source("scans"), source("tools")
NOW = "TIMESTAMP '2001-08-02 00:00:00'"


def _now():
    return F.expr("timestamp_ntz'2001-08-02 00:00:00'")


def scans(spark, sf):
    return frame(spark, sf, "scans")


def a8_registry_stats(spark, sf):
    return R.registry_stats(scans(spark, sf))


def a9_trust_histogram(spark, sf):
    return R.trust_histogram(scans(spark, sf))


def a10_u1_category_stats(spark, sf):
    return R.category_stats(frame(spark, sf, "tools").withColumn("confidence", F.col("tool_id") % 89 / 89))


def w1_latest_scans(spark, sf):
    return R.latest_scan(scans(spark, sf)).select("ecosystem", "package", "scan_id", "verdict", "scanned_at")


def w1_latest_without_error(spark, sf):
    return R.latest_scan(scans(spark, sf).where("verdict <> 'ERROR'")).select("ecosystem", "package", "scan_id", "verdict", "scanned_at")


def w1_t7_rescan_due(spark, sf):
    return R.rescan_due(scans(spark, sf), _now(), 50)


#: Times at which a rescan is asked for.
ASKED = ["2001-07-01 00:30:00", "2001-07-20 01:00:00", "2001-08-01 00:59:59", "2001-08-01 01:00:00", "2030-01-01 00:00:00"]


def r13_rescan_allowance(spark, sf):
    again = scans(spark, sf).select((F.col("scanned_at") + F.expr("interval '1' second * cast(scan_id % 3600 as int)")).alias("rescanned_at"))
    return R.rescan_allowance(again, [datetime.fromisoformat(t) for t in ASKED], 3)


def t3_best_scans(spark, sf):
    return R.best_scan(scans(spark, sf)).select("ecosystem", "package", "scan_id", "verdict")


def t5_rescan_candidates(spark, sf):
    rows = scans(spark, sf).withColumns({"downloads": F.col("user_id") * 700, "rescanned_at": F.expr("case scan_id % 5 when 0 then null when 1 then timestamp_ntz'2001-08-01 12:00:00' else scanned_at end")})
    return R.rescan_candidates(rows, _now(), 40)


def p38_t1_search_page(spark, sf):
    return R.search(scans(spark, sf), "KG-1", 20, 20, ecosystem="npm").select("scan_id", "package", "verdict", "scanned_at")


def s17_upsert(spark, sf):
    rows = scans(spark, sf).select("ecosystem", "package", "version", "scan_id", "risk_score", "verdict")
    out = R.upsert(rows.where("scan_id % 4 <> 0").groupBy("ecosystem", "package", "version").agg(F.max(F.struct("scan_id", "risk_score", "verdict")).alias("s")).select("ecosystem", "package", "version", "s.*"), rows.where("scan_id % 4 = 0"), ["ecosystem", "package", "version"], "scan_id")
    return out


def s18_merge_add(spark, sf):
    rows = frame(spark, sf, "usage").groupBy("user_id", "kind").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("tokens"))
    return R.merge_add(rows.where("kind in ('view', 'click')"), rows.where("kind <> 'view'"), ["user_id"], ["n", "tokens"])


def j18_needs_classification(spark, sf):
    rows = R.latest_scan(scans(spark, sf))
    done = rows.where("scan_id % 3 <> 0").select("ecosystem", "package", (F.col("scanned_at") + F.expr("interval '1' day * cast(scan_id % 3 - 1 as int)") - F.expr("interval '1' second")).alias("classified_at"))
    return R.needs_classification(rows, done, ["ecosystem", "package"]).select("ecosystem", "package", "scan_id")


def a25_a26_scanner_metrics(spark, sf):
    return R.scanner_metrics(scans(spark, sf))


def a27_a30_version_shares(spark, sf):
    was = {"scanner": F.expr("case when scanner <> '1.4.0' then scanner when scan_id % 2 = 0 then '1.0.0' end"), "original_score": F.expr("case when scan_id % 3 > 0 then risk_score + scan_id % 7 - 2 end"), "rescanned_at": F.expr("case when scan_id % 4 = 0 then scanned_at + interval '1' day end")}
    return R.version_shares(scans(spark, sf).withColumns(was).withColumnRenamed("scanned_at", "created_at"), F.expr("timestamp_ntz'2001-08-02 00:00:00'"))


def a28_confidence_distribution(spark, sf):
    return R.confidence_distribution(scans(spark, sf))


def a29_rescan_stats(spark, sf):
    s = scans(spark, sf)
    old, new = s.where("scanner like '1.%'"), s.where("scanner like '2.%'")
    pairs = old.select("package", "ecosystem", F.col("risk_score").alias("o")).join(R.latest_scan(new).select("package", "ecosystem", F.col("risk_score").alias("n")), ["package", "ecosystem"])
    return pairs.agg(F.count("*").alias("rescans"), F.round(F.avg("o"), 4).alias("before"), F.round(F.avg("n"), 4).alias("after"), F.count_if(F.col("n") < F.col("o")).alias("improved"))


def w2_j32_running_total(spark, sf):
    return R.running_total(scans(spark, sf))


def a57_dashboard(spark, sf):
    return R.personal_dashboard(scans(spark, sf))


def p39_detection_delta(spark, sf):
    rows = scans(spark, sf).withColumn("vendor_a", F.expr("case scan_id % 3 when 0 then null when 1 then 'safe' else 'malicious' end")).withColumn("vendor_b", F.expr("case when scan_id % 5 = 0 then 'flagged' end"))
    return R.detection_delta(rows, ["vendor_a", "vendor_b"]).select("scan_id", "verdict")


def p43_policies(spark, sf):
    policies = [
        {"policy": "open", "blocklist": [], "allowlist": [], "auto_approve": 100, "required_phases": []},
        {"policy": "strict", "blocklist": ["pkg-7", "pkg-8"], "allowlist": [], "auto_approve": 20, "required_phases": ["install_hooks", "code_patterns"]},
        {"policy": "listed", "blocklist": [], "allowlist": [f"pkg-{k}" for k in range(0, 60, 2)], "auto_approve": 40, "required_phases": ["code_patterns"]},
    ]
    rows = scans(spark, sf).select("scan_id", "package", "risk_score", F.expr("case when scan_id % 2 = 0 then array('install_hooks', 'code_patterns') else array('code_patterns') end").alias("phases"))
    return R.policy_evaluation(rows, policies)


def t12_limit_then_filter(spark, sf):
    return scans(spark, sf).orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(100).where("verdict in ('HIGH_RISK', 'CRITICAL_RISK')").select("scan_id", "verdict")


def t4_tool_order(spark, sf):
    rows = frame(spark, sf, "tools").select("tool_id", F.when(F.col("tool_id") % 7 > 0, F.col("downloads")).alias("downloads"), "stars", (100 - F.col("risk_score")).alias("trust"), F.expr("case when tool_id % 11 = 0 then null else timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(tool_id * 37 % 1000) end").alias("updated_at"))
    pages = [R.sorted_tools(rows, mode, 50).select(F.lit(mode).alias("mode"), "position", "tool_id") for mode in ("trending", "downloads", "stars", "newest")]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).unionByName(pages[3])


def u2_u3_own_and_team(spark, sf):
    s = scans(spark, sf)
    both = s.where("user_id in (3, 5, 8)").unionByName(s.where("ecosystem = 'npm' and user_id < 9")).dropDuplicates(["scan_id"])
    return both.groupBy("user_id").agg(F.count("*").alias("scans"), F.max("risk_score").alias("worst"))


def u2_merged_scans(spark, sf):
    s = scans(spark, sf)
    own, public = s.where("user_id = 3"), s.where("ecosystem = 'npm'")
    both = R.merged_scans(own, public, False).withColumn("plan", F.lit("free")).unionByName(R.merged_scans(own, public, True).withColumn("plan", F.lit("paid")))
    return both.select("plan", "scan_id", "origin")


def a9_forge_stats(spark, sf):
    return R.forge_stats(scans(spark, sf))


def a41_dashboard_stats(spark, sf):
    s = scans(spark, sf)
    both = s.where("user_id = 3").unionByName(s.where("user_id between 3 and 6")).dropDuplicates(["scan_id"])
    return both.agg(F.count("*").alias("scans"), F.count_if(F.col("verdict").isin("HIGH_RISK", "CRITICAL_RISK")).alias("threats"), F.count_distinct("package").alias("packages"))


def a47_weekly_digest(spark, sf):
    s = scans(spark, sf).where("scanned_at >= timestamp_ntz'2001-05-01 00:00:00'")
    return s.groupBy("ecosystem").agg(F.count("*").alias("scans"), F.round(F.avg("risk_score"), 4).alias("risk")).orderBy(F.desc("scans"), "ecosystem").limit(5)


def a47_trust_changes(spark, sf):
    rows = frame(spark, sf, "tools").select("tool_id", (100 - F.col("risk_score")).alias("trust"), (100 - F.col("tool_id") % 23).alias("previous_trust"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(tool_id % 14)").alias("trust_at"))
    return R.trust_changes(rows, F.expr("timestamp_ntz'2024-01-02 00:00:00'"), F.expr("timestamp_ntz'2024-01-09 00:00:00'"))


QUERIES = {
    "a8_registry_stats": (
        a8_registry_stats,
        f"""SELECT 'total' AS kind, 'total_scans' AS value, count(*) FILTER (verdict <> 'ERROR') AS n FROM {SCANS} UNION ALL SELECT 'total', 'packages', count(DISTINCT ecosystem || ':' || package) FROM {SCANS} UNION ALL SELECT 'total', 'threats', count(*) FILTER (verdict IN ('HIGH_RISK', 'CRITICAL_RISK')) FROM {SCANS}
 UNION ALL SELECT 'ecosystem', ecosystem, count(*) FROM {SCANS} GROUP BY ecosystem UNION ALL SELECT 'verdict', verdict, count(*) FROM {SCANS} WHERE verdict <> 'ERROR' GROUP BY verdict""",
    ),
    "r13_rescan_allowance": (
        r13_rescan_allowance,
        f"""SELECT "at", count(rescanned_at) AS recent, count(rescanned_at) < 3 AS allowed FROM (VALUES {", ".join(f"(TIMESTAMP '{t}')" for t in ASKED)}) t("at")
LEFT JOIN (SELECT scanned_at + INTERVAL '1' SECOND * CAST(scan_id % 3600 AS INTEGER) AS rescanned_at FROM {SCANS}) s ON rescanned_at > "at" - INTERVAL '1' HOUR AND rescanned_at <= "at" GROUP BY 1""",
    ),
    "a9_trust_histogram": (
        a9_trust_histogram,
        f"SELECT ecosystem, greatest(0, count(*) FILTER (greatest(0, 100 - risk_score) >= 80) - count(*) FILTER (verdict = 'ERROR')) AS high, count(*) FILTER (greatest(0, 100 - risk_score) >= 50 AND greatest(0, 100 - risk_score) < 80) AS medium, count(*) FILTER (greatest(0, 100 - risk_score) < 50) AS low FROM {SCANS} GROUP BY ecosystem",
    ),
    "a10_u1_category_stats": (
        a10_u1_category_stats,
        f"""WITH t AS (SELECT category, ecosystem, tool_id % 89 / 89::DOUBLE AS c FROM {TOOLS}) SELECT category, ecosystem, count(*) AS tools, round(avg(c), 4) AS confidence, count(*) FILTER (c > 0.8) AS confident FROM t GROUP BY 1, 2
 UNION ALL SELECT category, 'all', count(*), round(avg(c), 4), count(*) FILTER (c > 0.8) FROM t GROUP BY 1""",
    ),
    "w1_latest_scans": (w1_latest_scans, f"SELECT ecosystem, package, scan_id, verdict, scanned_at FROM {SCANS} QUALIFY row_number() OVER (PARTITION BY ecosystem, package ORDER BY scanned_at DESC, scan_id DESC) = 1"),
    "w1_latest_without_error": (w1_latest_without_error, f"SELECT ecosystem, package, scan_id, verdict, scanned_at FROM {SCANS} WHERE verdict <> 'ERROR' QUALIFY row_number() OVER (PARTITION BY ecosystem, package ORDER BY scanned_at DESC, scan_id DESC) = 1"),
    "w1_t7_rescan_due": (
        w1_t7_rescan_due,
        f"""WITH l AS (SELECT *, CAST(date_diff('day', CAST(scanned_at AS DATE), DATE '2001-08-02') AS INTEGER) AS days, verdict IN ('HIGH_RISK', 'CRITICAL_RISK') AS risky FROM {SCANS} WHERE verdict <> 'ERROR' QUALIFY row_number() OVER (PARTITION BY ecosystem, package ORDER BY scanned_at DESC, scan_id DESC) = 1)
SELECT ecosystem, package, scan_id, verdict, days FROM l WHERE days >= CASE WHEN risky THEN 7 ELSE 90 END ORDER BY risky DESC, scanned_at, scan_id LIMIT 50""",
    ),
    "t3_best_scans": (t3_best_scans, f"SELECT ecosystem, package, scan_id, verdict FROM {SCANS} QUALIFY row_number() OVER (PARTITION BY ecosystem, package ORDER BY verdict = 'ERROR', scanned_at DESC, scan_id DESC) = 1"),
    "t5_rescan_candidates": (
        t5_rescan_candidates,
        f"""WITH d AS (SELECT *, date_diff('day', CAST(scanned_at AS DATE), DATE '2001-08-02') AS days, user_id * 700 AS downloads FROM {SCANS} WHERE scanner LIKE '1.%' AND scan_id % 5 <> 1 AND (scan_id % 5 = 0 OR scanned_at < TIMESTAMP '2001-08-01 00:00:00')),
c AS ((SELECT * FROM d WHERE verdict IN ('HIGH_RISK', 'CRITICAL_RISK') AND scanned_at > TIMESTAMP '2001-07-03 00:00:00' ORDER BY CASE verdict WHEN 'CRITICAL_RISK' THEN 4 ELSE 3 END DESC, findings_count DESC, scanned_at DESC, scan_id LIMIT 20)
 UNION ALL (SELECT * FROM d WHERE verdict = 'MEDIUM_RISK' AND findings_count >= 5 AND downloads > 1000 AND scanned_at > TIMESTAMP '2001-07-19 00:00:00' ORDER BY findings_count DESC, downloads DESC, scanned_at DESC, scan_id LIMIT 20))
SELECT scan_id, verdict, CAST(greatest(CASE verdict WHEN 'CRITICAL_RISK' THEN 100 WHEN 'HIGH_RISK' THEN 75 WHEN 'MEDIUM_RISK' THEN 50 ELSE 25 END + CASE WHEN findings_count >= 20 THEN 25 WHEN findings_count >= 10 THEN 15 WHEN findings_count >= 5 THEN 10 ELSE 0 END
 + CASE WHEN downloads > 100000 THEN 15 WHEN downloads > 10000 THEN 10 WHEN downloads > 1000 THEN 5 ELSE 0 END - CASE WHEN days > 7 THEN least(days - 7, 20) ELSE 0 END, 0) AS DOUBLE) AS priority FROM c ORDER BY priority DESC, scan_id LIMIT 40""",
    ),
    "p38_t1_search_page": (p38_t1_search_page, f"SELECT scan_id, package, verdict, scanned_at FROM {SCANS} WHERE verdict <> 'ERROR' AND contains(lower(package), 'kg-1') AND ecosystem = 'npm' ORDER BY scanned_at DESC, scan_id DESC LIMIT 21 OFFSET 20"),
    "s17_upsert": (
        s17_upsert,
        f"""WITH s AS (SELECT ecosystem, package, version, scan_id, risk_score, verdict FROM {SCANS}),
o AS (SELECT * FROM s WHERE scan_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY ecosystem, package, version ORDER BY scan_id DESC) = 1),
n AS (SELECT * FROM s WHERE scan_id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY ecosystem, package, version ORDER BY scan_id DESC) = 1)
SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (ecosystem, package, version)""",
    ),
    "s18_merge_add": (
        s18_merge_add,
        f"""WITH u AS (SELECT user_id, kind, count(*) AS n, sum(tokens) AS tokens FROM {source("usage")} GROUP BY 1, 2)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT * FROM u WHERE kind IN ('view', 'click') UNION ALL SELECT * FROM u WHERE kind <> 'view') GROUP BY user_id""",
    ),
    "j18_needs_classification": (
        j18_needs_classification,
        f"""WITH l AS (SELECT * FROM {SCANS} QUALIFY row_number() OVER (PARTITION BY ecosystem, package ORDER BY scanned_at DESC, scan_id DESC) = 1),
c AS (SELECT ecosystem, package, scanned_at + INTERVAL '1' DAY * CAST(scan_id % 3 - 1 AS INTEGER) - INTERVAL '1' SECOND AS classified_at FROM l WHERE scan_id % 3 <> 0)
SELECT l.ecosystem, l.package, l.scan_id FROM l LEFT JOIN c ON l.ecosystem = c.ecosystem AND l.package = c.package WHERE classified_at IS NULL OR scanned_at > classified_at""",
    ),
    "a25_a26_scanner_metrics": (
        a25_a26_scanner_metrics,
        f"""WITH d AS (SELECT left(scanner, 1) || '.x' AS version, verdict, CAST(scanned_at AS DATE) AS day, count(*) AS n, avg(risk_score) AS score, avg(confidence) AS sure FROM {SCANS} WHERE verdict <> 'ERROR' GROUP BY 1, 2, 3)
SELECT version, CAST(sum(n) AS BIGINT) AS scans, round(sum(score * n) / sum(n), 2) AS mean_score, round(sum(sure * n) / sum(n) FILTER (sure IS NOT NULL), 3) AS mean_confidence, CAST(sum(n) FILTER (verdict IN ('HIGH_RISK', 'CRITICAL_RISK')) AS BIGINT) AS severe,
 round(sum(n) FILTER (verdict IN ('HIGH_RISK', 'CRITICAL_RISK')) * CASE version WHEN '1.x' THEN 0.36::DOUBLE ELSE 0.05::DOUBLE END * 100 / sum(n), 1) AS false_positives FROM d GROUP BY version""",
    ),
    "a27_a30_version_shares": (
        a27_a30_version_shares,
        f"""WITH s AS (SELECT scan_id, CASE WHEN scanner <> '1.4.0' THEN scanner WHEN scan_id % 2 = 0 THEN '1.0.0' END AS scanner, risk_score, CASE WHEN scan_id % 3 > 0 THEN risk_score + scan_id % 7 - 2 END AS o, scanned_at AS t, CASE WHEN scan_id % 4 = 0 THEN scanned_at + INTERVAL '1' DAY END AS again FROM {SCANS}),
r AS (SELECT count(*) / greatest(1, date_diff('day', CAST(min(again) AS DATE), DATE '2001-08-02'))::DOUBLE AS rate FROM s WHERE scanner = '2.0.0' AND again IS NOT NULL),
n AS (SELECT count(*) AS scans, count(*) FILTER (scanner = '1.0.0' OR scanner IS NULL) AS v1, count(*) FILTER (scanner = '2.0.0') AS v2, coalesce(round(avg(CASE WHEN o IS NOT NULL AND risk_score < o THEN (o - risk_score)::DOUBLE / o * 100 ELSE 0 END), 2), 0) AS reduction FROM s WHERE t >= TIMESTAMP '2001-08-02' - INTERVAL '90' DAY)
SELECT scans, v1, v2, CASE WHEN scans > 0 THEN round(v2 * 100 / scans::DOUBLE, 2) ELSE 0 END AS migrated, reduction, CASE WHEN v2 > 0 AND rate > 0 THEN CAST(DATE '2001-08-02' + INTERVAL '1' DAY * CAST(floor(v1 / rate) AS INTEGER) AS DATE) END AS done FROM n, r""",
    ),
    "a28_confidence_distribution": (a28_confidence_distribution, f"SELECT scanner AS version, verdict, round(confidence, 1) AS confidence, CASE WHEN confidence < 0.3 THEN 'likely_false_positive' WHEN confidence < 0.6 THEN 'low_confidence' ELSE 'high_confidence' END AS level, count(*) AS scans FROM {SCANS} WHERE verdict <> 'ERROR' AND confidence IS NOT NULL GROUP BY 1, 2, 3, 4"),
    "a29_rescan_stats": (
        a29_rescan_stats,
        f"""WITH s AS (SELECT * FROM {SCANS}), n AS (SELECT * FROM s WHERE scanner LIKE '2.%' QUALIFY row_number() OVER (PARTITION BY ecosystem, package ORDER BY scanned_at DESC, scan_id DESC) = 1)
SELECT count(*) AS rescans, round(avg(o.risk_score), 4) AS before, round(avg(n.risk_score), 4) AS after, count(*) FILTER (n.risk_score < o.risk_score) AS improved FROM s o JOIN n ON o.ecosystem = n.ecosystem AND o.package = n.package WHERE o.scanner LIKE '1.%'""",
    ),
    "w2_j32_running_total": (
        w2_j32_running_total,
        f"""WITH d AS (SELECT CAST(scanned_at AS DATE) AS day, count(*) AS scans FROM {SCANS} GROUP BY 1), t AS (SELECT sum(scans) AS n FROM d)
SELECT day, scans, CAST(sum(scans) OVER (ORDER BY day) AS BIGINT) AS total, round(sum(scans) OVER (ORDER BY day) * 100 / CAST(n AS DOUBLE), 4) AS share FROM d, t""",
    ),
    "a57_dashboard": (
        a57_dashboard,
        f"""SELECT user_id, count(*) AS scans, round(avg(risk_score), 4) AS mean_risk, count(*) FILTER (risk_score > 50) AS risky, max(scanned_at) AS last FROM (SELECT * FROM {SCANS} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY scanned_at DESC, scan_id DESC) <= 10) GROUP BY user_id""",
    ),
    "p39_detection_delta": (p39_detection_delta, f"SELECT scan_id, verdict FROM {SCANS} WHERE verdict IN ('HIGH_RISK', 'CRITICAL_RISK') AND scan_id % 3 <> 2 AND scan_id % 5 <> 0"),
    "p43_policies": (
        p43_policies,
        f"""WITH s AS (SELECT scan_id, package, risk_score, scan_id % 2 = 0 AS hooks, CAST(substr(package, 5) AS INTEGER) AS k FROM {SCANS}),
v AS (SELECT 'open' AS policy, scan_id, '' AS violations, risk_score <= 100 AS low FROM s
 UNION ALL SELECT 'strict', scan_id, array_to_string(list_filter([CASE WHEN k IN (7, 8) THEN 'blocked' END, CASE WHEN NOT hooks THEN 'missing_phase' END], lambda x: x IS NOT NULL), ','), risk_score <= 20 FROM s
 UNION ALL SELECT 'listed', scan_id, CASE WHEN k < 60 AND k % 2 = 0 THEN '' ELSE 'not_allowed' END, risk_score <= 40 FROM s)
SELECT policy, scan_id, violations = '' AS allowed, violations = '' AND low AS auto_approved, violations FROM v""",
    ),
    "t12_limit_then_filter": (t12_limit_then_filter, f"SELECT scan_id, verdict FROM (SELECT * FROM {SCANS} ORDER BY scanned_at DESC, scan_id DESC LIMIT 100) WHERE verdict IN ('HIGH_RISK', 'CRITICAL_RISK')"),
    "t4_tool_order": (
        t4_tool_order,
        f"WITH t AS (SELECT tool_id, CASE WHEN tool_id % 7 > 0 THEN downloads ELSE 0 END AS d, stars AS s, 100 - risk_score AS t, CASE WHEN tool_id % 11 > 0 THEN tool_id * 37 % 1000 END AS u FROM {TOOLS}) "
        + " UNION ALL ".join(f"SELECT '{mode}' AS mode, CAST(row_number() OVER (ORDER BY {key} DESC NULLS LAST, tool_id) AS INTEGER) AS position, tool_id FROM t QUALIFY position <= 50" for mode, key in (("trending", "round(d * 0.4::DOUBLE + s * 0.3::DOUBLE + t * 0.3::DOUBLE, 9)"), ("downloads", "d"), ("stars", "s"), ("newest", "u"))),
    ),
    "u2_u3_own_and_team": (u2_u3_own_and_team, f"SELECT user_id, count(*) AS scans, max(risk_score) AS worst FROM {SCANS} WHERE user_id IN (3, 5, 8) OR (ecosystem = 'npm' AND user_id < 9) GROUP BY user_id"),
    "a41_dashboard_stats": (a41_dashboard_stats, f"SELECT count(*) AS scans, count(*) FILTER (verdict IN ('HIGH_RISK', 'CRITICAL_RISK')) AS threats, count(DISTINCT package) AS packages FROM {SCANS} WHERE user_id BETWEEN 3 AND 6"),
    "u2_merged_scans": (
        u2_merged_scans,
        f"""WITH m AS (SELECT scan_id, CASE WHEN user_id = 3 THEN 'own' ELSE 'public' END AS origin, row_number() OVER (ORDER BY scanned_at DESC, scan_id DESC) AS n FROM {SCANS} WHERE user_id = 3 OR ecosystem = 'npm')
SELECT plan, scan_id, origin FROM m JOIN (VALUES ('free', 10), ('paid', 50)) p(plan, most) ON n <= most""",
    ),
    "a9_forge_stats": (
        a9_forge_stats,
        f"""SELECT count(*) AS tools, count(*) FILTER (ecosystem IN ('mcp', 'github')) AS servers, count(*) FILTER (ecosystem IN ('skill', 'clawhub')) AS skills, count(*) FILTER (ecosystem = 'npm') AS npm, count(*) FILTER (ecosystem = 'pypi') AS pypi,
 greatest(count(*) FILTER (risk_score <= 25) - count(*) FILTER (verdict = 'ERROR'), 0) AS high, count(*) FILTER (risk_score > 25 AND risk_score <= 60) AS medium, count(*) FILTER (risk_score > 60 AND risk_score <= 85) AS low, count(*) FILTER (risk_score > 85) AS very_low FROM {SCANS}""",
    ),
    "a47_trust_changes": (a47_trust_changes, f"SELECT tool_id, tool_id % 23 - risk_score AS change FROM {TOOLS} WHERE tool_id % 14 BETWEEN 1 AND 7 AND abs(tool_id % 23 - risk_score) >= 10 ORDER BY abs(tool_id % 23 - risk_score) DESC, tool_id LIMIT 5"),
    "a47_weekly_digest": (a47_weekly_digest, f"SELECT ecosystem, count(*) AS scans, round(avg(risk_score), 4) AS risk FROM {SCANS} WHERE scanned_at >= TIMESTAMP '2001-05-01 00:00:00' GROUP BY ecosystem ORDER BY scans DESC, ecosystem LIMIT 5"),
}
