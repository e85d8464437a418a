"""Queries over findings: scores, verdicts, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import severity as S
from ..operators import scoring
from .inputs import frame, source

FINDINGS = source("findings")
_THREAT = "CASE phase WHEN 'install_hooks' THEN 'installation_threats' WHEN 'code_patterns' THEN 'code_execution_threats' WHEN 'network_exfil' THEN 'exfiltration_threats' END"
_CLI = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 5 ELSE 0 END"
_RANK = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"
_DOCS = "(lower(file) LIKE '%readme%' OR lower(file) LIKE '%.md%')"
_TESTS = "(lower(file) LIKE '%test!_%' ESCAPE '!')"
_CLI_SCORED = f"""SELECT scan_id, CAST(sum({_CLI} * weight) AS BIGINT) AS score,
  CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL_RISK' WHEN sum({_CLI} * weight) >= 25 THEN 'HIGH_RISK' WHEN sum({_CLI} * weight) >= 10 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS verdict,
  count(*) AS findings FROM {FINDINGS} {{where}} GROUP BY scan_id"""
_CONTEXT = f"CASE WHEN lower(file) LIKE '%node!_modules/%' ESCAPE '!' THEN 0.1 WHEN {_DOCS} THEN 0.2 WHEN {_TESTS} THEN 0.3 ELSE 1.0 END"


def a1_scan_scores(spark, sf):
    return scoring.scan_scores(frame(spark, sf, "findings"))


def a2_verdicts(spark, sf):
    return scoring.scan_scores(frame(spark, sf, "findings")).groupBy("verdict").agg(F.count("*").alias("scans"), F.max("score").alias("top"), F.sum("findings").cast("long").alias("findings"))


def q4_scores_from_medium(spark, sf):
    return scoring.scan_scores(frame(spark, sf, "findings"), "MEDIUM")


def a3_a4_api_scores(spark, sf):
    return scoring.api_scores(frame(spark, sf, "findings"))


def a5_exit_codes(spark, sf):
    return scoring.failing_scans(frame(spark, sf, "findings"), "HIGH")


def a6_confidence_summary(spark, sf):
    return scoring.confidence_summary(frame(spark, sf, "findings"))


def p18_p19_p20_adjusted(spark, sf):
    path = F.col("file")
    low = F.lower(path)
    context = F.when(low.contains("node_modules/"), "vendor").when(S.contains_any(low, S.TEST_MARKS), "test").when(S.contains_any(low, S.DOC_MARKS), "documentation").otherwise("production")
    rows = frame(spark, sf, "findings").select(context.alias("context"), S.adjusted_severity(F.col("severity"), path).alias("adjusted"), S.confidence(F.col("severity"), path).alias("confidence"))
    return rows.groupBy("context", "adjusted", "confidence").agg(F.count("*").alias("findings"))


def a31_categories(spark, sf):
    return scoring.threat_categories(frame(spark, sf, "findings"))


def a32_a33_threat_scores(spark, sf):
    """Orders of at least five lines have an insight for each of their lines."""
    rows = frame(spark, sf, "findings")
    told = rows.where("line is null or line >= 2").selectExpr("scan_id", "case when weight = 1 then 'injection' else 'evasion' end as category", "(scan_id % 20 + coalesce(line, 7)) % 20 / 20 as confidence", "case when weight = 3 then 1.5D when weight = 2 then -0.5D end as adjustment", "array(file, concat('x', weight)) as files")
    return scoring.threat_scores(rows, told)


def a36_j27_compliance(spark, sf):
    rules = [(f"R-{k}", [f"nist:c{k % 4}", f"iso:a{k % 5}"] + ([f"soc:t{k % 3}"] if k % 2 else [])) for k in range(23)]
    return scoring.compliance_scores(frame(spark, sf, "findings"), spark.createDataFrame(rules, "rule string, refs array<string>"))


def a37_security_trend(spark, sf):
    rows = frame(spark, sf, "findings").withColumn("key", F.expr("scan_id div 2"))
    return scoring.security_trend(rows.where("scan_id % 2 = 0"), rows.where("scan_id % 2 = 1"))


def a44_detection_rates(spark, sf):
    rows = frame(spark, sf, "findings").select(F.col("scan_id").alias("sample"), (F.col("scan_id") % 7 != 0).alias("malicious"), F.when(F.col("weight") > 1, F.col("severity")).alias("severity"))
    return scoring.detection_rates(rows)


def a46_percentiles(spark, sf):
    return scoring.sorted_percentiles(frame(spark, sf, "usage"), "kind", "cost", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).select("kind", *[F.col(c).cast("double").alias(c) for c in ("p50", "p95", "p99")])


def w10_first_per_bucket(spark, sf):
    from ..operators.scanning import first_per_bucket

    return first_per_bucket(frame(spark, sf, "findings").select("rule", "scan_id", "weight", "severity", F.coalesce("line", F.lit(0)).alias("line"), "file"), "rule", ["scan_id", "line", "file", "weight", "severity"], 3)


_API_PART = f"""CASE severity WHEN 'LOW' THEN 1.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'HIGH' THEN 3.0 ELSE 5.0 END * CASE phase WHEN 'install_hooks' THEN 10.0 WHEN 'code_patterns' THEN 5.0 ELSE 3.0 END * weight * {_CONTEXT}"""
_SECURITY = "CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 1 ELSE 0 END * weight"

QUERIES = {
    "a1_scan_scores": (a1_scan_scores, _CLI_SCORED.format(where="")),
    "a2_verdicts": (a2_verdicts, f"SELECT verdict, count(*) AS scans, max(score) AS top, CAST(sum(findings) AS BIGINT) AS findings FROM ({_CLI_SCORED.format(where='')}) GROUP BY verdict"),
    "q4_scores_from_medium": (q4_scores_from_medium, _CLI_SCORED.format(where=f"WHERE {_RANK} >= 2")),
    "a3_a4_api_scores": (
        a3_a4_api_scores,
        f"""SELECT scan_id, round(CAST(sum({_API_PART}) AS DOUBLE), 6) AS score,
  CASE WHEN sum({_API_PART}) >= 50 THEN 'CRITICAL_RISK' WHEN sum({_API_PART}) >= 25 THEN 'HIGH_RISK' WHEN sum({_API_PART}) >= 10 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS verdict FROM {FINDINGS} GROUP BY scan_id""",
    ),
    "a5_exit_codes": (a5_exit_codes, f"SELECT scan_id, CAST(bool_or({_RANK} >= 3) AS INTEGER) AS exit_code FROM {FINDINGS} GROUP BY scan_id"),
    "a6_confidence_summary": (
        a6_confidence_summary,
        f"""WITH c AS (SELECT scan_id, CASE WHEN {_DOCS} OR {_TESTS} OR file LIKE '%node!_modules/%' ESCAPE '!' THEN 'L' WHEN severity = 'CRITICAL' THEN 'H' ELSE 'M' END AS c FROM {FINDINGS}),
n AS (SELECT scan_id, count(*) FILTER (c = 'H') AS high, count(*) FILTER (c = 'M') AS medium, count(*) FILTER (c = 'L') AS low, count(*) AS n FROM c GROUP BY scan_id)
SELECT scan_id, high, medium, low, round((high + 0.5 * medium) / CAST(n AS DOUBLE), 3) AS confidence, CASE WHEN low / CAST(n AS DOUBLE) > 0.7 THEN 'high' WHEN low / CAST(n AS DOUBLE) > 0.4 THEN 'medium' ELSE 'low' END AS false_positives FROM n""",
    ),
    "p18_p19_p20_adjusted": (
        p18_p19_p20_adjusted,
        f"""SELECT CASE WHEN file LIKE '%node!_modules/%' ESCAPE '!' THEN 'vendor' WHEN {_TESTS} THEN 'test' WHEN {_DOCS} THEN 'documentation' ELSE 'production' END AS context,
  CASE WHEN {_DOCS} THEN CASE severity WHEN 'CRITICAL' THEN 'MEDIUM' WHEN 'HIGH' THEN 'LOW' WHEN 'MEDIUM' THEN 'LOW' ELSE severity END WHEN {_TESTS} THEN CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' ELSE severity END ELSE severity END AS adjusted,
  CASE WHEN {_DOCS} OR {_TESTS} OR file LIKE '%node!_modules/%' ESCAPE '!' THEN 'LOW' WHEN severity = 'CRITICAL' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, count(*) AS findings FROM {FINDINGS} GROUP BY 1, 2, 3""",
    ),
    "a31_categories": (a31_categories, f"SELECT scan_id, {_THREAT} AS kind, severity, count(*) AS findings FROM {FINDINGS} GROUP BY 1, 2, 3"),
    "a32_a33_threat_scores": (
        a32_a33_threat_scores,
        f"""WITH f AS (SELECT * FROM {FINDINGS}), i AS (SELECT scan_id, weight, file, ((scan_id % 20 + coalesce(line, 7)) % 20) / 20::DOUBLE AS c, CASE weight WHEN 3 THEN 4.5 WHEN 2 THEN 2.5 ELSE 3 END AS base FROM f WHERE line IS NULL OR line >= 2),
k AS (SELECT scan_id, least(10, sum(CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END * weight))::DOUBLE AS points FROM f GROUP BY scan_id, {_THREAT} UNION ALL SELECT scan_id, least(10, sum(base * c)) FROM i GROUP BY scan_id, weight = 1),
r AS (SELECT scan_id, sum(points) AS risk FROM k GROUP BY 1)
SELECT scan_id, round(risk, 6) AS risk, CASE WHEN risk > 20 THEN 'critical' WHEN risk > 15 THEN 'high' WHEN risk > 8 THEN 'medium' ELSE 'low' END AS level, (SELECT count(DISTINCT phase) > 3 FROM f WHERE f.scan_id = r.scan_id) AS many_phases,
 (SELECT count(*) > 2 FROM i WHERE i.scan_id = r.scan_id AND c > 0.8) AS sure_insights, (SELECT count(DISTINCT x) > 10 FROM (SELECT scan_id, file AS x FROM f UNION ALL SELECT scan_id, 'x' || CAST(weight AS VARCHAR) FROM i) u WHERE u.scan_id = r.scan_id) AS widespread FROM r""",
    ),
    "a36_j27_compliance": (
        a36_j27_compliance,
        f"""WITH r AS (SELECT 'R-' || CAST(k AS VARCHAR) AS rule, unnest(CASE WHEN k % 2 = 1 THEN ['nist:c' || CAST(k % 4 AS VARCHAR), 'iso:a' || CAST(k % 5 AS VARCHAR), 'soc:t' || CAST(k % 3 AS VARCHAR)] ELSE ['nist:c' || CAST(k % 4 AS VARCHAR), 'iso:a' || CAST(k % 5 AS VARCHAR)] END) AS ref FROM range(23) t(k))
SELECT split_part(ref, ':', 1) AS framework, count(*) AS findings, count(DISTINCT ref) AS controls,
  CAST(greatest(0, 100 - 2 * sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2 ELSE 1 END)) AS BIGINT) AS score FROM {FINDINGS} f JOIN r ON f.rule = r.rule GROUP BY 1""",
    ),
    "a37_security_trend": (
        a37_security_trend,
        f"""WITH s AS (SELECT scan_id // 2 AS key, CAST(coalesce(sum({_SECURITY}) FILTER (scan_id % 2 = 0), 0) AS BIGINT) AS old_score, CAST(coalesce(sum({_SECURITY}) FILTER (scan_id % 2 = 1), 0) AS BIGINT) AS new_score FROM {FINDINGS} GROUP BY 1)
SELECT *, new_score - old_score AS change, CASE WHEN new_score - old_score > 5 THEN 'worse' WHEN new_score - old_score < -5 THEN 'better' ELSE 'same' END AS trend FROM s""",
    ),
    "a44_detection_rates": (
        a44_detection_rates,
        f"""WITH t AS (SELECT scan_id, scan_id % 7 <> 0 AS malicious, max(CASE WHEN weight > 1 THEN {_RANK} ELSE 0 END) AS top FROM {FINDINGS} GROUP BY scan_id),
c AS (SELECT threshold, count(*) FILTER (top >= least AND malicious) AS tp, count(*) FILTER (malicious) AS p, count(*) FILTER (top >= least AND NOT malicious) AS fp, count(*) FILTER (NOT malicious) AS n FROM t, (VALUES ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('CRITICAL', 4)) l(threshold, least) GROUP BY threshold)
SELECT threshold, round(tp / CAST(p AS DOUBLE), 4) AS recall, round(fp / CAST(n AS DOUBLE), 4) AS false_positive_rate, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 4) AS precision FROM c""",
    ),
    "a46_percentiles": (
        a46_percentiles,
        f"""WITH r AS (SELECT kind, CAST(cost AS DOUBLE) AS cost, row_number() OVER (PARTITION BY kind ORDER BY cost) - 1 AS place, count(*) OVER (PARTITION BY kind) AS n FROM {source("usage")})
SELECT kind, {", ".join(f"max(cost) FILTER (place = least(floor(n * {p}), n - 1)) AS {k}" for k, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))} FROM r GROUP BY kind""",
    ),
    "w10_first_per_bucket": (
        w10_first_per_bucket,
        f"""SELECT rule, scan_id, weight, severity, line, file FROM (SELECT rule, scan_id, weight, severity, coalesce(line, 0) AS line, file, row_number() OVER (PARTITION BY rule ORDER BY scan_id, coalesce(line, 0), file, weight, severity) AS n FROM {FINDINGS}) WHERE n <= 3""",
    ),
}
