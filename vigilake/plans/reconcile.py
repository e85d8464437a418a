"""Queries that compare states: diffs, pins, attestations, advisories, reputations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import severity as S
from ..operators import reconcile as R
from ..operators import registry
from .inputs import frame, read, source

FINDINGS, SCANS = source("findings"), source("scans")
_OLD = f"(SELECT file, rule, line, severity, scan_id FROM {FINDINGS} WHERE scan_id % 2 = 0)"
_NEW = f"(SELECT file, rule, line, severity, scan_id FROM {FINDINGS} WHERE scan_id % 2 = 1)"
_SAME = "a.file IS NOT DISTINCT FROM b.file AND a.rule IS NOT DISTINCT FROM b.rule AND a.line IS NOT DISTINCT FROM b.line"


def _halves(spark, sf):
    rows = frame(spark, sf, "findings").select("file", "rule", "line", "severity", "scan_id")
    return rows.where("scan_id % 2 = 0"), rows.where("scan_id % 2 = 1")


def j2_u7_scan_diff(spark, sf):
    return R.scan_diff(*_halves(spark, sf)).groupBy("change", "severity").agg(F.count("*").alias("findings"), F.count_distinct("file").alias("files"))


def j3_version_compare(spark, sf):
    rows = [h.withColumn("place", F.struct("scan_id", "severity")) for h in _halves(spark, sf)]
    return R.version_compare(*rows, "place").groupBy("change", "old_severity", "new_severity").agg(F.count("*").alias("findings"))


def _pins(spark, sf):
    return read(spark, sf, "lineitem").select((F.col("l_suppkey")).alias("artifact"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("hash"), "l_orderkey").dropDuplicates(["artifact", "path"])


def a7_digests(spark, sf):
    return R.content_digests(_pins(spark, sf))


def j8_pin_changes(spark, sf):
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("artifact"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path")).agg(F.min("l_orderkey").alias("k"))
    old = rows.where("k % 3 <> 0 and artifact % 4 <> 0").select("artifact", "path", F.lit("x").alias("hash"))
    new = rows.where("k % 5 <> 0").select("artifact", "path", F.when(F.col("k") % 7 == 0, "y").otherwise("x").alias("hash"))
    return R.pin_changes(old, new)


def j7_attestation_drift(spark, sf):
    s = frame(spark, sf, "scans").select("package", "scan_id", "scanned_at", (F.col("scan_id") % 4 != 0).alias("attested"), F.when(F.col("scan_id") % 6 != 0, F.concat(F.lit("signer"), (F.col("scan_id") % 2).cast("string"))).alias("signer"), F.expr("concat('https://host/r', cast(scan_id % 2 as string), case when scan_id % 3 = 0 then '.git' when scan_id % 3 = 1 then '/' else '' end)").alias("repo"))
    first = s.groupBy("package").agg(F.min(F.struct("scan_id", "attested", "signer", "repo")).alias("s")).select("package", "s.*")
    last = s.groupBy("package").agg(F.max(F.struct("scan_id", "attested", "signer", "repo")).alias("s")).select("package", "s.*")
    return R.attestation_drift(first, last)


def j9_ledger(spark, sf):
    rows = frame(spark, sf, "findings").select(F.col("scan_id").alias("artifact"), F.when(F.col("scan_id") % 9 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("scan_id") % 100).cast("string"))).alias("digest"), "rule")
    approved = spark.createDataFrame([("",), *[(f"d{k}",) for k in range(0, 100, 3)]], "digest string")
    return R.ledger_suppression(rows, approved, "R-5").groupBy("suppressed").agg(F.count("*").alias("findings"), F.count_distinct("artifact").alias("artifacts"))


def j4_exploited(spark, sf):
    rows = frame(spark, sf, "findings").select("scan_id", F.when(F.col("scan_id") % 3 == 0, F.concat(F.lit("CVE-"), (F.col("scan_id") % 50).cast("string"))).otherwise(F.col("rule")).alias("rule"))
    kev = spark.createDataFrame([(f"CVE-{k}",) for k in range(0, 50, 4)], "cve string")
    epss = spark.createDataFrame([(f"CVE-{k}", "bad" if k % 10 == 0 else str(k / 64)) for k in range(0, 50, 2)], "cve string, epss string")
    return R.exploited(rows, kev, epss).groupBy("kev", "epss").agg(F.count("*").alias("findings"))


def j5_known_threats(spark, sf):
    threats = frame(spark, sf, "findings").select(F.concat(F.lit("TOOL-"), (F.col("scan_id") % 500).cast("string")).alias("name"), "severity", F.struct("scan_id", "line", "file", "rule").alias("position"))
    parts = read(spark, sf, "part").select("p_partkey", F.concat(F.lit("tool-"), F.col("p_partkey").cast("string")).alias("name"))
    return R.known_threats(parts, threats).groupBy("threat_severity").agg(F.count("*").alias("components"))


def j6_affected(spark, sf):
    comps = frame(spark, sf, "scans").select("scan_id", "ecosystem", F.col("package").alias("name"), F.when(F.col("scan_id") % 4 != 0, F.col("version")).alias("version"))
    adv = frame(spark, sf, "scans").where("scan_id % 13 = 0").select(F.concat(F.lit("ADV-"), (F.col("scan_id") % 11).cast("string")).alias("id"), "ecosystem", F.col("package").alias("name"), "version")
    return R.affected(comps, adv).select("id", "scan_id")


def j10_hash_hits(spark, sf):
    rows = frame(spark, sf, "findings").select("scan_id", F.md5(F.col("file").cast("binary")).alias("hash"))
    bad = rows.where("scan_id % 97 = 0").select("hash").distinct()
    return rows.join(bad, "hash", "left_semi").groupBy("scan_id").agg((F.count_distinct("hash") * 10).alias("added"))


def a53_verification(spark, sf):
    rows = frame(spark, sf, "scans")
    requests = rows.select("scan_id", F.concat(F.lit("h"), (F.col("scan_id") % 301).cast("string")).alias("artifact_hash"), F.when(F.col("scan_id") % 4 > 0, F.col("user_id")).alias("publisher_id"))
    threats = rows.where("verdict = 'CRITICAL_RISK' and scan_id % 20 = 1").select(F.concat(F.lit("h"), (F.col("scan_id") % 301).cast("string")).alias("hash"))
    publishers = rows.where("user_id % 3 > 0").groupBy(F.col("user_id").alias("publisher_id")).agg((F.count_if(F.col("verdict") == "ERROR") % 4).alias("flagged"), F.min(100.0 - F.col("risk_score")).alias("trust"))
    return R.verification(requests, threats, publishers).select("scan_id", "score", "verdict")


def r6_reputation(spark, sf):
    rows = frame(spark, sf, "scans").select(F.col("user_id").alias("publisher"), F.col("scanned_at").alias("seen_at"), F.col("scan_id").alias("id"), (F.col("risk_score") >= 88).alias("flagged"))
    return R.reputation(rows).select("publisher", "trust")


def severity_of_advisories(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.concat(F.when(F.col("l_linenumber") == 1, "MAL-").otherwise("ADV-"), F.col("l_suppkey").cast("string")).alias("id"), F.expr("case l_linenumber when 2 then 'moderate' when 3 then 'critical' when 4 then 'odd' end").alias("label"), F.when(F.col("l_linenumber") > 4, F.col("l_quantity") / 5).alias("base"))
    return rows.groupBy(S.advisory_severity(F.col("id"), F.col("label"), F.col("base")).alias("severity")).agg(F.count("*").alias("advisories"))


def cvss_scores(spark, sf):
    pick = lambda col, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(col) % len(values) + 1).cast("int"))
    rows = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("CVSS:3.1/AV:"), pick("o_orderkey", "NALP"), F.lit("/AC:"), pick("o_custkey", "LH"), F.lit("/PR:"), pick("o_orderkey", "NLH"), F.lit("/UI:"), pick("o_custkey", "NR"), F.lit("/S:"), pick("o_orderkey", "UC"), F.lit("/C:"), pick("o_custkey", "HLN"), F.lit("/I:"), pick("o_orderkey", "NLHX"), F.lit("/A:"), pick("o_custkey", "NHL")).alias("vector"))
    return rows.select("o_orderkey", "vector", F.round(S.cvss3(F.col("vector")), 1).alias("score"))


def _cvss_sql():
    def m(key, expr, values):
        cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items())
        return f"CASE {expr} {cases} END AS {key}"

    def pick(col, values):
        return f"substr('{values}', CAST({col} % {len(values)} + 1 AS BIGINT), 1)"

    parts = {"av": pick("o_orderkey", "NALP"), "ac": pick("o_custkey", "LH"), "pr": pick("o_orderkey", "NLH"), "ui": pick("o_custkey", "NR"), "s": pick("o_orderkey", "UC"), "c": pick("o_custkey", "HLN"), "i": pick("o_orderkey", "NLHX"), "a": pick("o_custkey", "NHL")}
    impact = {"H": 0.56, "L": 0.22, "N": 0.0}
    return f"""WITH v AS (SELECT o_orderkey, {", ".join(f"{e} AS {k}" for k, e in parts.items())} FROM orders),
w AS (SELECT o_orderkey, 'CVSS:3.1/AV:' || av || '/AC:' || ac || '/PR:' || pr || '/UI:' || ui || '/S:' || s || '/C:' || c || '/I:' || i || '/A:' || a AS vector, s = 'C' AS changed,
 {m("x1", "av", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2})}, {m("x2", "ac", {"L": 0.77, "H": 0.44})}, {m("p1", "pr", {"N": 0.85, "L": 0.68, "H": 0.5})}, {m("p2", "pr", {"N": 0.85, "L": 0.62, "H": 0.27})}, {m("x4", "ui", {"N": 0.85, "R": 0.62})}, {m("ci", "c", impact)}, {m("ii", "i", impact)}, {m("ai", "a", impact)} FROM v),
e AS (SELECT *, 8.22::DOUBLE * x1 * x2 * CASE WHEN changed THEN p1 ELSE p2 END * x4 AS ease, 1 - (1 - ci) * (1 - ii) * (1 - ai) AS isc FROM w),
f AS (SELECT *, CASE WHEN changed THEN 7.52::DOUBLE * (isc - 0.029::DOUBLE) - 3.25::DOUBLE * pow(isc - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * isc END AS part FROM e)
SELECT o_orderkey, vector, CASE WHEN part IS NULL THEN NULL WHEN part <= 0 THEN 0 ELSE round(ceil(round(least(CASE WHEN changed THEN 1.08::DOUBLE * (part + ease) ELSE part + ease END, 10) * 10, 6)) / 10, 1) END AS score FROM f"""


QUERIES = {
    "j2_u7_scan_diff": (
        j2_u7_scan_diff,
        f"""WITH o AS {_OLD}, n AS {_NEW}, d AS (
SELECT CASE WHEN EXISTS (SELECT 1 FROM o b WHERE {_SAME}) THEN 'unchanged' ELSE 'new' END AS change, severity, file FROM n a
UNION ALL SELECT 'resolved', severity, file FROM o a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE {_SAME}))
SELECT change, severity, count(*) AS findings, count(DISTINCT file) AS files FROM d GROUP BY 1, 2""",
    ),
    "j3_version_compare": (
        j3_version_compare,
        f"""WITH o AS (SELECT * FROM {_OLD} QUALIFY row_number() OVER (PARTITION BY file, rule, line ORDER BY scan_id DESC, severity DESC) = 1), n AS (SELECT * FROM {_NEW} QUALIFY row_number() OVER (PARTITION BY file, rule, line ORDER BY scan_id DESC, severity DESC) = 1),
c AS (SELECT a.severity AS old_severity, b.severity AS new_severity FROM o a FULL JOIN n b ON {_SAME})
SELECT CASE WHEN old_severity IS NULL THEN 'added' WHEN new_severity IS NULL THEN 'fixed' ELSE 'severity_changed' END AS change, old_severity, new_severity, count(*) AS findings FROM c WHERE old_severity IS DISTINCT FROM new_severity GROUP BY 1, 2, 3""",
    ),
    "a7_digests": (
        a7_digests,
        """WITH p AS (SELECT DISTINCT l_suppkey AS artifact, 'f' || CAST(l_partkey AS VARCHAR) AS path, sha256(CAST(l_partkey AS VARCHAR)) AS hash FROM lineitem)
SELECT artifact, count(*) AS files, sha256(unhex(string_agg(hex(encode(path)) || '00' || hex(encode(hash)) || '0A', '' ORDER BY path))) AS digest FROM p GROUP BY artifact""",
    ),
    "j8_pin_changes": (
        j8_pin_changes,
        """WITH r AS (SELECT l_suppkey AS artifact, l_partkey AS path, min(l_orderkey) AS k FROM lineitem GROUP BY 1, 2), o AS (SELECT artifact, path, 'x' AS h FROM r WHERE k % 3 <> 0 AND artifact % 4 <> 0),
n AS (SELECT artifact, path, CASE WHEN k % 7 = 0 THEN 'y' ELSE 'x' END AS h FROM r WHERE k % 5 <> 0 AND artifact IN (SELECT artifact FROM o))
SELECT coalesce(o.artifact, n.artifact) AS artifact, count(*) FILTER (o.h IS NULL) AS added, count(*) FILTER (o.h <> n.h) AS modified, count(*) FILTER (n.h IS NULL) AS removed FROM o FULL JOIN n ON o.artifact = n.artifact AND o.path = n.path GROUP BY 1 HAVING count(*) FILTER (o.h IS DISTINCT FROM n.h) > 0""",
    ),
    "j7_attestation_drift": (
        j7_attestation_drift,
        f"""WITH s AS (SELECT package, scan_id, scan_id % 4 <> 0 AS attested, CASE WHEN scan_id % 6 <> 0 THEN 'signer' || CAST(scan_id % 2 AS VARCHAR) END AS signer, 'https://host/r' || CAST(scan_id % 2 AS VARCHAR) AS repo FROM {SCANS}),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY package ORDER BY scan_id) = 1), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY package ORDER BY scan_id DESC) = 1), b AS (SELECT f.package, f.attested AS a1, l.attested AS a2, f.signer AS s1, l.signer AS s2, f.repo AS r1, l.repo AS r2 FROM f JOIN l ON f.package = l.package)
SELECT package, 'lost_attestation' AS drift FROM b WHERE a1 AND NOT a2 UNION ALL SELECT package, 'signer_changed' FROM b WHERE s1 <> s2 UNION ALL SELECT package, 'repo_changed' FROM b WHERE r1 <> r2""",
    ),
    "j9_ledger": (
        j9_ledger,
        f"""WITH f AS (SELECT scan_id, rule, scan_id % 9 <> 0 AND (scan_id % 100) % 3 = 0 AS good FROM {FINDINGS}), v AS (SELECT DISTINCT scan_id FROM f WHERE rule = 'R-5')
SELECT good AND v.scan_id IS NULL AS suppressed, count(*) AS findings, count(DISTINCT f.scan_id) AS artifacts FROM f LEFT JOIN v ON f.scan_id = v.scan_id GROUP BY 1""",
    ),
    "j4_exploited": (
        j4_exploited,
        f"""WITH f AS (SELECT CASE WHEN scan_id % 3 = 0 THEN scan_id % 50 END AS k FROM {FINDINGS})
SELECT coalesce(k % 4 = 0, false) AS kev, coalesce(CASE WHEN k % 2 = 0 AND k % 10 <> 0 THEN k / 64::DOUBLE END, 0) AS epss, count(*) AS findings FROM f GROUP BY 1, 2""",
    ),
    "j5_known_threats": (
        j5_known_threats,
        f"""WITH t AS (SELECT scan_id % 500 AS k, max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) AS s FROM {FINDINGS} GROUP BY 1)
SELECT CASE s WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' END AS threat_severity, count(*) AS components FROM part LEFT JOIN t ON p_partkey = k GROUP BY 1""",
    ),
    "j6_affected": (
        j6_affected,
        f"""WITH s AS (SELECT * FROM {SCANS}), a AS (SELECT DISTINCT 'ADV-' || CAST(scan_id % 11 AS VARCHAR) AS id, ecosystem, package, version FROM s WHERE scan_id % 13 = 0)
SELECT id, scan_id FROM s JOIN a ON s.ecosystem = a.ecosystem AND s.package = a.package AND s.version = a.version WHERE scan_id % 4 <> 0""",
    ),
    "j10_hash_hits": (j10_hash_hits, f"SELECT scan_id, count(DISTINCT file) * 10 AS added FROM {FINDINGS} WHERE file IN (SELECT file FROM {FINDINGS} WHERE scan_id % 97 = 0) GROUP BY 1"),
    "a53_verification": (
        a53_verification,
        f"""WITH t AS (SELECT DISTINCT scan_id % 301 AS h FROM {SCANS} WHERE verdict = 'CRITICAL_RISK' AND scan_id % 20 = 1), p AS (SELECT user_id, count(*) FILTER (verdict = 'ERROR') % 4 AS flagged, min(100 - risk_score) AS trust FROM {SCANS} WHERE user_id % 3 > 0 GROUP BY 1),
s AS (SELECT scan_id, CASE WHEN h IS NOT NULL THEN 50::DOUBLE ELSE 0 END + coalesce(flagged * 5, 0) + CASE WHEN trust < 30 THEN 10 ELSE 0 END AS score FROM {SCANS} r LEFT JOIN t ON h = scan_id % 301 LEFT JOIN p ON p.user_id = r.user_id AND scan_id % 4 > 0)
SELECT scan_id, score, CASE WHEN score >= 50 THEN 'CRITICAL_RISK' WHEN score >= 25 THEN 'HIGH_RISK' WHEN score >= 10 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS verdict FROM s""",
    ),
    "r6_reputation": (
        r6_reputation,
        f"""SELECT user_id AS publisher, list_reduce(list_prepend(100.0::DOUBLE, list(CASE WHEN risk_score >= 88 THEN -15.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY scanned_at, scan_id)), lambda x, y: least(100.0::DOUBLE, greatest(0.0::DOUBLE, x + y))) AS trust FROM {SCANS} GROUP BY 1""",
    ),
    "severity_of_advisories": (
        severity_of_advisories,
        """SELECT CASE l_linenumber WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' ELSE CASE WHEN l_quantity / 5 >= 9 THEN 'CRITICAL' WHEN l_quantity / 5 >= 7 THEN 'HIGH' WHEN l_quantity / 5 >= 4 THEN 'MEDIUM' ELSE 'LOW' END END AS severity, count(*) AS advisories FROM lineitem GROUP BY 1""",
    ),
    "cvss_scores": (cvss_scores, _cvss_sql()),
}
