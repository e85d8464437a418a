"""Queries over lockfiles and reports, made from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import lockfiles as L
from ..sources import reports as R
from ..streaming import runs
from .inputs import frame, read, source

FINDINGS, SCANS = source("findings"), source("scans")


def _files(spark, sf, text):
    return read(spark, sf, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("path"), F.expr(text).alias("text"))


def s8_package_lock(spark, sf):
    v3 = """concat('{"packages":{"":{"version":"9"},"node_modules/a":{"version":"1.', s_suppkey, '"},"node_modules/a/node_modules/@s/b":{"version":"2.0"}}}')"""
    v1 = """concat('{"dependencies":{"c":{"version":"3.', s_suppkey, '","dependencies":{"d":{"version":"4.0","dependencies":{"e":{}}}}},"f":{"version":"5"}}}')"""
    return L.package_lock(_files(spark, sf, f"case s_suppkey % 3 when 0 then {v3} when 1 then {v1} else '{{broken' end"))


def s9_requirements(spark, sf):
    text = r"concat('# all\n\nalpha==1.', s_suppkey, '  # pinned\nbeta>=2\r\n-r other.txt\n--hash x\ngamma[x]==3.0; python_version > \'3\'\n', if(s_suppkey % 2 = 0, 'delta', ''))"
    return L.requirements(_files(spark, sf, text))


def s10_cargo_lock(spark, sf):
    text = r"""concat('version = 3\n\n[[package]]\nname = "a"\nversion = "1.', s_suppkey, '"\nchecksum = "', md5(cast(s_suppkey as string)), '"\n\n[[package]]\nname = "b"\nversion = "2"\ndependencies = [\n "a",\n]\n')"""
    return L.cargo_lock(_files(spark, sf, text))


def s11_go_mod(spark, sf):
    text = r"concat('module m\n\ngo 1.21\n\nrequire h/a v1.', s_suppkey, '.0 // indirect\n\nrequire (\n\th/b v2.0.0\n\t// h/c v3.0.0\n)\n')"
    return L.go_mod(_files(spark, sf, text))


def _written(spark, texts, name):
    """A folder with one file for each row of texts(value)."""
    path = runs.shared_path(spark, name)
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _by_nation(spark, sf, entry, name):
    rows = read(spark, sf, "supplier").selectExpr("s_nationkey", f"{entry} as e").groupBy("s_nationkey").agg(F.collect_list("e").alias("es"))
    return rows.select(F.to_json(F.struct(F.col("es").alias(name))).alias("value"))


def s13_kev(spark, sf):
    texts = _by_nation(spark, sf, "named_struct('cveID', concat('CVE-', s_suppkey % 40), 'product', s_name)", "vulnerabilities")
    return S.kev(spark, _written(spark, texts, "kev"))


def s14_epss(spark, sf):
    texts = _by_nation(spark, sf, "named_struct('cve', concat('CVE-', s_suppkey), 'epss', case s_suppkey % 3 when 0 then 'none' else concat('0.', s_suppkey % 9) end)", "data")
    return S.epss(spark, _written(spark, texts, "epss")).select("cve", F.round("epss", 4).cast("double").alias("epss"))


def s7_signatures(spark, sf):
    entry = "named_struct('id', concat('S-', s_suppkey), 'phase', if(s_suppkey % 2 = 0, 'credentials', null), 'severity', if(s_suppkey % 3 = 0, 'HIGH', null), 'pattern', if(s_suppkey % 5 = 0, null, 'x+'), 'description', s_name)"
    whole = _by_nation(spark, sf, entry, "signatures")
    plain = whole.select(F.get_json_object("value", "$.signatures").alias("value"))
    both = whole.where("length(value) % 2 = 0").unionByName(plain.join(whole.where("length(value) % 2 = 1").select(F.get_json_object("value", "$.signatures").alias("value")), "value", "left_semi"))
    return S.signatures(spark, _written(spark, both, "signatures")).select("id", "phase", "severity", "pattern")


def s5_rule_pack(spark, sf):
    rules = F.collect_list(F.struct(F.concat(F.lit("R-"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("credentials").alias("phase"), F.lit("HIGH").alias("severity"), F.lit("x+").alias("pattern"), (F.col("s_suppkey") % 4).cast("int").alias("weight")))
    packs = read(spark, sf, "supplier").groupBy("s_nationkey").agg(rules.alias("rules"))
    texts = packs.select(F.when(F.col("s_nationkey") == 3, "{broken").otherwise(F.to_json(F.struct(F.struct(F.concat(F.lit("pack-"), F.col("s_nationkey").cast("string")).alias("id"), F.lit("1").alias("version")).alias("meta"), "rules"))).alias("value"))
    return S.rule_pack(spark, _written(spark, texts, "packs")).select("pack", "id", "phase", "severity", "pattern", "weight")


def s2_text_gate(spark, sf):
    texts = read(spark, sf, "nation").select(F.concat("n_name", F.when(F.col("n_nationkey") % 4 == 0, F.expr("char(0)")).otherwise(""), F.lit(" é")).alias("value"))
    return S.source_tree(spark, _written(spark, texts, "tree")).select("length", F.rtrim(F.regexp_replace("text", "\n", "")).alias("text"))


def _components(spark, sf):
    return s8_package_lock(spark, sf).withColumn("threat_severity", F.when(F.col("name").isin("a", "d"), "HIGH"))


def a50_sbom_counts(spark, sf):
    return L.sbom_counts(_components(spark, sf))


def s20_cyclonedx(spark, sf):
    reports = R.cyclonedx(_components(spark, sf).withColumn("package_type", F.lit("npm")))
    parts = F.from_json(F.get_json_object("report", "$.components"), "array<struct<name:string,version:string,purl:string>>")
    return reports.select("path", F.get_json_object("report", "$.specVersion").alias("spec"), F.explode(parts).alias("c")).select("path", "spec", "c.name", "c.purl")


def s19_sarif(spark, sf):
    reports = R.sarif(frame(spark, sf, "findings").withColumn("snippet", F.concat_ws(": ", "rule", "file")))
    result = "array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>"
    rows = reports.select("scan_id", F.size(F.from_json(F.get_json_object("report", "$.runs[0].tool.driver.rules"), "array<struct<id:string>>")).alias("rules"), F.explode(F.from_json(F.get_json_object("report", "$.runs[0].results"), result)).alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return rows.select("scan_id", "rules", F.col("r.ruleId").alias("rule"), "r.level", F.col("r.message.text").alias("said"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"))


def s21_rss(spark, sf):
    said = F.expr("transform(sequence(1, findings_count % 7 + 1), k -> named_struct('severity', if(k % 2 = 0, 'LOW', 'HIGH'), 'description', concat('<', k, '> & more')))")
    rows = frame(spark, sf, "scans").select("scan_id", "ecosystem", "package", "version", "verdict", F.col("risk_score").alias("score"), F.slice(said, F.lit(1), F.col("findings_count") % 7).alias("findings"), "scanned_at")
    return R.rss(rows, "https://scans.example", items=40)


def s21_json_feed(spark, sf):
    item = "array<struct<id:string,title:string,date_published:string>>"
    return R.feed(frame(spark, sf, "scans"), 50).select(F.posexplode(F.from_json(F.get_json_object("feed", "$.items"), item)).alias("position", "i")).select("position", "i.*")


_LOCK = "(SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS path, name, version FROM supplier JOIN (VALUES (0, 'a', NULL), (0, '@s/b', '2.0'), (1, 'c', NULL), (1, 'd', '4.0'), (1, 'e', NULL), (1, 'f', '5')) v(k, name, fixed) ON s_suppkey % 3 = k, LATERAL (SELECT coalesce(fixed, CASE name WHEN 'a' THEN '1.' || CAST(s_suppkey AS VARCHAR) WHEN 'c' THEN '3.' || CAST(s_suppkey AS VARCHAR) END) AS version))"

QUERIES = {
    "s13_kev": (s13_kev, "SELECT DISTINCT 'CVE-' || CAST(s_suppkey % 40 AS VARCHAR) AS cve FROM supplier"),
    "s14_epss": (s14_epss, "SELECT 'CVE-' || CAST(s_suppkey AS VARCHAR) AS cve, round(CAST(('0.' || CAST(s_suppkey % 9 AS VARCHAR)) AS FLOAT), 4)::DOUBLE AS epss FROM supplier WHERE s_suppkey % 3 > 0"),
    "s7_signatures": (s7_signatures, "SELECT 'S-' || CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'credentials' ELSE 'code_patterns' END AS phase, CASE WHEN s_suppkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, 'x+' AS pattern FROM supplier WHERE s_suppkey % 5 > 0"),
    "s5_rule_pack": (s5_rule_pack, "SELECT 'pack-' || CAST(s_nationkey AS VARCHAR) AS pack, 'R-' || CAST(s_suppkey AS VARCHAR) AS id, 'credentials' AS phase, 'HIGH' AS severity, 'x+' AS pattern, CAST(s_suppkey % 4 AS INTEGER) AS weight FROM supplier WHERE s_nationkey <> 3"),
    "s2_text_gate": (s2_text_gate, "SELECT CAST(octet_length(encode(n_name || ' é')) + 1 AS BIGINT) AS length, n_name || ' é' AS text FROM nation WHERE n_nationkey % 4 > 0"),
    "s8_package_lock": (s8_package_lock, f"SELECT * FROM {_LOCK}"),
    "s9_requirements": (s9_requirements, "SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS path, name, CASE name WHEN 'alpha' THEN '1.' || CAST(s_suppkey AS VARCHAR) WHEN 'gamma' THEN '3.0' END AS version FROM supplier, (VALUES ('alpha'), ('beta'), ('gamma'), ('delta')) v(name) WHERE name <> 'delta' OR s_suppkey % 2 = 0"),
    "s10_cargo_lock": (s10_cargo_lock, "SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS path, name, CASE name WHEN 'a' THEN '1.' || CAST(s_suppkey AS VARCHAR) ELSE '2' END AS version, CASE name WHEN 'a' THEN md5(CAST(s_suppkey AS VARCHAR)) END AS checksum FROM supplier, (VALUES ('a'), ('b')) v(name)"),
    "s11_go_mod": (s11_go_mod, "SELECT 'p' || CAST(s_suppkey AS VARCHAR) AS path, name, CASE name WHEN 'h/a' THEN 'v1.' || CAST(s_suppkey AS VARCHAR) || '.0' ELSE 'v2.0.0' END AS version FROM supplier, (VALUES ('h/a'), ('h/b')) v(name)"),
    "a50_sbom_counts": (a50_sbom_counts, f"SELECT path, count(*) AS components, count(*) FILTER (name IN ('a', 'd')) AS threats FROM {_LOCK} GROUP BY 1"),
    "s20_cyclonedx": (s20_cyclonedx, f"SELECT path, '1.5' AS spec, name, 'pkg:npm/' || name || coalesce('@' || version, '') AS purl FROM {_LOCK}"),
    "s19_sarif": (
        s19_sarif,
        f"""SELECT f.scan_id, CAST(rules AS INTEGER) AS rules, rule, CASE severity WHEN 'LOW' THEN 'note' WHEN 'MEDIUM' THEN 'warning' ELSE 'error' END AS level, rule || ': ' || file AS said, file AS uri, CAST(coalesce(line, 1) AS INTEGER) AS line
FROM {FINDINGS} f JOIN (SELECT scan_id, count(DISTINCT rule) AS rules FROM {FINDINGS} GROUP BY 1) r ON r.scan_id = f.scan_id""",
    ),
    "s21_rss": (
        s21_rss,
        f"""WITH n AS (SELECT *, 'https://scans.example/scans/' || ecosystem || '/' || package AS link, CAST(findings_count % 7 AS INTEGER) AS k FROM {SCANS} ORDER BY scanned_at DESC, scan_id DESC LIMIT 40)
SELECT '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Scans</title><link>https://scans.example</link>' || string_agg('<item><title>[' || verdict || '] ' || package || '@' || version || ' (' || upper(ecosystem) || ')</title><link>' || link || '</link><description>Risk score: ' || CAST(risk_score AS VARCHAR) || '. ' || CAST(k AS VARCHAR) || ' finding(s). '
 || CASE WHEN k = 0 THEN 'No notable findings' ELSE array_to_string(list_transform(range(1, least(k, 5) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 'LOW' ELSE 'HIGH' END || ': &lt;' || CAST(i AS VARCHAR) || '&gt; &amp; more'), '; ') END
 || '.</description><pubDate>' || strftime(scanned_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><guid>' || link || '?v=' || version || '</guid><category>' || ecosystem || '</category><category>' || verdict || '</category></item>', '' ORDER BY scanned_at DESC, scan_id DESC) || '</channel></rss>' AS feed FROM n""",
    ),
    "s21_json_feed": (
        s21_json_feed,
        f"SELECT CAST(row_number() OVER (ORDER BY scanned_at DESC, scan_id DESC) - 1 AS INTEGER) AS position, CAST(scan_id AS VARCHAR) AS id, ecosystem || ' ' || package || ' ' || version || ' ' || verdict AS title, strftime(scanned_at, '%Y-%m-%dT%H:%M:%SZ') AS date_published FROM {SCANS} QUALIFY position < 50",
    ),
}
