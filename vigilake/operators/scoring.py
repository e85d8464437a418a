"""Scores, verdicts and summaries of findings. Frames have scan_id, file, rule, line, severity, phase, weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as S
from ..streaming.runs import shared_path


def scan_scores(findings: DataFrame, least_severity: str | None = None) -> DataFrame:
    """scan_id, score, verdict, findings: severity times weight, added up; only a critical finding makes a scan critical.

    least_severity drops weaker findings first, which lowers the score.
    """
    rows = findings
    if least_severity:
        rows = rows.where(S.lookup(F.col("severity"), S.RANK, 0) >= S.RANK[least_severity])
    scored = rows.groupBy("scan_id").agg(
        F.sum(S.cli_score(F.col("severity"), F.col("weight"))).cast("long").alias("score"),
        F.bool_or(F.col("severity") == "CRITICAL").alias("critical"),
        F.count("*").alias("findings"),
    )
    verdict = F.when(F.col("critical"), "CRITICAL_RISK").otherwise(S.verdict(F.col("score"), S.CLI_CUTS))
    return scored.select("scan_id", "score", verdict.alias("verdict"), "findings")


def api_scores(findings: DataFrame) -> DataFrame:
    """scan_id, score, verdict with phase and context weights and a score threshold for critical."""
    part = S.api_score(F.col("severity"), F.col("phase"), F.col("weight"), F.col("file"))
    scored = findings.groupBy("scan_id").agg(F.round(F.sum(part), 6).alias("score"))
    return scored.withColumn("verdict", S.verdict(F.col("score")))


def failing_scans(findings: DataFrame, threshold: str) -> DataFrame:
    """scan_id, exit_code: 1 if any finding is at least as severe as the threshold."""
    bad = S.lookup(F.col("severity"), S.RANK, 0) >= S.RANK[threshold]
    return findings.groupBy("scan_id").agg(F.bool_or(bad).cast("int").alias("exit_code"))


def confidence_summary(findings: DataFrame) -> DataFrame:
    """By scan: counts of high, medium and low confidence, their mean (1, 0.5, 0) and how likely false positives are."""
    rows = findings.select("scan_id", S.confidence(F.col("severity"), F.col("file")).alias("c"))
    counted = rows.groupBy("scan_id").agg(*[F.count_if(F.col("c") == k.upper()).alias(k) for k in ("high", "medium", "low")], F.count("*").alias("n"))
    share = F.col("low") / F.col("n")
    return counted.select(
        "scan_id", "high", "medium", "low",
        F.round((F.col("high") + 0.5 * F.col("medium")) / F.col("n"), 3).alias("confidence"),
        F.when(share > 0.7, "high").when(share > 0.4, "medium").otherwise("low").alias("false_positives"),
    )


# Kinds of threats by phase, and points of severities.
THREATS = {
    "install_hooks": "installation_threats", "code_patterns": "code_execution_threats", "network_exfil": "exfiltration_threats", "credentials": "credential_threats", "obfuscation": "evasion_threats",
    "provenance": "supply_chain_threats", "prompt_injection": "ai_threats", "skill_security": "ai_threats", "llm_analysis": "advanced_threats",
}
THREAT_POINTS = {"INFO": 0.5, "LOW": 1.0, "MEDIUM": 2.0, "HIGH": 3.0, "CRITICAL": 5.0}


def threat_kind(phase: Column) -> Column:
    return F.coalesce(S.lookup(phase, THREATS), F.lit("unknown_threats"))


def threat_categories(findings: DataFrame) -> DataFrame:
    """scan_id, kind, severity, findings: what a scan has of each kind of threat and severity."""
    return findings.groupBy("scan_id", threat_kind(F.col("phase")).alias("kind"), "severity").agg(F.count("*").alias("findings"))


def threat_scores(findings: DataFrame, insights: DataFrame) -> DataFrame:
    """By scan: risk and level, and whether threats come in many phases, with many sure insights, and in many files.

    Each kind of threat scores severity times weight of its findings, and each category of insights(scan_id, category, confidence, adjustment, files) 3 and the adjustment times
    confidence, at most 10 each; their sum is critical over 20, high over 15, medium over 8. Flags are for over 3 phases, over 2 insights surer than 0.8, and over 10 files of both.
    """
    points = F.coalesce(S.lookup(F.col("severity"), THREAT_POINTS), F.lit(1.0)) * F.coalesce("weight", F.lit(1))
    static = findings.groupBy("scan_id", threat_kind(F.col("phase")).alias("kind")).agg(F.sum(points).alias("points"))
    told = insights.groupBy("scan_id", F.concat(F.lit("llm_"), "category").alias("kind")).agg(F.sum((F.lit(3.0) + F.coalesce("adjustment", F.lit(0.0))) * F.col("confidence")).alias("points"))
    risk = static.unionByName(told).groupBy("scan_id").agg(F.sum(F.least("points", F.lit(10.0))).alias("risk"))
    phases = findings.groupBy("scan_id").agg((F.count_distinct("phase") > 3).alias("many_phases"))
    sure = insights.groupBy("scan_id").agg((F.count_if(F.col("confidence") > 0.8) > 2).alias("sure_insights"))
    files = findings.select("scan_id", "file").unionByName(insights.select("scan_id", F.explode("files").alias("file"))).groupBy("scan_id").agg((F.count_distinct("file") > 10).alias("widespread"))
    level = F.when(F.col("risk") > 20, "critical").when(F.col("risk") > 15, "high").when(F.col("risk") > 8, "medium").otherwise("low")
    out = risk
    for part in (phases, sure, files):
        out = out.join(part, "scan_id", "left")
    no = F.lit(False)
    return out.select("scan_id", F.round("risk", 6).alias("risk"), level.alias("level"), *[F.coalesce(c, no).alias(c) for c in ("many_phases", "sure_insights", "widespread")])


def security_trend(before: DataFrame, after: DataFrame, key: Column | str = "key", band: int = 5) -> DataFrame:
    """Key, scores of two versions, change and trend; a version without findings has score 0."""

    def total(rows, name):
        return rows.groupBy("key").agg(F.sum(S.lookup(F.col("severity"), S.SECURITY_SEVERITY, 0) * F.col("weight")).cast("long").alias(name))

    both = total(before, "old_score").join(total(after, "new_score"), "key", "full_outer").na.fill(0, ["old_score", "new_score"])
    change = F.col("new_score") - F.col("old_score")
    trend = F.when(change > band, "worse").when(change < -band, "better").otherwise("same")
    return both.select("key", "old_score", "new_score", change.alias("change"), trend.alias("trend"))


def compliance_scores(findings: DataFrame, mapping: DataFrame) -> DataFrame:
    """framework, findings, controls, score: 100 less twice the severities' weights, at least 0.

    mapping(rule, refs): refs are 'framework:control' of a rule; it is a small table of rules.
    """
    refs = mapping.select("rule", F.explode("refs").alias("ref")).select("rule", F.split("ref", ":")[0].alias("framework"), F.split("ref", ":")[1].alias("control"))
    return (
        findings.groupBy("rule", "severity").agg(F.count("*").alias("n"))
        .join(refs, "rule")
        .groupBy("framework")
        .agg(
            F.sum("n").cast("long").alias("findings"),
            F.count_distinct("control").alias("controls"),
            F.greatest(F.lit(0), 100 - 2 * F.sum(S.lookup(F.col("severity"), S.COMPLIANCE_SEVERITY, 0) * F.col("n"))).cast("long").alias("score"),
        )
    )


def detection_rates(samples: DataFrame) -> DataFrame:
    """threshold, recall, false_positive_rate, precision from samples(sample, malicious, severity), a row a finding or a null severity."""
    top = samples.groupBy("sample", "malicious").agg(F.max(F.coalesce(S.lookup(F.col("severity"), S.RANK), F.lit(0))).alias("top"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("threshold"), F.lit(v).alias("least")) for k, v in S.RANK.items()])).alias("level")
    hit = F.col("top") >= F.col("level.least")
    counts = top.select("malicious", "top", levels).groupBy("level.threshold").agg(
        F.count_if(hit & F.col("malicious")).alias("tp"), F.count_if(F.col("malicious")).alias("p"), F.count_if(hit & ~F.col("malicious")).alias("fp"), F.count_if(~F.col("malicious")).alias("n")
    )
    return counts.select("threshold", F.round(F.col("tp") / F.col("p"), 4).alias("recall"), F.round(F.col("fp") / F.col("n"), 4).alias("false_positive_rate"), F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 4).alias("precision"))


def sorted_percentiles(values: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the values at the places floor(n * share) of the sorted values, not interpolated. Null values are the least; a null group is one.

    Equal values are counted first, then sorted over all tasks by group and value, so a group of any size lies in many of them. A value's place is
    its place in its part of the group, after what the parts before it hold: one number for a group and part.
    """
    counted = values.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    path = shared_path(values.sparkSession, "percentiles")
    counted.repartitionByRange("g", "v").sortWithinPartitions("g", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    rows = values.sparkSession.read.parquet(path)
    sums = rows.groupBy("g", "part").agg(F.sum("n").alias("m"))
    ordered = Window.partitionBy("g").orderBy("part")
    parts = sums.select(F.col("g").alias("g2"), F.col("part").alias("part2"), (F.sum("m").over(ordered) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("g")).alias("all"))
    inside = Window.partitionBy("g", "part").orderBy("v")
    placed = rows.withColumn("upto", F.sum("n").over(inside)).join(parts, F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2")))
    end = F.col("before") + F.col("upto")

    def at(share: float) -> Column:
        place = F.least(F.floor(F.col("all") * share), F.col("all") - 1)
        return F.max(F.when((place < end) & (place >= end - F.col("n")), F.col("v")))

    return placed.groupBy(F.col("g").alias(group)).agg(*[at(p).alias(k) for k, p in shares.items()])
