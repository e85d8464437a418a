"""A scan of files from texts to scores: what each part finds, what users and approvals take out, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import severity as S
from . import context, reconcile, rulescan, scanning, scoring

PHASES = ["install_hooks", "code_patterns", "network_exfil", "credentials", "obfuscation", "provenance", "prompt_injection", "skill_security", "inference_security"]


def phase_runs(packs: DataFrame) -> DataFrame:
    """Rules of packs(pack, id, phase, ...) with runs: the phases of their pack. Each phase runs all rules of every pack that has one rule of it."""
    runs = packs.groupBy("pack").agg(F.sort_array(F.collect_set("phase")).alias("runs"))
    return packs.join(F.broadcast(runs), "pack").drop("pack")


def scan(
    files: DataFrame, packs: DataFrame, signatures: DataFrame | None = None, metadata_rules: list[dict] | None = None, user_rules: DataFrame | None = None,
    approved: DataFrame | None = None, veto_rule: str = "", phases: list[str] | None = None, least_severity: str | None = None,
) -> DataFrame:
    """scan_id, path, rule, phase, severity, weight, line, offset: the findings of files(scan_id, path, text, digest) that stay.

    packs: rules as for scan_rules, with pack. A rule gives a finding for each phase that its pack runs in; none in code_patterns on declaration files.
    signatures: rules as for scan_rules, without packs. Both see texts without cloaking characters; these are told of, in phase obfuscation, from the texts as they are.
    metadata_rules: rules over names and sizes (provenance). phases: the parts that run. least_severity drops weaker findings before all that follows.
    user_rules: as for without_suppressed, by phase and rule. approved: digests of artifacts, of which all findings go but for those with a finding of veto_rule.
    Two files of one path in a scan are one. Lines and offsets are null where a finding is of the whole file. Null texts count as empty.
    """
    runs = [p for p in (phases or PHASES) if p != "provenance"]
    keyed = files.select("scan_id", "path", F.coalesce("text", F.lit("")).alias("text"))
    chosen = phase_runs(packs).withColumn("runs", F.array_intersect("runs", F.array(*map(F.lit, runs)).cast("array<string>"))).where(F.size("runs") > 0)
    hits = rulescan.scan_rules(keyed, chosen).withColumn("phase", F.explode(F.when(N.is_declaration_file(F.col("path")), F.array_remove("runs", "code_patterns")).otherwise(F.col("runs"))))
    columns = ["scan_id", "path", "rule", "phase", "severity", "weight", "line", "offset"]
    whole = {"line": F.lit(None).cast("int"), "offset": F.lit(None).cast("long")}
    found = hits.select(*columns)
    if signatures is not None:
        found = found.unionByName(rulescan.scan_rules(keyed, signatures).select(*columns))
    if "obfuscation" in runs:
        unseen = scanning.hidden_characters(keyed.withColumn("__key", F.struct("scan_id", "path")), "__key", "text", F.col("__key.path"))
        found = found.unionByName(unseen.select("__key.*", "rule", F.lit("obfuscation").alias("phase"), "severity", "weight", "line", F.lit(None).cast("long").alias("offset")))
    if metadata_rules and (not phases or "provenance" in phases):
        sizes = scanning.provenance(keyed.select(F.struct("scan_id", "path").alias("key"), "path", F.octet_length("text").alias("length")), metadata_rules, ("key",))
        found = found.unionByName(sizes.select("key.*", "rule", F.lit("provenance").alias("phase"), "severity", "weight").withColumns(whole).select(*columns))
    if least_severity:
        found = found.where(S.lookup(F.col("severity"), S.RANK, 0) >= S.RANK[least_severity])
    if user_rules is not None:
        told = found.select("*", F.col("phase").alias("pattern_type"), F.col("path").alias("file"), F.lit("").alias("evidence"))
        found = context.without_suppressed(told, user_rules).select(*columns)
    if approved is not None:
        digests = files.select(F.col("scan_id").alias("__scan"), "digest").distinct()
        told = found.join(digests, found.scan_id == digests["__scan"]).drop("__scan").withColumn("artifact", F.col("scan_id"))
        found = reconcile.ledger_suppression(told, approved, veto_rule).where("not suppressed").select(*columns)
    return found


def verdicts(found: DataFrame, files: DataFrame) -> DataFrame:
    """scan_id, score, verdict, findings for every scan of the files; a scan without findings is of low risk."""
    scored = scoring.scan_scores(found).withColumnRenamed("scan_id", "__scan")
    every = files.select("scan_id").distinct().join(scored, F.col("scan_id") == F.col("__scan"), "left")
    return every.select("scan_id", F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("verdict", F.lit("LOW_RISK")).alias("verdict"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))
