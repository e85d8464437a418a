"""Comparing what was found at different times: scans, versions, content pins and attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import severity as S


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    out = None
    for k in keys:
        part = a[k].eqNullSafe(b[k])
        out = part if out is None else out & part
    return out


def scan_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("file", "rule", "line")) -> DataFrame:
    """Findings with change: new, unchanged (from after) or resolved (from before). Null lines are equal; repeats stay."""
    keys = list(keys)
    old = before.select(*keys).distinct()
    new = after.select(*keys).distinct()
    return (
        after.join(old, _same(after, old, keys), "left_anti").withColumn("change", F.lit("new"))
        .unionByName(after.join(old, _same(after, old, keys), "left_semi").withColumn("change", F.lit("unchanged")))
        .unionByName(before.join(new, _same(before, new, keys), "left_anti").withColumn("change", F.lit("resolved")))
    )


def version_compare(before: DataFrame, after: DataFrame, order: str) -> DataFrame:
    """file, rule, line, change (added, fixed, severity_changed), old_severity, new_severity.

    Of findings that share file, rule and line only the last by the given order counts.
    """
    keys = ["file", "rule", "line"]

    def last(rows, name):
        top = Window.partitionBy(*keys).orderBy(F.col(order).desc())
        return rows.withColumn("__n", F.row_number().over(top)).where("__n = 1").select(*keys, F.col("severity").alias(name))

    old, new = last(before, "old_severity"), last(after, "new_severity")
    both = old.alias("o").join(new.alias("n"), F.expr("o.file <=> n.file and o.rule <=> n.rule and o.line <=> n.line"), "full_outer")
    change = F.when(F.col("old_severity").isNull(), "added").when(F.col("new_severity").isNull(), "fixed").when(F.col("old_severity") != F.col("new_severity"), "severity_changed")
    return both.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], change.alias("change"), "old_severity", "new_severity").where("change is not null")


def content_digests(files: DataFrame) -> DataFrame:
    """artifact, files, digest: SHA-256 of path, NUL, hash, LF of each file in order of its path.

    An artifact's file list is its manifest; it is gathered in one row, as the digest needs it.
    """
    line = F.concat(F.encode("path", "utf-8"), F.lit(b"\x00"), F.encode("hash", "utf-8"), F.lit(b"\n"))
    parts = F.array_sort(F.collect_list(F.struct("path", F.hex(line).alias("line"))))
    return files.groupBy("artifact").agg(F.count("*").alias("files"), F.sha2(F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["line"]))), 256).alias("digest"))


def pin_changes(pinned: DataFrame, current: DataFrame) -> DataFrame:
    """artifact, added, modified, removed of the artifacts whose files changed; both frames have artifact, path, hash.

    Artifacts that were never pinned are silent.
    """
    known = pinned.select("artifact").distinct()
    now = current.join(known, "artifact", "left_semi").select("artifact", "path", F.col("hash").alias("new"))
    both = pinned.select("artifact", "path", F.col("hash").alias("old")).join(now, ["artifact", "path"], "full_outer")
    return (
        both.groupBy("artifact")
        .agg(
            F.count_if(F.col("old").isNull()).alias("added"),
            F.count_if(F.col("old") != F.col("new")).alias("modified"),
            F.count_if(F.col("new").isNull()).alias("removed"),
        )
        .where("added + modified + removed > 0")
    )


def attestation_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """package, drift: lost_attestation, signer_changed or repo_changed, one row each; frames have package, attested, signer, repo."""

    def plain(repo):
        return F.regexp_replace(F.rtrim(repo, F.lit("/")), r"\.git$", "")

    b, c = baseline.alias("b"), current.alias("c")
    rows = b.join(c, "package").select(
        "package",
        F.array_compact(
            F.array(
                F.when(F.col("b.attested") & ~F.col("c.attested"), "lost_attestation"),
                F.when(F.col("b.signer") != F.col("c.signer"), "signer_changed"),
                F.when(plain(F.col("b.repo")) != plain(F.col("c.repo")), "repo_changed"),
            )
        ).alias("drifts"),
    )
    return rows.select("package", F.explode("drifts").alias("drift"))


def ledger_suppression(findings: DataFrame, approved: DataFrame, veto_rule: str) -> DataFrame:
    """findings(artifact, digest, rule, ...) with suppressed: the artifact's digest is approved and no finding of it has the veto rule. Empty digests never match."""
    vetoed = findings.where(F.col("rule") == veto_rule).select(F.col("artifact").alias("__v")).distinct()
    good = approved.where("digest <> ''").select(F.col("digest").alias("__d")).distinct()
    rows = findings.join(good, findings.digest == good["__d"], "left").join(vetoed, findings.artifact == vetoed["__v"], "left")
    return rows.withColumn("suppressed", F.col("__d").isNotNull() & F.col("__v").isNull()).drop("__d", "__v")


def known_threats(components: DataFrame, threats: DataFrame) -> DataFrame:
    """components(name, ...) with threat_severity of the most severe known threat of that name, the first listed one of equals."""
    best = Window.partitionBy(F.lower("name")).orderBy(S.lookup(F.col("severity"), S.RANK, 0).desc(), "position")
    top = threats.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(F.lower("name").alias("__name"), F.col("severity").alias("threat_severity"))
    return components.join(top, F.lower(components.name) == top["__name"], "left").drop("__name")


def exploited(findings: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """findings(rule, ...) with kev and epss of the rules that are CVE numbers; false and 0 elsewhere."""
    cves = F.when(F.col("rule").startswith("CVE-"), F.col("rule"))
    known = kev.select(F.col("cve").alias("__k")).distinct()
    odds = epss.select(F.col("cve").alias("__e"), F.expr("try_cast(epss as double)").alias("__p")).where("__p is not null").groupBy("__e").agg(F.max("__p").alias("__p"))
    rows = findings.withColumn("__c", cves)
    rows = rows.join(known, F.col("__c") == F.col("__k"), "left").join(odds, F.col("__c") == F.col("__e"), "left")
    return rows.select(*findings.columns, F.col("__k").isNotNull().alias("kev"), F.coalesce("__p", F.lit(0.0)).alias("epss"))


def affected(components: DataFrame, advisories: DataFrame) -> DataFrame:
    """components(ecosystem, name, version) with an advisory of that very version; unversioned ones have none."""
    return components.where("version is not null").join(advisories.dropDuplicates(["id", "ecosystem", "name", "version"]), ["ecosystem", "name", "version"])


def reputation(scans: DataFrame, start: float = 100.0) -> DataFrame:
    """publisher, trust after its scans in order of seen_at, id: 15 less when flagged, down to 0, 1 more when clean, up to 100.

    Each scan is a map x -> min(hi, max(lo, x + add)), and such maps compose, so a running
    composition over blocks replaces an ordered fold over a publisher's whole history. A block has at most a thousand scans of one month.
    """
    step = F.when(F.col("flagged"), F.lit(-15.0)).otherwise(F.lit(1.0))
    ordered = Window.partitionBy("publisher", "block").orderBy("seen_at", "id")
    rows = scans.withColumn("block", F.date_trunc("month", "seen_at")).withColumn("n", F.row_number().over(ordered))
    rows = rows.select("publisher", F.struct("block", F.floor(F.col("n") / 1000).alias("part")).alias("block"), F.struct("n", step.alias("step")).alias("s"))

    def fold(steps):
        begin = F.struct(F.lit(0.0).alias("add"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))
        return F.aggregate(
            steps, begin,
            lambda f, s: F.struct(
                (f["add"] + s["step"]).alias("add"),
                F.least(F.lit(100.0), F.greatest(F.lit(0.0), f["lo"] + s["step"])).alias("lo"),
                F.least(F.lit(100.0), F.greatest(F.lit(0.0), f["hi"] + s["step"])).alias("hi"),
            ),
        )

    blocks = rows.groupBy("publisher", "block").agg(fold(F.array_sort(F.collect_list("s"))).alias("f"))
    chain = F.array_sort(F.collect_list(F.struct("block", "f")))
    trust = F.aggregate(chain, F.lit(start), lambda x, b: F.least(b["f"]["hi"], F.greatest(b["f"]["lo"], x + b["f"]["add"])))
    return blocks.groupBy("publisher").agg(F.count_distinct("block.block").alias("months"), trust.alias("trust"))


def verification(requests: DataFrame, threats: DataFrame, publishers: DataFrame) -> DataFrame:
    """The requests(artifact_hash, publisher_id, ...) with score and verdict: 50 for a known threat, 5 for each flagged package of the publisher, 10 if its trust is under 30.

    threats have hash, publishers publisher_id, flagged and trust; either may lack what is asked for, a null trust is 50.
    """
    known = threats.select(F.col("hash").alias("__hash")).distinct()
    own = publishers.select(F.col("publisher_id").alias("__publisher"), F.coalesce("flagged", F.lit(0)).alias("__flagged"), F.coalesce("trust", F.lit(50.0)).alias("__trust"))
    rows = requests.join(known, F.col("artifact_hash") == F.col("__hash"), "left").join(own, F.col("publisher_id") == F.col("__publisher"), "left")
    score = F.when(F.col("__hash").isNotNull(), 50.0).otherwise(0.0) + F.coalesce(F.greatest("__flagged", F.lit(0)) * 5.0, F.lit(0.0)) + F.when(F.col("__trust") < 30, 10.0).otherwise(0.0)
    return rows.withColumn("score", score).withColumn("verdict", S.verdict(F.col("score"))).drop("__hash", "__publisher", "__flagged", "__trust")


def cached_results(files: DataFrame, cache: DataFrame, engine: str) -> DataFrame:
    """artifact, key, result of files(artifact, path, hash) whose contents are in cache(key, engine, result): a result is null where the key is missing or another engine made it.

    The key is the start of the digest of all paths and contents of an artifact.
    """
    keys = content_digests(files).select("artifact", F.substring("digest", 1, 16).alias("key"))
    return keys.join(cache.where(F.col("engine") == engine).select("key", "result"), "key", "left").select("artifact", "key", "result")


def pruned_cache(cache: DataFrame, keep: int = 100) -> DataFrame:
    """The newest entries by stored_at, then by key."""
    return cache.orderBy(F.desc("stored_at"), "key").limit(keep)
