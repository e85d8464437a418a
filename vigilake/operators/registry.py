"""The package registry: stored scans, their latest versions, statistics, search and rescan queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_scan(scans: DataFrame, keys: tuple[str, ...] = ("ecosystem", "package")) -> DataFrame:
    """The newest row of each key; of equally new ones the largest scan_id.

    A maximum of structs is combined before the shuffle, unlike a window over each key.
    """
    names = [c for c in scans.columns if c not in keys]
    newest = F.max(F.struct("scanned_at", "scan_id", *[c for c in names if c not in ("scanned_at", "scan_id")])).alias("__s")
    return scans.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"__s.{c}").alias(c) for c in names]).select(*scans.columns)


def best_scan(scans: DataFrame) -> DataFrame:
    """The newest scan of each package that is no error, else the newest."""
    rank = Window.partitionBy("ecosystem", "package").orderBy(F.col("verdict") == "ERROR", F.desc("scanned_at"), F.desc("scan_id"))
    return scans.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")


#: Verdicts that are risky.
RISKY = ["HIGH_RISK", "CRITICAL_RISK"]
# Days after which a risky package and any other one is scanned again.
RISKY_DAYS, OTHER_DAYS = 7, 90


def rescan_due(scans: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """ecosystem, package, scan_id, verdict, days of the packages whose latest scan without error is old enough; with a limit the first ones, risky before others and then the oldest."""
    days, risky = F.datediff(now, F.col("scanned_at")), F.col("verdict").isin(RISKY)
    due = latest_scan(scans.where("verdict <> 'ERROR'")).where((risky & (days >= RISKY_DAYS)) | (days >= OTHER_DAYS))
    if limit is not None:
        due = due.orderBy(F.desc(risky), "scanned_at", "scan_id").limit(limit)
    return due.select("ecosystem", "package", "scan_id", "verdict", days.alias("days"))


def rescan_allowance(scans: DataFrame, times: list, most: int) -> DataFrame:
    """at, recent, allowed: for each of a few times how many scans were made again in the hour before, and whether another one may be. scans have rescanned_at."""
    spark, name = scans.sparkSession, "at timestamp_ntz"
    asked = spark.createDataFrame([(t,) for t in times], name)
    instants = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t in times]))
    rows = scans.select(instants.alias("at"), "rescanned_at").where((F.col("rescanned_at") > F.col("at") - F.expr("interval 1 hour")) & (F.col("rescanned_at") <= F.col("at")))
    counted = rows.groupBy("at").agg(F.count("*").alias("recent"))
    return asked.join(counted, "at", "left").select("at", F.coalesce("recent", F.lit(0)).cast("long").alias("recent")).withColumn("allowed", F.col("recent") < most)


def rescan_priority(verdict: Column, findings: Column, downloads: Column, days: Column) -> Column:
    base = F.when(verdict == "CRITICAL_RISK", 100.0).when(verdict == "HIGH_RISK", 75.0).when(verdict == "MEDIUM_RISK", 50.0).otherwise(25.0)
    many = F.when(findings >= 20, 25.0).when(findings >= 10, 15.0).when(findings >= 5, 10.0).otherwise(0.0)
    known = F.when(downloads > 100_000, 15.0).when(downloads > 10_000, 10.0).when(downloads > 1000, 5.0).otherwise(0.0)
    old = F.when(days > 7, F.least(days - 7, F.lit(20))).otherwise(0)
    return F.greatest(base + many + known - old, F.lit(0.0))


def rescan_candidates(scans: DataFrame, now: Column, limit: int = 200, cooldown_hours: int = 24) -> DataFrame:
    """scan_id, verdict, priority: the most urgent of two kinds of scans by an old scanner that were not scanned again within the cooldown, half the limit of each.

    Risky ones of the last 30 days, worst, with most findings and newest first; and ones of medium risk of the last 14 days with at least
    5 findings and over 1000 downloads, with most findings, most downloads and newest first. scans have scan_id, verdict, findings_count,
    downloads, scanner, scanned_at, rescanned_at.
    """
    old = scans.where(F.coalesce("scanner", F.lit("1.0.0")).startswith("1.") & (F.col("rescanned_at").isNull() | (F.col("rescanned_at") < now - F.make_dt_interval(hours=F.lit(cooldown_hours)))))
    since = lambda days: F.col("scanned_at") > now - F.make_dt_interval(F.lit(days))
    risky = old.where(F.col("verdict").isin("HIGH_RISK", "CRITICAL_RISK") & since(30)).orderBy(F.desc(F.col("verdict") == "CRITICAL_RISK"), F.desc("findings_count"), F.desc("scanned_at"), "scan_id").limit(limit // 2)
    popular = old.where((F.col("verdict") == "MEDIUM_RISK") & (F.col("findings_count") >= 5) & (F.col("downloads") > 1000) & since(14)).orderBy(F.desc("findings_count"), F.desc("downloads"), F.desc("scanned_at"), "scan_id").limit(limit // 2)
    priority = rescan_priority(F.col("verdict"), F.col("findings_count"), F.col("downloads"), F.datediff(now, "scanned_at"))
    return risky.unionByName(popular).select("scan_id", "verdict", priority.alias("priority")).orderBy(F.desc("priority"), "scan_id").limit(limit)


#: Orders of a list of an ecosystem's scans.
LIST_ORDERS = {"recent": F.desc, "risk": F.desc, "name": F.asc}
_LIST_COLUMNS = {"recent": "scanned_at", "risk": "risk_score", "name": "package"}


def ecosystem_page(scans: DataFrame, ecosystem: str, order: str, page: int, per_page: int) -> DataFrame:
    """A page of an ecosystem's scans without errors, with position on the page from 1 and has_more; one row more is read to tell whether there are more."""
    by = [LIST_ORDERS[order](_LIST_COLUMNS[order]), F.asc("scan_id")]
    rows = scans.where((F.col("ecosystem") == ecosystem) & (F.col("verdict") != "ERROR")).orderBy(*by).offset((page - 1) * per_page).limit(per_page + 1)
    # at most per_page + 1 rows reach the windows
    rows = rows.withColumn("position", F.row_number().over(Window.orderBy(*by))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > per_page)
    return rows.where(F.col("position") <= per_page)


def sorted_tools(tools: DataFrame, mode: str, page: int = 50) -> DataFrame:
    """The first tools(tool_id, downloads, stars, trust, updated_at) by trending (0.4 downloads, 0.3 stars, 0.3 trust), downloads, stars or newest, highest first, with position; null counts as 0, or as before all times."""
    def whole(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    keys = {"trending": whole("downloads") * 0.4 + whole("stars") * 0.3 + whole("trust") * 0.3, "downloads": whole("downloads"), "stars": whole("stars"), "newest": F.col("updated_at")}
    by = [keys[mode].desc_nulls_last(), F.asc("tool_id")]
    return tools.orderBy(*by).limit(page).withColumn("position", F.row_number().over(Window.orderBy(*by)))


def trust_changes(tools: DataFrame, since: Column, until: Column, least: int = 10, top: int = 5) -> DataFrame:
    """tool_id, change: the largest changes of trust of at least so many points between two times; tools have tool_id, trust, previous_trust, trust_at."""
    rows = tools.where((F.col("trust_at") >= since) & (F.col("trust_at") < until)).select("tool_id", (F.col("trust") - F.col("previous_trust")).alias("change"))
    return rows.where(F.abs("change") >= least).orderBy(F.desc(F.abs("change")), "tool_id").limit(top)


def registry_stats(scans: DataFrame) -> DataFrame:
    """kind, value, n: scans without errors, packages and threats in all; scans by ecosystem, errors too; and scans without errors by verdict. Null counts as unknown, or as LOW_RISK."""
    good = F.col("verdict") != "ERROR"
    by = scans.groupBy("ecosystem", "package", "verdict").agg(F.count("*").alias("n"))
    total = by.agg(F.sum(F.when(good, F.col("n"))).alias("total_scans"), F.count_distinct("ecosystem", "package").alias("packages"), F.sum(F.when(F.col("verdict").isin(RISKY), F.col("n"))).alias("threats"))
    named = F.explode(F.create_map(*[x for c in ("total_scans", "packages", "threats") for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0)).cast("long"))])).alias("value", "n")
    parts = [total.select(F.lit("total").alias("kind"), named)]
    parts.append(by.groupBy(F.coalesce("ecosystem", F.lit("unknown")).alias("value")).agg(F.sum("n").alias("n")).select(F.lit("ecosystem").alias("kind"), "value", "n"))
    parts.append(by.where(good).groupBy(F.coalesce("verdict", F.lit("LOW_RISK")).alias("value")).agg(F.sum("n").alias("n")).select(F.lit("verdict").alias("kind"), "value", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def trust_histogram(scans: DataFrame) -> DataFrame:
    """By ecosystem: tools of high, medium and low trust; errors count as no high trust."""
    trust = F.greatest(F.lit(0), 100 - F.col("risk_score"))
    return scans.groupBy("ecosystem").agg(
        F.greatest(F.lit(0), F.count_if(trust >= 80) - F.count_if(F.col("verdict") == "ERROR")).alias("high"),
        F.count_if((trust >= 50) & (trust < 80)).alias("medium"),
        F.count_if(trust < 50).alias("low"),
    )


def category_stats(tools: DataFrame) -> DataFrame:
    """category, ecosystem, tools, mean confidence, confident (over 0.8); ecosystem 'all' is the whole category. One pass by grouping sets."""
    out = tools.groupingSets([("category", "ecosystem"), ("category",)], "category", "ecosystem").agg(
        F.grouping("ecosystem").alias("__all"), F.count("*").alias("tools"), F.round(F.avg("confidence"), 4).alias("confidence"), F.count_if(F.col("confidence") > 0.8).alias("confident")
    )
    return out.select("category", F.when(F.col("__all") == 1, "all").otherwise(F.col("ecosystem")).alias("ecosystem"), "tools", "confidence", "confident")


def search(scans: DataFrame, text: str, offset: int, page: int, **equal) -> DataFrame:
    """A page of the newest scans without error whose package holds the text, and one row more if there is another page."""
    rows = scans.where((F.col("verdict") != "ERROR") & F.lower("package").contains(text.lower()))
    for name, value in equal.items():
        rows = rows.where(F.col(name) == value)
    return rows.orderBy(F.desc("scanned_at"), F.desc("scan_id")).offset(offset).limit(page + 1)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with rows put in: for each key the last row by order replaces what the table has."""
    names = [c for c in table.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in names if c != order])).alias("__s")).select(*keys, *[F.col(f"__s.{c}").alias(c) for c in names])
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last)


def merge_add(table: DataFrame, rows: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of both added up for each key."""
    return table.select(*keys, *counters).unionByName(rows.select(*keys, *counters)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def needs_classification(tools: DataFrame, classified: DataFrame, keys: list[str]) -> DataFrame:
    """Tools that were never classified, or scanned after that."""
    known = classified.select(*[F.col(k).alias(f"__{k}") for k in keys], "classified_at")
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    return tools.join(known, same, "left").where("classified_at is null or scanned_at > classified_at").select(*tools.columns)


def version_shares(scans: DataFrame, now: Column) -> DataFrame:
    """One row of the scans of the 90 days before now: all, those of scanner 1.0.0 (or unknown) and of 2.0.0, the share of the latter, by how much scores fell on average where they fell (0 elsewhere), and the day on which
    the rest is done at the rate since the first rescan. scans have scanner, risk_score, original_score, created_at, rescanned_at.
    """
    recent = scans.where(F.col("created_at") >= now - F.expr("interval 90 days"))
    fell = F.when(F.col("original_score").isNotNull() & (F.col("risk_score") < F.col("original_score")), (F.col("original_score") - F.col("risk_score")) * 100.0 / F.col("original_score")).otherwise(0.0)
    v1, v2 = F.count_if(F.coalesce("scanner", F.lit("1.0.0")) == "1.0.0"), F.count_if(F.col("scanner") == "2.0.0")
    now_row = recent.agg(F.count("*").alias("scans"), v1.alias("v1"), v2.alias("v2"), F.coalesce(F.round(F.avg(fell), 2), F.lit(0.0)).alias("reduction"))
    again = scans.where("scanner = '2.0.0' and rescanned_at is not null").agg((F.count("*") / F.greatest(F.lit(1), F.datediff(now, F.min("rescanned_at")))).alias("rate"))
    both = now_row.crossJoin(F.broadcast(again))  # one row each
    end = F.when((F.col("v2") > 0) & (F.col("rate") > 0), F.date_add(F.to_date(now), F.floor(F.col("v1") / F.col("rate")).cast("int")))
    share = F.when(F.col("scans") > 0, F.round(F.col("v2") * 100 / F.col("scans"), 2)).otherwise(0.0)
    return both.select("scans", "v1", "v2", share.alias("migrated"), "reduction", end.alias("done"))


def scanner_metrics(scans: DataFrame) -> DataFrame:
    """version, scans, mean_score, mean_confidence, severe, false_positives by generation of the scanner, errors left out; an unknown scanner is of the first.

    Means are those of each day and verdict, weighted by all its scans; days without any confidence don't count there.
    """
    version = F.concat(F.split(F.coalesce("scanner", F.lit("1.0.0")), r"\.")[0], F.lit(".x"))
    days = scans.where("verdict <> 'ERROR'").groupBy(version.alias("version"), "verdict", F.to_date("scanned_at").alias("day")).agg(
        F.count("*").alias("n"), F.coalesce(F.avg("risk_score"), F.lit(0.0)).alias("score"), F.avg("confidence").alias("sure")
    )
    severe = F.sum(F.when(F.col("verdict").isin(RISKY), F.col("n")).otherwise(0))
    sure = F.sum(F.col("sure") * F.col("n")) / F.sum(F.when(F.col("sure").isNotNull(), F.col("n")))
    by = days.groupBy("version").agg(F.sum("n").alias("scans"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 2).alias("mean_score"), F.round(sure, 3).alias("mean_confidence"), severe.cast("long").alias("severe"))
    rate = F.when(F.col("version") == "1.x", 0.36).otherwise(0.05)
    return by.withColumn("false_positives", F.round(F.col("severe") * rate * 100 / F.col("scans"), 1))


def confidence_distribution(scans: DataFrame) -> DataFrame:
    """version, verdict, confidence (to a tenth), level, scans of the scans with a confidence that are no errors: under 0.3 they are likely false positives, under 0.6 of low confidence, else of high."""
    sure = F.col("confidence")
    level = F.when(sure < 0.3, "likely_false_positive").when(sure < 0.6, "low_confidence").otherwise("high_confidence")
    rows = scans.where("verdict <> 'ERROR' and confidence is not null")
    return rows.groupBy(F.coalesce("scanner", F.lit("1.0.0")).alias("version"), "verdict", F.round(sure, 1).alias("confidence"), level.alias("level")).agg(F.count("*").alias("scans"))


def running_total(scans: DataFrame) -> DataFrame:
    """day, scans, total so far and the share of all. A day is one row before the window, which is then small."""
    days = scans.groupBy(F.to_date("scanned_at").alias("day")).agg(F.count("*").alias("scans"))
    every = days.agg(F.sum("scans").alias("__n"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("total", F.sum("scans").over(run)).crossJoin(F.broadcast(every)).select("day", "scans", "total", F.round(F.col("total") * 100 / F.col("__n"), 4).alias("share"))


def personal_dashboard(scans: DataFrame, newest: int = 10) -> DataFrame:
    """By user, over the newest scans only: count, mean risk, risky ones and the last time."""
    rank = Window.partitionBy("user_id").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    rows = scans.withColumn("__n", F.row_number().over(rank)).where(F.col("__n") <= newest)
    return rows.groupBy("user_id").agg(F.count("*").alias("scans"), F.round(F.avg("risk_score"), 4).alias("mean_risk"), F.count_if(F.col("risk_score") > 50).alias("risky"), F.max("scanned_at").alias("last"))


def detection_delta(scans: DataFrame, third_party: list[str]) -> DataFrame:
    """Scans that only this engine flags: every third-party verdict is missing or safe."""
    rows = scans.where(F.col("verdict").isin("HIGH_RISK", "CRITICAL_RISK"))
    for name in third_party:
        rows = rows.where(F.col(name).isNull() | F.col(name).isin("safe", "clean"))
    return rows


def policy_evaluation(scans: DataFrame, policies: list[dict]) -> DataFrame:
    """policy, scan_id, allowed, auto_approved, violations for each scan and each of a short list of policies; scans have scan_id, package, risk_score, phases (array).

    A policy has policy, blocklist, allowlist (none: all are allowed), auto_approve (the highest risk) and required_phases.
    """
    package, risk, phases = F.col("package"), F.col("risk_score"), F.col("phases")

    def verdict(p: dict) -> Column:
        def listed(items) -> Column:
            return F.array(*[F.lit(x) for x in items]).cast("array<string>")

        broken = [F.when(package.isin(p["blocklist"]), "blocked")] if p["blocklist"] else []
        broken += [F.when(~F.coalesce(package.isin(p["allowlist"]), F.lit(False)), "not_allowed")] if p["allowlist"] else []
        broken += [F.when(F.size(F.array_except(listed(p["required_phases"]), F.coalesce(phases, listed([])))) > 0, "missing_phase")] if p["required_phases"] else []
        found = F.concat_ws(",", *broken) if broken else F.lit("")
        return F.struct(F.lit(p["policy"]).alias("policy"), found.alias("violations"), (risk <= p["auto_approve"]).alias("low"))

    rows = scans.select("scan_id", F.explode(F.array(*map(verdict, policies))).alias("v")).select("scan_id", "v.*")
    allowed = F.col("violations") == ""
    return rows.select("policy", "scan_id", allowed.alias("allowed"), (allowed & F.col("low")).alias("auto_approved"), "violations")


def merged_scans(own: DataFrame, public: DataFrame, paid: bool, page: int = 50, free: int = 10) -> DataFrame:
    """The newest of own and public scans by scanned_at, each scan_id once and the own row of those in both; a page, or a few without a plan."""
    rows = own.withColumn("origin", F.lit("own")).unionByName(public.join(own.select("scan_id"), "scan_id", "left_anti").withColumn("origin", F.lit("public")))
    return rows.orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(page if paid else free)


def forge_stats(scans: DataFrame) -> DataFrame:
    """One row: tools in all, servers, skills and packages by ecosystem, and trust by risk (up to 25, 60, 85 and over), errors taken from the high one."""
    risk = F.coalesce("risk_score", F.lit(0))

    def of(*names: str) -> Column:
        return F.count_if(F.col("ecosystem").isin(*names))

    high = F.greatest(F.count_if(risk <= 25) - F.count_if(F.col("verdict") == "ERROR"), F.lit(0))
    return scans.agg(
        F.count("*").alias("tools"), of("mcp", "github").alias("servers"), of("skill", "clawhub").alias("skills"), of("npm").alias("npm"), of("pypi").alias("pypi"),
        high.alias("high"), F.count_if((risk > 25) & (risk <= 60)).alias("medium"), F.count_if((risk > 60) & (risk <= 85)).alias("low"), F.count_if(risk > 85).alias("very_low"),
    )
