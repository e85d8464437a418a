"""Reports as JSON text: SARIF, CycloneDX and feeds, one row a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import lookup

# Report levels and badge colours.
SARIF_LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
BADGE_COLOURS = {"LOW_RISK": "#4c1", "MEDIUM_RISK": "#dfb317", "HIGH_RISK": "#fe7d37", "CRITICAL_RISK": "#e05d44"}
PURL_TYPES = {"npm": "npm", "pip": "pypi", "pypi": "pypi", "cargo": "cargo", "go": "golang"}


def sarif(findings: DataFrame, tool: str = "vigilake") -> DataFrame:
    """scan_id, report. The rules of a report are distinct, by name. A report gathers one scan's findings, as it must."""
    result = F.struct(
        F.col("rule").alias("ruleId"), lookup(F.col("severity"), SARIF_LEVELS, "note").alias("level"), F.struct(F.col("snippet").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.coalesce("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    by = findings.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("file", "line", "rule", result.alias("r")))).alias("f"), F.array_sort(F.collect_set("rule")).alias("rules"))
    driver = F.struct(F.lit(tool).alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), F.transform("f", lambda x: x["r"]).alias("results"))
    return by.select("scan_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("report"))


def purl(kind: Column, name: Column, version: Column) -> Column:
    base = F.concat(F.lit("pkg:"), F.coalesce(lookup(kind, PURL_TYPES), kind), F.lit("/"), name)
    return F.when(version.isNull(), base).otherwise(F.concat(base, F.lit("@"), version))


def cyclonedx(components: DataFrame) -> DataFrame:
    """path, report of components(path, package_type, name, version)."""
    part = F.struct(F.lit("library").alias("type"), "name", "version", purl(F.col("package_type"), F.col("name"), F.col("version")).alias("purl"))
    by = components.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "version", part.alias("c")))).alias("cs"))
    return by.select("path", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.transform("cs", lambda c: c["c"]).alias("components"))).alias("report"))


def feed(scans: DataFrame, items: int = 50) -> DataFrame:
    """One JSON feed of the newest scans; the limit runs before the rows are gathered."""
    newest = scans.orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(items)
    item = F.struct(F.col("scan_id").cast("string").alias("id"), F.concat_ws(" ", "ecosystem", "package", "version", "verdict").alias("title"), F.date_format("scanned_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"))
    # struct order sorts the feed newest first again after it is gathered
    return newest.agg(F.reverse(F.array_sort(F.collect_list(F.struct("scanned_at", "scan_id", item.alias("i"))))).alias("f")).select(F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.transform("f", lambda x: x["i"]).alias("items"))).alias("feed"))


def xml_escaped(text: Column) -> Column:
    for sign, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def rss(scans: DataFrame, site: str, title: str = "Scans", items: int = 100) -> DataFrame:
    """One RSS 2.0 feed of the newest scans(scan_id, ecosystem, package, version, verdict, score, findings (array of severity and description), scanned_at).

    An item tells the verdict, the score, the number of findings and the first five of them; the limit runs before rows are gathered.
    """
    newest = scans.orderBy(F.desc("scanned_at"), F.desc("scan_id")).limit(items)
    link = F.concat(F.lit(f"{site}/scans/"), "ecosystem", F.lit("/"), "package")
    said = F.array_join(F.transform(F.slice("findings", 1, 5), lambda f: F.concat(f["severity"], F.lit(": "), f["description"])), "; ")
    about = F.concat(F.lit("Risk score: "), F.format_string("%.0f", F.col("score").cast("double")), F.lit(". "), F.size("findings").cast("string"), F.lit(" finding(s). "), F.when(said == "", "No notable findings").otherwise(said), F.lit("."))
    head = F.concat(F.lit("["), "verdict", F.lit("] "), "package", F.lit("@"), "version", F.lit(" ("), F.upper("ecosystem"), F.lit(")"))

    def tag(name: str, body: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))

    item = tag("item", F.concat(tag("title", xml_escaped(head)), tag("link", xml_escaped(link)), tag("description", xml_escaped(about)), tag("pubDate", F.date_format("scanned_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")), tag("guid", F.concat(xml_escaped(link), F.lit("?v="), xml_escaped(F.col("version")))), tag("category", xml_escaped(F.col("ecosystem"))), tag("category", xml_escaped(F.col("verdict")))))
    gathered = newest.agg(F.reverse(F.array_sort(F.collect_list(F.struct("scanned_at", "scan_id", item.alias("i"))))).alias("f"))
    body = F.array_join(F.transform("f", lambda x: x["i"]), "")
    return gathered.select(F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title><link>{site}</link>'), body, F.lit("</channel></rss>")).alias("feed"))


def badge_colour(verdict: Column) -> Column:
    return lookup(verdict, BADGE_COLOURS, "#9f9f9f")
