"""A worker whose results survive failures: each micro-batch is scanned, scored, stored and published once.

Every step writes the folder of its batch, over what an earlier attempt left there, and reads what the step before stored. The ledger gets a
batch's entry last; readers see batches of the ledger only, so an attempt that broke off shows nowhere and one that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import rulescan, scoring
from .relational import by_priority

FINDINGS = "scan_id long, rule string, severity string, weight int, line int"
SCANS = "scan_id long, score long, verdict string, findings long, digest string"
FEED = "scan_id long, verdict string, title string"
LEDGER = "batch long, jobs long, scans long, published long"
#: Verdicts that are published.
TOLD = ["HIGH_RISK", "CRITICAL_RISK"]


def _entries(spark: SparkSession, out: str) -> DataFrame:
    from py4j.protocol import Py4JJavaError

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/ledger")
    try:
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    except Py4JJavaError as e:
        raise OSError(f"{out} can't be read") from e
    return spark.read.schema(LEDGER).json(f"{out}/ledger/*/*.json") if there else spark.createDataFrame([], LEDGER)


def stored(spark: SparkSession, out: str, table: str) -> DataFrame:
    """findings, scans or feed of the batches that were finished."""
    schema = {"findings": FINDINGS, "scans": SCANS, "feed": FEED}[table]
    done = [r.batch for r in _entries(spark, out).select("batch").collect()]  # one number a batch
    return spark.read.schema(schema).parquet(*[f"{out}/{table}/batch={n}" for n in sorted(done)]) if done else spark.createDataFrame([], schema)


def run_batch(jobs: DataFrame, batch: int, rules: DataFrame, out: str, after: Callable[[str, int], None] = lambda step, batch: None) -> None:
    """One micro-batch of jobs(id, priority, enqueued_at, path, text). after is called with the name of each step that was done."""
    spark = jobs.sparkSession
    if not _entries(spark, out).where(F.col("batch") == batch).isEmpty():
        return

    def kept(df: DataFrame, table: str, schema: str) -> DataFrame:
        path = f"{out}/{table}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        after(table, batch)
        return spark.read.schema(schema).parquet(path)

    files = by_priority(jobs).select(F.col("id").cast("long").alias("scan_id"), "path", F.coalesce("text", F.lit("")).alias("text"))
    found = kept(rulescan.scan_rules(files, rules).select("scan_id", "rule", "severity", F.col("weight").cast("int").alias("weight"), "line"), "findings", FINDINGS)
    scored = scoring.scan_scores(found).withColumnRenamed("scan_id", "__scan")
    digests = files.groupBy("scan_id").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws(":", "path", F.sha2("text", 256))))), 256).alias("digest"))
    scans = digests.join(scored, F.col("scan_id") == F.col("__scan"), "left").select(
        "scan_id", F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("verdict", F.lit("LOW_RISK")).alias("verdict"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), "digest"
    )
    scans = kept(scans, "scans", SCANS)
    feed = kept(scans.where(F.col("verdict").isin(TOLD)).select("scan_id", "verdict", F.concat(F.lit("Scan "), "scan_id", F.lit(": "), "verdict").alias("title")), "feed", FEED)
    entry = spark.createDataFrame([(batch, jobs.count(), scans.count(), feed.count())], LEDGER)
    entry.coalesce(1).write.mode("overwrite").json(f"{out}/ledger/batch={batch}")
    after("ledger", batch)


def work(jobs: DataFrame, rules: DataFrame, out: str, checkpoint: str, after: Callable[[str, int], None] = lambda step, batch: None) -> StreamingQuery:
    """The worker over a stream of jobs, for what is there now."""
    return jobs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: run_batch(df, n, rules, out, after)).start()
