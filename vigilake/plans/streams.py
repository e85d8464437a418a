"""Queries that run streams to their end, and the batch twins of ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import changes
from ..streaming import folds, relational, runs, timers, worker
from .inputs import INPUTS, frame, read, source

USAGE = source("usage")


def _events(spark, sf):
    schema = read(spark, sf, "events").schema  # a pattern, as a stream takes no single file by its name
    return runs.watch(spark, f"{sf}/[e]vents.parquet", schema, "parquet").selectExpr(*[f"{e} AS {c}" for c, e in INPUTS["usage"][1].items()])


def r2_stream_dedup(spark, sf):
    return runs.drain(relational.deduplicated(_events(spark, sf).select("user_id", "kind"), ["user_id", "kind"]), "dedup")


def r11_stream_quota(spark, sf):
    return runs.drain(relational.monthly_quota(_events(spark, sf)), "quota", "complete")


def r13_stream_windows(spark, sf):
    rows = _events(spark, sf).withColumn("seen_at", F.col("seen_at").cast("timestamp"))
    counts = runs.drain(relational.windowed_counts(rows, "kind", "seen_at", "1 day"), "windows", "complete")
    return counts.select("kind", F.col("begin").cast("timestamp_ntz").alias("begin"), "n")


def _keyed(spark, sf):
    rows = frame(spark, sf, "usage")
    return rows.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("seen_at").cast("timestamp")).alias("us"), F.col("cost").cast("double").alias("value"), (F.col("kind") == "error").alias("failed")).withColumn("at", F.col("us") / 1_000_000.0).drop("us")


def r17_fixed_window(spark, sf):
    return folds.fold_batch(_keyed(spark, sf), "key", ["at", "id"], folds.fixed_window(86_400, 3), "key long, id long, n long, allowed boolean")


def r19_token_bucket(spark, sf):
    return folds.fold_batch(_keyed(spark, sf), "key", ["at", "id"], folds.token_bucket(1 / 40_000, 3.0), "key long, id long, tokens double, allowed boolean")


def r10_alerts(spark, sf):
    return folds.fold_batch(_keyed(spark, sf), "key", ["at", "id"], folds.cooldown(100.0, 86_400), "key long, id long, value double")


def r20_breaker(spark, sf):
    return folds.fold_batch(_keyed(spark, sf), "key", ["at", "id"], folds.circuit_breaker(200_000, 4, 0.5, 50_000), "key long, id long, state string, called boolean")


def r6_trust_steps(spark, sf):
    rows = frame(spark, sf, "scans").select(F.col("user_id").alias("key"), F.col("scan_id").alias("id"), F.col("scanned_at").alias("t"), (F.col("risk_score") >= 88).alias("flagged"))
    return folds.fold_batch(rows, "key", ["t", "id"], folds.reputation(), "key long, id long, trust double")


def r4_retries(spark, sf):
    return folds.fold_batch(_keyed(spark, sf), "key", ["at", "id"], folds.retries(), "key long, id long, outcome string, next double").groupBy("outcome").agg(F.count("*").alias("events"))


def r4_due_retries(spark, sf):
    """Retries whose time has come by the end of the month."""
    out = folds.fold_batch(_keyed(spark, sf), "key", ["at", "id"], folds.retries(), "key long, id long, outcome string, next double")
    return out.where("outcome = 'retry' and next <= 1706700000").select("key", "id", F.round("next", 3).alias("next"))


def r7_drift(spark, sf):
    signs = "scan_id % 3 > 0 as attested", "case scan_id % 4 when 0 then null when 1 then 'b' else 'a' end as signer", "case scan_id % 5 when 0 then null when 1 then 'q' else 'r' end as repo"
    rows = frame(spark, sf, "scans").selectExpr("user_id as key", "scan_id as id", "scanned_at as t", *signs)
    return folds.fold_batch(rows, "key", ["t", "id"], folds.drift(), "key long, id long, drift string")


def _jobs(spark, sf):
    return frame(spark, sf, "scans").selectExpr("scan_id as id", "ecosystem", "package", "version", "case scan_id % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'normal' when 3 then 'low' end as priority", "scanned_at as enqueued_at")


def r3_priority_queue(spark, sf):
    """The next hundred jobs."""
    return relational.by_priority(_jobs(spark, sf)).limit(100).select("id", "priority")


WORKER_RULES = [("TOKEN", "CRITICAL", 'token = "[0-9a-f]{40}"', 2), ("MAIL", "HIGH", "@mail[0-9]", 2), ("LICENSE", "LOW", "(MIT|Apache) License", 1)]


def _worked(spark, sf, table):
    """Documents come as a stream of jobs, each once, and are scanned, scored, stored and published."""
    jobs = runs.watch(spark, f"{sf}/[d]ocuments.parquet", read(spark, sf, "documents").schema, "parquet").selectExpr(
        "doc_id as id", "case doc_id % 5 when 0 then 'critical' else 'normal' end as priority", "cast(0 as int) as enqueued_at", "concat('f', source, '.txt') as path", "text"
    )
    rules = spark.createDataFrame(WORKER_RULES, "id string, severity string, pattern string, weight int")
    out = runs.shared_path(spark, "worker")
    worker.work(relational.deduplicated(jobs, ["id"]), rules, out, runs.shared_path(spark, "worker-checkpoint")).awaitTermination()
    return worker.stored(spark, out, table)


def r5_worker(spark, sf):
    return _worked(spark, sf, "scans")


def r5_worker_feed(spark, sf):
    return _worked(spark, sf, "feed")


def r1_cursor_changes(spark, sf):
    """Changes of a registry's log, read in two goes with a break between them; each comes once."""
    every = read(spark, sf, "orders").selectExpr("o_orderkey as serial", "case when o_custkey % 50 = 0 then '' when o_custkey % 50 = 1 then '_design/app' else concat('pkg-', o_custkey) end as package", "concat('1.', o_orderkey % 9) as version")
    log, out, checkpoint = runs.shared_path(spark, "log"), runs.shared_path(spark, "changes"), runs.shared_path(spark, "changes-checkpoint")
    half = every.agg(F.floor(F.max("serial") / 2)).first()[0] or 0
    spark.dataSource.register(changes.ChangeLog)
    for part in (every.where(F.col("serial") <= half), every.where(F.col("serial") > half)):
        changes.write_changes(part, log)
        stream = changes.packages(spark.readStream.format("changelog").option("path", log).load())
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema("serial long, package string, version string").parquet(out)


def _timed(spark, sf):
    schema = read(spark, sf, "events").schema
    rows = runs.watch(spark, f"{sf}/[e]vents.parquet", schema, "parquet").selectExpr(*[f"{e} AS {c}" for c, e in INPUTS["usage"][1].items()])
    return timers.timed(rows.selectExpr("user_id as key", "event_id as id", "unix_micros(cast(seen_at as timestamp)) / 1000000D as at", "cast(cost as double) as value", "kind = 'error' as failed"), "0 seconds")


def r4_timed_retries(spark, sf):
    """Failed jobs that come again when their time has passed, and dead letters, up to the last event."""
    with timers.rocksdb(spark):
        out = runs.drain(timers.retries(_timed(spark, sf)), "retries")
    return out.select("key", "id", "outcome", F.round("at", 3).alias("at"), "tries")


def r10_timed_alerts(spark, sf):
    with timers.rocksdb(spark):
        return runs.drain(timers.fold(_timed(spark, sf), "key", ["at", "id"], folds.cooldown(100.0, 86_400), "key long, id long, value double", timers.cooldown_ends(86_400)), "alerts")


def r19_timed_buckets(spark, sf):
    with timers.rocksdb(spark):
        return runs.drain(timers.fold(_timed(spark, sf), "key", ["at", "id"], folds.token_bucket(1 / 40_000, 3.0), "key long, id long, tokens double, allowed boolean", timers.bucket_fills(1 / 40_000, 3.0)), "buckets")


#: Recursion over each key's events, numbered in order.
_ROWS = f"n AS (SELECT user_id AS key, event_id AS id, epoch_us(seen_at) AS us, CAST(cost AS DOUBLE) AS value, kind = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY seen_at, event_id) AS k FROM {USAGE})"
_WORKED = """WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS body FROM documents), m(rule, severity, pattern, points) AS (VALUES ('TOKEN', 'CRITICAL', 'token = "[0-9a-f]{40}"', 10), ('MAIL', 'HIGH', '@mail[0-9]', 6), ('LICENSE', 'LOW', '(MIT|Apache) License', 1)),
f AS (SELECT doc_id, count(*) AS findings, sum(points) AS score, bool_or(severity = 'CRITICAL') AS critical FROM l JOIN m ON regexp_matches(body, pattern) GROUP BY 1),
s AS (SELECT d.doc_id AS scan_id, source, text, CAST(coalesce(score, 0) AS BIGINT) AS score, coalesce(findings, 0) AS findings,
 CASE WHEN critical THEN 'CRITICAL_RISK' WHEN score >= 25 THEN 'HIGH_RISK' WHEN score >= 10 THEN 'MEDIUM_RISK' ELSE 'LOW_RISK' END AS verdict FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id)"""

QUERIES = {
    "r2_stream_dedup": (r2_stream_dedup, f"SELECT DISTINCT user_id, kind FROM {USAGE}"),
    "r11_stream_quota": (r11_stream_quota, f"SELECT user_id, strftime(seen_at, '%Y-%m') AS year_month, count(*) AS used FROM {USAGE} GROUP BY 1, 2"),
    "r13_stream_windows": (r13_stream_windows, f"SELECT kind, date_trunc('day', seen_at)::TIMESTAMP AS begin, count(*) AS n FROM {USAGE} GROUP BY 1, 2"),
    "r17_fixed_window": (
        r17_fixed_window,
        f"""WITH RECURSIVE {_ROWS}, r AS (SELECT key, id, k, us AS begin, CAST(1 AS BIGINT) AS n FROM n WHERE k = 1
 UNION ALL SELECT n.key, n.id, n.k, CASE WHEN n.us >= r.begin + 86400000000 THEN n.us ELSE r.begin END, CASE WHEN n.us >= r.begin + 86400000000 THEN 1 ELSE r.n + 1 END FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)
SELECT key, id, n, n <= 3 AS allowed FROM r""",
    ),
    "r19_token_bucket": (
        r19_token_bucket,
        f"""WITH RECURSIVE {_ROWS}, r AS (SELECT key, id, k, us / 1000000::DOUBLE AS sec, 2.0::DOUBLE AS tokens, true AS allowed FROM n WHERE k = 1
 UNION ALL SELECT key, id, k, sec, filled - CASE WHEN filled >= 1 THEN 1 ELSE 0 END, filled >= 1 FROM (SELECT n.key, n.id, n.k, n.us / 1000000::DOUBLE AS sec, least(3.0::DOUBLE, r.tokens + (n.us / 1000000::DOUBLE - r.sec) * (1 / 40000::DOUBLE)) AS filled FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1))
SELECT key, id, round(tokens, 6) AS tokens, allowed FROM r""",
    ),
    "r10_alerts": (
        r10_alerts,
        f"""WITH RECURSIVE {_ROWS}, r AS (SELECT key, id, k, value, value >= 100 AS fired, CASE WHEN value >= 100 THEN us END AS last FROM n WHERE k = 1
 UNION ALL SELECT n.key, n.id, n.k, n.value, n.value >= 100 AND (r.last IS NULL OR n.us >= r.last + 86400000000), CASE WHEN n.value >= 100 AND (r.last IS NULL OR n.us >= r.last + 86400000000) THEN n.us ELSE r.last END FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)
SELECT key, id, value FROM r WHERE fired""",
    ),
    "r20_breaker": (
        r20_breaker,
        f"""WITH RECURSIVE {_ROWS}, r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS id, CAST(0 AS BIGINT) AS k, false AS called, 'CLOSED' AS kind, 0::DOUBLE AS since, CAST([] AS STRUCT(t DOUBLE, f BOOLEAN)[]) AS calls FROM n
 UNION ALL SELECT key, id, k, NOT waits, CASE WHEN waits THEN 'OPEN' WHEN kind = 'OPEN' THEN CASE WHEN failed THEN 'OPEN' ELSE 'CLOSED' END WHEN trips THEN 'OPEN' ELSE 'CLOSED' END,
  CASE WHEN waits THEN since WHEN kind = 'OPEN' OR trips THEN sec ELSE since END, CASE WHEN waits THEN calls WHEN kind = 'OPEN' OR trips THEN CAST([] AS STRUCT(t DOUBLE, f BOOLEAN)[]) ELSE recent END
 FROM (SELECT *, kind = 'OPEN' AND sec < since + 50000 AS waits, len(recent) >= 4 AND len(list_filter(recent, lambda c: c.f)) >= 0.5 * len(recent) AS trips FROM
  (SELECT n.key, n.id, n.k, n.failed, n.us / 1000000::DOUBLE AS sec, r.kind, r.since, r.calls, list_append(list_filter(r.calls, lambda c: c.t > n.us / 1000000::DOUBLE - 200000), CAST(row(n.us / 1000000::DOUBLE, n.failed) AS STRUCT(t DOUBLE, f BOOLEAN))) AS recent FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)))
SELECT key, id, kind AS state, called FROM r WHERE k > 0""",
    ),
    "r6_trust_steps": (
        r6_trust_steps,
        f"""WITH RECURSIVE n AS (SELECT user_id AS key, scan_id AS id, risk_score >= 88 AS flagged, row_number() OVER (PARTITION BY user_id ORDER BY scanned_at, scan_id) AS k FROM {source("scans")}),
r AS (SELECT key, id, k, CASE WHEN flagged THEN 85.0::DOUBLE ELSE 100.0::DOUBLE END AS trust FROM n WHERE k = 1 UNION ALL SELECT n.key, n.id, n.k, CASE WHEN n.flagged THEN greatest(0::DOUBLE, r.trust - 15) ELSE least(100::DOUBLE, r.trust + 1) END FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)
SELECT key, id, trust FROM r""",
    ),
    "r4_due_retries": (
        r4_due_retries,
        f"""WITH RECURSIVE {_ROWS}, r AS (SELECT key, id, k, us, CASE WHEN failed THEN 1 ELSE 0 END AS tries, CASE WHEN failed THEN 60 END AS wait FROM n WHERE k = 1
 UNION ALL SELECT n.key, n.id, n.k, n.us, CASE WHEN NOT n.failed OR r.tries >= 3 THEN 0 ELSE r.tries + 1 END, CASE WHEN NOT n.failed OR r.tries >= 3 THEN NULL ELSE CASE r.tries WHEN 0 THEN 60 WHEN 1 THEN 300 ELSE 1800 END END FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)
SELECT key, id, round(us / 1000000::DOUBLE + wait, 3) AS next FROM r WHERE wait IS NOT NULL AND us / 1000000::DOUBLE + wait <= 1706700000""",
    ),
    "r7_drift": (
        r7_drift,
        f"""WITH s AS (SELECT user_id AS key, scan_id AS id, scanned_at AS t, scan_id % 3 > 0 AS attested, CASE scan_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'b' ELSE 'a' END AS signer, CASE scan_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'q' ELSE 'r' END AS repo FROM {source("scans")}),
l AS (SELECT *, lag(attested) OVER w AS was_attested, lag(signer) OVER w AS was_signer, lag(repo) OVER w AS was_repo FROM s WINDOW w AS (PARTITION BY key ORDER BY t, id))
SELECT key, id, 'lost_attestation' AS drift FROM l WHERE was_attested AND NOT attested UNION ALL SELECT key, id, 'signer_changed' FROM l WHERE was_signer <> signer UNION ALL SELECT key, id, 'repo_changed' FROM l WHERE was_repo <> repo""",
    ),
    "r3_priority_queue": (r3_priority_queue, f"SELECT id, priority FROM (SELECT scan_id AS id, CASE scan_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'normal' WHEN 3 THEN 'low' END AS priority, scanned_at FROM {source('scans')}) ORDER BY CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 3 END, scanned_at, id LIMIT 100"),
    "r5_worker": (r5_worker, f"{_WORKED} SELECT scan_id, score, verdict, findings, sha256('f' || source || '.txt:' || sha256(coalesce(text, ''))) AS digest FROM s"),
    "r5_worker_feed": (r5_worker_feed, f"{_WORKED} SELECT scan_id, verdict, 'Scan ' || CAST(scan_id AS VARCHAR) || ': ' || verdict AS title FROM s WHERE verdict IN ('HIGH_RISK', 'CRITICAL_RISK')"),
    "r1_cursor_changes": (r1_cursor_changes, "SELECT o_orderkey AS serial, 'pkg-' || CAST(o_custkey AS VARCHAR) AS package, '1.' || CAST(o_orderkey % 9 AS VARCHAR) AS version FROM orders WHERE o_custkey % 50 > 1"),
    "r4_timed_retries": (
        r4_timed_retries,
        f"""WITH RECURSIVE {_ROWS}, r AS (SELECT key, id, k, us, failed, CASE WHEN failed THEN 1 ELSE 0 END AS n FROM n WHERE k = 1
 UNION ALL SELECT n.key, n.id, n.k, n.us, n.failed, CASE WHEN NOT n.failed THEN 0 WHEN r.n = 4 THEN 1 ELSE r.n + 1 END FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1),
w AS (SELECT *, CASE n WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 1800 ELSE 0 END AS wait FROM r WHERE failed)
SELECT key, id, CASE WHEN n = 4 THEN 'dead' ELSE 'retry' END AS outcome, round(us / 1000000::DOUBLE + wait, 3) AS "at", CAST(n AS INTEGER) AS tries FROM w
WHERE n = 4 OR ceil(us / 1000::DOUBLE + wait * 1000) <= (SELECT max(us) // 1000 FROM n)""",
    ),
    "r4_retries": (
        r4_retries,
        f"""WITH RECURSIVE {_ROWS}, r AS (SELECT key, id, k, CASE WHEN failed THEN 1 ELSE 0 END AS tries, CASE WHEN failed THEN 'retry' ELSE 'done' END AS outcome FROM n WHERE k = 1
 UNION ALL SELECT n.key, n.id, n.k, CASE WHEN NOT n.failed OR r.tries >= 3 THEN 0 ELSE r.tries + 1 END, CASE WHEN NOT n.failed THEN 'done' WHEN r.tries >= 3 THEN 'dead' ELSE 'retry' END FROM r JOIN n ON n.key = r.key AND n.k = r.k + 1)
SELECT outcome, count(*) AS events FROM r GROUP BY 1""",
    ),
}
QUERIES["r10_timed_alerts"] = (r10_timed_alerts, QUERIES["r10_alerts"][1])
QUERIES["r19_timed_buckets"] = (r19_timed_buckets, QUERIES["r19_token_bucket"][1])
