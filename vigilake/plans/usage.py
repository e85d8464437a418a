"""Queries over usage events and subscriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as U
from .inputs import frame, read, source

USAGE, SUBS = source("usage"), source("subscriptions")
_PRICE = "CAST(CASE model WHEN 'small' THEN 0.10 WHEN 'medium' THEN 0.50 ELSE 1.00 END AS DECIMAL(10,2))"


def _at(text):
    return F.expr(f"timestamp_ntz'{text}'")


def usage(spark, sf):
    return frame(spark, sf, "usage")


def subs(spark, sf):
    return frame(spark, sf, "subscriptions")


#: What the usage table lacks of a scan.
_SCANNED = {"insights": "event_id % 4", "threats": "event_id % 3 * (user_id % 2)", "millis": "tokens * 2", "cache_hit": "event_id % 5 = 0", "fallback": "event_id % 7 = 0"}
_SCAN_ROWS = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in _SCANNED.items())} FROM {USAGE})"
_FOUND_ROWS = f"(SELECT user_id, seen_at, kind || CAST(event_id % 3 AS VARCHAR) AS threat_type, model AS severity, event_id % 11 = 0 AS zero_day, confidence FROM {USAGE})"


def _scanned(spark, sf):
    return usage(spark, sf).withColumns({c: F.expr(e) for c, e in _SCANNED.items()})


def _discovered(spark, sf):
    return usage(spark, sf).selectExpr("user_id", "seen_at", "concat(kind, event_id % 3) as threat_type", "model as severity", "event_id % 11 = 0 as zero_day", "confidence")


def a11_daily_usage(spark, sf):
    return U.daily_usage(_scanned(spark, sf), _at("2024-04-16 00:00:00"))


def a12_churn_view(spark, sf):
    return U.churn_view(_scanned(spark, sf), _at("2024-02-05 00:00:00"))


def a16_user_totals(spark, sf):
    return U.user_report(_scanned(spark, sf), _discovered(spark, sf), _at("2024-01-10 00:00:00"))[0]


def a16_user_days(spark, sf):
    return U.user_report(_scanned(spark, sf), _discovered(spark, sf), _at("2024-01-10 00:00:00"))[1]


def a14_usage_report(spark, sf):
    return U.usage_report(usage(spark, sf))


def a12_a15_churn_risk(spark, sf):
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return U.churn_risk(users, usage(spark, sf).select("user_id", "seen_at", (F.col("confidence") > 0.85).alias("hit"), (F.col("tokens") % 11).alias("minutes")), _at("2024-01-31 00:00:00"))


def a16_t10_top_per_user(spark, sf):
    return U.user_report(_scanned(spark, sf), _discovered(spark, sf), _at("2024-01-10 00:00:00"))[2]


def a17_llm_cost(spark, sf):
    rows = U.cost_cents(usage(spark, sf))
    return rows.groupBy("user_id", "model").agg(F.sum("cents").cast("double").alias("cents"), F.count_if(F.col("confidence") > 0.7).alias("threats"))


def a42_w9_model_routing(spark, sf):
    return U.model_routing(usage(spark, sf))


def a60_activity(spark, sf):
    return U.activity_profile(usage(spark, sf))


def a60_personal_activity(spark, sf):
    rows = usage(spark, sf)
    kind = F.expr("case kind when 'view' then 'tool_viewed' when 'click' then 'tool_tracked' when 'purchase' then 'search_performed' else 'stack_created' end")
    events = rows.select("user_id", kind.alias("kind"), F.concat(F.lit("t"), (F.col("event_id") % 23).cast("string")).alias("tool"), F.when(F.col("event_id") % 3 > 0, F.col("model")).alias("source"), F.when(F.col("event_id") % 2 > 0, F.col("kind")).alias("category"), F.when(F.col("event_id") % 5 > 0, F.lit("npm")).alias("ecosystem"), F.col("seen_at").alias("at"))
    return U.personal_activity(events)


def a18_insights(spark, sf):
    found = F.expr("transform(sequence(1, cast(event_id % 5 as int) + 1), k -> (confidence + k / 10.0D) % 1)")
    return U.insights(usage(spark, sf).select("user_id", F.slice(found, F.lit(1), (F.col("event_id") % 5).cast("int")).alias("insights")))


def a13_threat_trends(spark, sf):
    return U.threat_trends(_discovered(spark, sf), _at("2024-07-16 00:00:00"))


def a19_recurring_revenue(spark, sf):
    return U.recurring_revenue(subs(spark, sf))


def a19_revenue_trend(spark, sf):
    return U.revenue_trend(subs(spark, sf), F.expr("date'2001-08-01'"))


def a20_conversion(spark, sf):
    return U.conversion(subs(spark, sf))


def a21_churn_by_plan(spark, sf):
    return U.churn_by_plan(subs(spark, sf))


def a21_churn_by_tenure(spark, sf):
    return U.churn_by_tenure(subs(spark, sf))


def a22_lifetime_value(spark, sf):
    return U.lifetime_value(subs(spark, sf), _at("2001-08-01 00:00:00"))


def a22_yearly_value(spark, sf):
    rows = subs(spark, sf).select("plan", _interval().alias("interval"), "created_at", F.col("canceled_at").alias("updated_at"))
    return U.yearly_value(rows, _at("2001-08-01 00:00:00"))


def _interval():
    return F.expr("case when sub_id % 3 = 0 then 'annual' else 'monthly' end")


def _transactions(spark, sf):
    kind = F.expr("case event_id % 4 when 0 then 'subscription' when 1 then 'purchase' else 'usage' end")
    amount = F.expr("case when event_id % 4 < 2 then case when event_id % 9 = 0 then 0 else tokens end else -tokens end")
    return usage(spark, sf).select("user_id", kind.alias("kind"), F.expr("case when event_id % 13 = 0 then 'failed' else 'done' end").alias("status"), amount.alias("amount"), F.col("seen_at").alias("created_at"))


def a24_payment_metrics(spark, sf):
    return U.payment_metrics(_transactions(spark, sf), subs(spark, sf).select("user_id", "plan", _interval().alias("interval")), _at("2024-01-31 00:00:00"))


def a24_no_payments(spark, sf):
    """A day without a payment counts as one that went well."""
    return U.payment_metrics(_transactions(spark, sf), subs(spark, sf).select("user_id", "plan", _interval().alias("interval")), _at("2030-01-01 00:00:00"))


def j23_top_consumers(spark, sf):
    return U.top_consumers(_transactions(spark, sf), read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name")), _at("2024-01-31 00:00:00"))


def a23_monthly_credits(spark, sf):
    rows = usage(spark, sf)
    return rows.groupBy(F.date_format("seen_at", "yyyy-MM").alias("month"), "kind").agg(F.sum(F.abs("cost")).cast("double").alias("credits"), F.count_distinct("user_id").alias("users"))


def _credits(spark, sf):
    amount = F.when(F.col("kind") == "purchase", F.col("cost")).otherwise(-F.col("cost"))
    meta = F.to_json(F.struct(F.when(F.col("kind") == "purchase", F.col("tokens") / 4).alias("price_usd"), F.concat(F.lit("f"), (F.col("event_id") % 17).cast("string")).alias("feature_type")))
    return usage(spark, sf).select(F.col("seen_at").alias("created_at"), "kind", amount.alias("amount"), meta.alias("metadata"))


def a23_credit_summary(spark, sf):
    return U.credit_summary(_credits(spark, sf), _at("2024-12-31 00:00:00"))


def a23_top_features(spark, sf):
    return U.top_features(_credits(spark, sf), _at("2024-01-31 00:00:00"))


def a24_j23_billing(spark, sf):
    return subs(spark, sf).groupBy("status").agg(F.count("*").alias("subscriptions"), F.count_distinct("user_id").alias("users"), F.sum("price_cents").cast("long").alias("cents"), F.round(F.coalesce(F.sum("price_cents") / F.nullif(F.count_distinct("user_id"), F.lit(0)), F.lit(0.0)), 4).alias("per_user"))


def j19_users_subscriptions(spark, sf):
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    by = subs(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return users.join(by, "user_id", "left").groupBy("segment").agg(F.count("*").alias("users"), F.count("n").alias("subscribed"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("subscriptions"))


def j20_at_risk(spark, sf):
    return U.at_risk(subs(spark, sf), usage(spark, sf), _at("2024-01-31 00:00:00"))


def j22_credit_view(spark, sf):
    rows = usage(spark, sf)
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    by = rows.groupBy("user_id").agg(
        F.sum(F.when(F.col("kind") == "purchase", F.col("cost"))).alias("b"), F.sum(F.when(F.col("kind") != "purchase", F.col("cost"))).alias("s"), F.max("seen_at").alias("last")
    )
    return users.join(by, "user_id", "left").select("user_id", F.coalesce("b", F.lit(0)).cast("double").alias("bought"), F.coalesce("s", F.lit(0)).cast("double").alias("spent"), "last")


def j24_cross_metrics(spark, sf):
    a = usage(spark, sf).agg(F.count_distinct("user_id").alias("users"))
    b = subs(spark, sf).agg(F.count_distinct("plan").alias("plans"), F.count("*").alias("subscriptions"))
    c = frame(spark, sf, "scans").agg(F.count_distinct("package").alias("packages"))
    return a.crossJoin(b).crossJoin(c)


def r11_quota(spark, sf):
    return U.quota(usage(spark, sf))


def r18_sliding_window(spark, sf):
    return U.sliding_rejections(usage(spark, sf), 86_400, 2)


def r9_retention(spark, sf):
    from pyspark.sql import Window

    rank = Window.partitionBy("kind").orderBy(F.desc("seen_at"), F.desc("event_id"))
    return usage(spark, sf).select("kind", "event_id", "seen_at", F.row_number().over(rank).alias("n")).where("n <= 1000").select("kind", "event_id")


def r14_trim(spark, sf):
    return usage(spark, sf).orderBy(F.desc("seen_at"), F.desc("event_id")).limit(10_000).select("event_id", "user_id")


def t16_time_range(spark, sf):
    return usage(spark, sf).where("seen_at >= timestamp_ntz'2024-01-10 00:00:00' and seen_at < timestamp_ntz'2024-01-12 00:00:00'").groupBy("kind", F.hour("seen_at").alias("hour")).agg(F.sum("cost").cast("double").alias("cost"))


def a43_accuracy(spark, sf):
    rows = usage(spark, sf).agg(F.count_if((F.col("kind") == "error") & (F.col("confidence") > 0.5)).alias("tp"), F.count_if((F.col("kind") != "error") & (F.col("confidence") > 0.5)).alias("fp"), F.count("*").alias("n"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.col("n")
    return rows.select("tp", "fp", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r), 6).alias("f1"))


def a48_feature_usage(spark, sf):
    return usage(spark, sf).groupBy("user_id", "kind").agg(F.count("*").alias("uses"), F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))


def a49_bulk_credits(spark, sf):
    by = usage(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("tokens").cast("long").alias("base"))
    return by.select("user_id", "n", F.floor(F.col("base") * (10 + F.least("n", F.lit(10))) / 10).cast("long").alias("credits"))


def a54_consensus(spark, sf):
    by = usage(spark, sf).groupBy("user_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("click", "error", "view")], F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return by.select("user_id", "click", "error", "view", "confidence", F.round(F.greatest("click", "error", "view") / F.col("n"), 4).alias("consensus"))


def a55_share(spark, sf):
    by = usage(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    # one row
    total = usage(spark, sf).agg(F.count("*").alias("total"))
    return by.join(F.broadcast(total)).select("user_id", F.round(F.col("n") * 100 / F.col("total"), 1).alias("share"))


def a56_a58_status_counts(spark, sf):
    return subs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.count_if(F.col("canceled_at") > _at("2000-01-01 00:00:00")).alias("late"))


_DAYS = "date_diff('day', CAST({a} AS DATE), CAST({b} AS DATE))"
_TENURE = "date_diff('day', CAST(created_at AS DATE), CAST(canceled_at AS DATE))"
_TOKENS = f"round(CAST(tokens AS DECIMAL(18,0)) * {_PRICE} * CAST(0.001 AS DECIMAL(4,3)), 4)"

QUERIES = {
    "a11_daily_usage": (
        a11_daily_usage,
        f"SELECT CAST(seen_at AS DATE) AS day, count(DISTINCT user_id) AS users, count(*) AS scans, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost) AS DOUBLE) AS cost, CAST(sum(insights) AS BIGINT) AS insights, CAST(sum(threats) AS BIGINT) AS threats, round(avg(millis), 4) AS millis, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (fallback) AS fallbacks FROM {_SCAN_ROWS} WHERE seen_at >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1",
    ),
    "a12_churn_view": (
        a12_churn_view,
        f"""SELECT user_id, max(seen_at) AS last, count(*) AS scans, round(avg(threats), 4) AS threats, CASE WHEN max(seen_at) < TIMESTAMP '2024-01-22' THEN 'HIGH_RISK' WHEN count(*) < 5 AND max(seen_at) < TIMESTAMP '2024-01-29' THEN 'MEDIUM_RISK' WHEN avg(threats) < 0.1 THEN 'LOW_ENGAGEMENT' ELSE 'HEALTHY' END AS category
FROM {_SCAN_ROWS} WHERE seen_at >= TIMESTAMP '2024-01-06' GROUP BY 1""",
    ),
    "a16_user_totals": (
        a16_user_totals,
        f"""SELECT s.*, coalesce(z, 0) AS zero_days FROM (SELECT user_id, count(*) AS scans, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(insights) AS BIGINT) AS insights, CAST(sum(threats) AS BIGINT) AS threats, CAST(sum(cost) AS DOUBLE) AS cost FROM {_SCAN_ROWS} WHERE seen_at > TIMESTAMP '2024-01-10' GROUP BY 1) s
LEFT JOIN (SELECT user_id, count(*) AS z FROM {_FOUND_ROWS} WHERE zero_day AND seen_at > TIMESTAMP '2024-01-10' GROUP BY 1) f ON f.user_id = s.user_id""",
    ),
    "a16_user_days": (a16_user_days, f"SELECT user_id, CAST(seen_at AS DATE) AS day, count(*) AS scans, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(insights) AS BIGINT) AS insights, CAST(sum(threats) AS BIGINT) AS threats FROM {_SCAN_ROWS} WHERE seen_at > TIMESTAMP '2024-01-10' GROUP BY 1, 2"),
    "a24_payment_metrics": (
        a24_payment_metrics,
        f"""WITH d AS (SELECT *, event_id % 4 AS k FROM {USAGE} WHERE seen_at >= TIMESTAMP '2024-01-30'), c AS (SELECT count(*) FILTER (k = 0 AND event_id % 9 > 0 AND tokens > 0) AS successful, count(*) FILTER (k < 2 AND event_id % 13 = 0) AS failed FROM d)
SELECT successful, failed, round(successful / (successful + failed)::DOUBLE, 6) AS success_rate, (SELECT CAST(coalesce(sum(CASE WHEN plan = 'pro' THEN CASE WHEN sub_id % 3 = 0 THEN 232 ELSE 29 END WHEN plan = 'team' THEN CASE WHEN sub_id % 3 = 0 THEN 792 ELSE 99 END ELSE 0 END), 0) AS DOUBLE) FROM d JOIN {SUBS} s ON s.user_id = d.user_id WHERE k = 0 AND event_id % 9 > 0 AND tokens > 0) AS revenue FROM c""",
    ),
    "a24_no_payments": (a24_no_payments, "SELECT CAST(0 AS BIGINT) AS successful, CAST(0 AS BIGINT) AS failed, CAST(1 AS DOUBLE) AS success_rate, CAST(0 AS DOUBLE) AS revenue"),
    "j23_top_consumers": (j23_top_consumers, f"SELECT user_id, c_name AS name, CAST(sum(tokens) AS DOUBLE) AS credits, count(*) AS transactions FROM {USAGE} JOIN customer ON c_custkey = user_id WHERE event_id % 4 > 1 AND tokens > 0 AND seen_at >= TIMESTAMP '2024-01-24' GROUP BY 1, 2 ORDER BY credits DESC, user_id LIMIT 10"),
    "a14_usage_report": (
        a14_usage_report,
        f"SELECT count(*) AS events, count(DISTINCT user_id) AS users, round(count(*) FILTER (kind = 'error') / CAST(count(*) AS DOUBLE), 4) AS error_rate, round(count(*) FILTER (confidence > 0.7::DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS confident_rate, CAST(sum(cost) AS DOUBLE) AS cost FROM {USAGE}",
    ),
    "a12_a15_churn_risk": (
        a12_a15_churn_risk,
        f"""WITH s AS (SELECT user_id, date_diff('day', CAST(max(seen_at) AS DATE), DATE '2024-01-31') AS silent, count(*) AS n, avg(CASE WHEN confidence > 0.85::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS hits, avg(tokens % 11) AS minutes FROM {USAGE} WHERE seen_at > TIMESTAMP '2024-01-01 00:00:00' AND seen_at <= TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
p AS (SELECT c_custkey AS user_id, hits, CAST(CASE WHEN n IS NULL THEN 90 ELSE CASE WHEN n < 4 THEN 25 ELSE 0 END + CASE WHEN silent > 14 THEN 35 WHEN silent > 7 THEN 20 ELSE 0 END + CASE WHEN hits < 0.1 THEN 20 ELSE 0 END + CASE WHEN minutes < 5 THEN 15 ELSE 0 END END AS INTEGER) AS score FROM customer LEFT JOIN s ON c_custkey = user_id)
SELECT user_id, score, CASE WHEN score >= 60 THEN 'HIGH_RISK' WHEN score >= 35 THEN 'MEDIUM_RISK' WHEN hits < 0.2 THEN 'LOW_ENGAGEMENT' ELSE 'HEALTHY' END AS level FROM p""",
    ),
    "a16_t10_top_per_user": (a16_t10_top_per_user, f"SELECT user_id, threat_type, count(*) AS n, round(avg(confidence), 4) AS confidence, CAST(row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, threat_type) AS INTEGER) AS rank FROM {_FOUND_ROWS} WHERE seen_at > TIMESTAMP '2024-01-10' GROUP BY 1, 2 QUALIFY rank <= 5"),
    "a17_llm_cost": (a17_llm_cost, f"SELECT user_id, model, CAST(sum({_TOKENS}) AS DOUBLE) AS cents, count(*) FILTER (confidence > 0.7::DOUBLE) AS threats FROM {USAGE} GROUP BY 1, 2"),
    "a42_w9_model_routing": (
        a42_w9_model_routing,
        f"""WITH m AS (SELECT model, count(*) AS events, round(avg(confidence), 4) AS confidence, CAST(sum({_TOKENS}) AS DOUBLE) AS cents, CAST(sum(round(CAST(tokens AS DECIMAL(18,0)) * CAST(1.00 AS DECIMAL(10,2)) * CAST(0.001 AS DECIMAL(4,3)), 4)) AS DOUBLE) AS f FROM {USAGE} GROUP BY 1)
SELECT model, events, round(events * 100 / CAST(sum(events) OVER () AS DOUBLE), 4) AS share, confidence, round(cents, 2) AS cents, round(f - cents, 2) AS saved FROM m""",
    ),
    "a60_personal_activity": (
        a60_personal_activity,
        f"""WITH e AS (SELECT user_id, CASE kind WHEN 'view' THEN 'tool_viewed' WHEN 'click' THEN 'tool_tracked' WHEN 'purchase' THEN 'search_performed' ELSE 'stack_created' END AS k, 't' || CAST(event_id % 23 AS VARCHAR) AS tool, kind, model, event_id, seen_at FROM {USAGE}),
c AS (SELECT user_id, 'type' AS what, k AS value, count(*) AS n FROM e GROUP BY 1, 3 UNION ALL SELECT user_id, CASE k WHEN 'tool_viewed' THEN 'viewed' ELSE 'tracked' END, tool, count(*) FROM e WHERE k IN ('tool_viewed', 'tool_tracked') GROUP BY 1, 2, 3
 UNION ALL SELECT user_id, 'source', CASE WHEN event_id % 3 > 0 THEN model ELSE 'unknown' END, count(*) FROM e WHERE k = 'search_performed' GROUP BY 1, 3 UNION ALL SELECT user_id, 'category', kind, count(*) FROM e WHERE event_id % 2 > 0 GROUP BY 1, 3
 UNION ALL SELECT user_id, 'ecosystem', 'npm', count(*) FROM e WHERE event_id % 5 > 0 GROUP BY 1 UNION ALL SELECT user_id, 'weekday', CAST(isodow(seen_at) - 1 AS VARCHAR), count(*) FROM e GROUP BY 1, 3 UNION ALL SELECT user_id, 'hour', CAST(hour(seen_at) AS VARCHAR), count(*) FROM e GROUP BY 1, 3)
SELECT * FROM c QUALIFY what NOT IN ('viewed', 'tracked') OR row_number() OVER (PARTITION BY user_id, what ORDER BY n DESC, value) <= 10""",
    ),
    "a18_insights": (
        a18_insights,
        f"""WITH e AS (SELECT user_id, list_transform(range(1, CAST(event_id % 5 AS INTEGER) + 1), lambda k: (confidence + k / 10::DOUBLE) % 1) AS found FROM {USAGE})
SELECT user_id, CAST(sum(len(list_filter(found, lambda x: x > 0.7::DOUBLE))) AS BIGINT) AS threats, round(avg(coalesce(list_avg(found), 0)), 6) AS confidence FROM e GROUP BY 1""",
    ),
    "a60_activity": (a60_activity, f"SELECT CAST(isodow(seen_at) - 1 AS INTEGER) AS weekday, CAST(hour(seen_at) AS INTEGER) AS hour, count(*) AS events FROM {USAGE} GROUP BY 1, 2"),
    "a13_threat_trends": (a13_threat_trends, f"SELECT CAST(seen_at AS DATE) AS day, threat_type, severity, count(*) AS discoveries, count(*) FILTER (zero_day) AS zero_days, round(avg(confidence), 4) AS confidence FROM {_FOUND_ROWS} WHERE seen_at >= TIMESTAMP '2024-01-16' GROUP BY 1, 2, 3"),
    "a19_recurring_revenue": (
        a19_recurring_revenue,
        f"SELECT plan, count(DISTINCT user_id) AS subscribers, CAST(sum(price_cents) AS BIGINT) AS cents FROM {SUBS} WHERE status = 'active' GROUP BY plan UNION ALL SELECT 'total', count(DISTINCT user_id), CAST(sum(price_cents) AS BIGINT) FROM {SUBS} WHERE status = 'active'",
    ),
    "a19_revenue_trend": (
        a19_revenue_trend,
        f"""WITH t AS (SELECT k AS step, CAST(DATE '2001-08-01' - INTERVAL '330' DAY + INTERVAL '1' DAY * CAST(30 * k AS INTEGER) AS DATE) AS as_of FROM range(12) r(k))
SELECT step, as_of, CAST(sum(price_cents) AS BIGINT) AS cents FROM t JOIN {SUBS} s ON price_cents > 0 AND CAST(created_at AS DATE) <= as_of AND (canceled_at IS NULL OR CAST(canceled_at AS DATE) > as_of) GROUP BY 1, 2""",
    ),
    "a20_conversion": (
        a20_conversion,
        f"""WITH u AS (SELECT user_id, min(created_at) AS f, min(created_at) FILTER (price_cents > 0) AS p FROM {SUBS} GROUP BY 1)
SELECT count(*) AS users, count(p) AS paying, round(count(p) / CAST(count(*) AS DOUBLE), 4) AS rate, round(avg(date_diff('day', CAST(f AS DATE), CAST(p AS DATE))), 4) AS days FROM u""",
    ),
    "a21_churn_by_plan": (a21_churn_by_plan, f"SELECT plan, count(*) AS subscriptions, round(count(*) FILTER (status = 'canceled') / CAST(count(*) AS DOUBLE), 4) AS churn FROM {SUBS} GROUP BY plan"),
    "a21_churn_by_tenure": (
        a21_churn_by_tenure,
        f"""SELECT bucket, count(*) AS subscriptions, round(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS share FROM (SELECT CASE WHEN {_TENURE} < 30 THEN '0-1 months' WHEN {_TENURE} < 90 THEN '1-3 months' WHEN {_TENURE} < 180 THEN '3-6 months' WHEN {_TENURE} < 365 THEN '6-12 months' ELSE 'over a year' END AS bucket FROM {SUBS} WHERE status = 'canceled') GROUP BY bucket""",
    ),
    "a22_lifetime_value": (
        a22_lifetime_value,
        f"""WITH p AS (SELECT plan, avg(price_cents) AS price, avg(date_diff('day', CAST(created_at AS DATE), CAST(coalesce(canceled_at, TIMESTAMP '2001-08-01 00:00:00') AS DATE))) AS tenure FROM {SUBS} WHERE price_cents > 0 GROUP BY plan)
SELECT plan, round(price, 2) AS price, round(tenure, 2) AS tenure, round(price * tenure / 30, 2) AS value, round(price * tenure / 30 / 5000, 2) AS ratio FROM p""",
    ),
    "a22_yearly_value": (
        a22_yearly_value,
        f"""WITH p AS (SELECT plan, date_diff('day', CAST(created_at AS DATE), CAST(coalesce(canceled_at, TIMESTAMP '2001-08-01') AS DATE)) AS days, CASE plan WHEN 'pro' THEN CASE WHEN sub_id % 3 = 0 THEN 232 ELSE 29 * 12 END WHEN 'team' THEN CASE WHEN sub_id % 3 = 0 THEN 792 ELSE 99 * 12 END ELSE 0 END AS v FROM {SUBS} WHERE plan <> 'free')
SELECT round(avg(v), 4) AS value, round(avg(v) / 75, 4) AS ratio, round(75 / 29::DOUBLE, 4) AS payback_months, round(avg(days) FILTER (plan = 'pro'), 4) AS pro_days, round(avg(days) FILTER (plan = 'team'), 4) AS team_days FROM p""",
    ),
    "a23_monthly_credits": (a23_monthly_credits, f"SELECT strftime(seen_at, '%Y-%m') AS month, kind, CAST(sum(abs(cost)) AS DOUBLE) AS credits, count(DISTINCT user_id) AS users FROM {USAGE} GROUP BY 1, 2"),
    "a23_credit_summary": (
        a23_credit_summary,
        f"""WITH t AS (SELECT CAST(coalesce(sum(CASE WHEN kind <> 'purchase' AND cost > 0 THEN cost END), 0) AS DOUBLE) AS consumed, CAST(coalesce(sum(CASE WHEN kind = 'purchase' THEN cost END), 0) AS DOUBLE) AS purchased, round(sum(CASE WHEN kind = 'purchase' THEN tokens / 4::DOUBLE END), 4) AS revenue, count(*) FILTER (kind = 'purchase') AS purchases FROM {USAGE} WHERE seen_at >= TIMESTAMP '2023-12-31')
SELECT *, CASE WHEN consumed > 0 THEN round(purchased / consumed, 6) ELSE 0 END AS monetization FROM t""",
    ),
    "a23_top_features": (a23_top_features, f"SELECT 'f' || CAST(event_id % 17 AS VARCHAR) AS feature, CAST(sum(cost) AS DOUBLE) AS credits, count(*) AS uses FROM {USAGE} WHERE kind <> 'purchase' AND cost > 0 AND seen_at >= TIMESTAMP '2024-01-01' GROUP BY 1 ORDER BY credits DESC, feature LIMIT 10"),
    "a24_j23_billing": (a24_j23_billing, f"SELECT status, count(*) AS subscriptions, count(DISTINCT user_id) AS users, CAST(sum(price_cents) AS BIGINT) AS cents, round(sum(price_cents) / CAST(count(DISTINCT user_id) AS DOUBLE), 4) AS per_user FROM {SUBS} GROUP BY status"),
    "j19_users_subscriptions": (
        j19_users_subscriptions,
        f"SELECT c_mktsegment AS segment, count(*) AS users, count(n) AS subscribed, CAST(coalesce(sum(n), 0) AS BIGINT) AS subscriptions FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM {SUBS} GROUP BY 1) s ON c_custkey = s.user_id GROUP BY 1",
    ),
    "j20_at_risk": (
        j20_at_risk,
        f"""WITH p AS (SELECT user_id, CAST(sum(price_cents) AS BIGINT) AS cents, bool_or(status = 'past_due') AS late FROM {SUBS} WHERE price_cents > 0 AND status <> 'canceled' GROUP BY 1), l AS (SELECT user_id, max(seen_at) AS last FROM {USAGE} GROUP BY 1)
SELECT p.user_id, cents, late, last FROM p LEFT JOIN l ON p.user_id = l.user_id WHERE late OR last IS NULL OR date_diff('day', CAST(last AS DATE), DATE '2024-01-31') > 7 ORDER BY cents DESC, p.user_id LIMIT 20""",
    ),
    "j22_credit_view": (
        j22_credit_view,
        f"SELECT c_custkey AS user_id, CAST(coalesce((SELECT sum(cost) FROM {USAGE} u WHERE u.user_id = c_custkey AND kind = 'purchase'), 0) AS DOUBLE) AS bought, CAST(coalesce((SELECT sum(cost) FROM {USAGE} u WHERE u.user_id = c_custkey AND kind <> 'purchase'), 0) AS DOUBLE) AS spent, (SELECT max(seen_at) FROM {USAGE} u WHERE u.user_id = c_custkey) AS last FROM customer",
    ),
    "j24_cross_metrics": (j24_cross_metrics, f"SELECT * FROM (SELECT count(DISTINCT user_id) AS users FROM {USAGE}), (SELECT count(DISTINCT plan) AS plans, count(*) AS subscriptions FROM {SUBS}), (SELECT count(DISTINCT package) AS packages FROM {source('scans')})"),
    "r11_quota": (r11_quota, f"SELECT user_id, strftime(seen_at, '%Y-%m') AS year_month, count(*) AS used FROM {USAGE} GROUP BY 1, 2"),
    "r18_sliding_window": (
        r18_sliding_window,
        f"""WITH s AS (SELECT user_id, CAST(floor(epoch(seen_at)) AS BIGINT) AS s, count(*) AS n FROM {USAGE} GROUP BY 1, 2), b AS (SELECT user_id, n, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86399 PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT user_id, CAST(sum(n) AS BIGINT) AS requests, CAST(coalesce(sum(n) FILTER (before >= 2), 0) AS BIGINT) AS rejected FROM b GROUP BY 1""",
    ),
    "r9_retention": (r9_retention, f"SELECT kind, event_id FROM {USAGE} QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seen_at DESC, event_id DESC) <= 1000"),
    "r14_trim": (r14_trim, f"SELECT event_id, user_id FROM {USAGE} ORDER BY seen_at DESC, event_id DESC LIMIT 10000"),
    "t16_time_range": (t16_time_range, f"SELECT kind, CAST(hour(seen_at) AS INTEGER) AS hour, CAST(sum(cost) AS DOUBLE) AS cost FROM {USAGE} WHERE seen_at >= TIMESTAMP '2024-01-10 00:00:00' AND seen_at < TIMESTAMP '2024-01-12 00:00:00' GROUP BY 1, 2"),
    "a43_accuracy": (
        a43_accuracy,
        f"""WITH c AS (SELECT count(*) FILTER (kind = 'error' AND confidence > 0.5::DOUBLE) AS tp, count(*) FILTER (kind <> 'error' AND confidence > 0.5::DOUBLE) AS fp, count(*) AS n FROM {USAGE}), p AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(n AS DOUBLE) AS r FROM c)
SELECT tp, fp, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM p""",
    ),
    "a48_feature_usage": (a48_feature_usage, f"SELECT user_id, kind, count(*) AS uses, min(seen_at) AS first, max(seen_at) AS last FROM {USAGE} GROUP BY 1, 2"),
    "a49_bulk_credits": (a49_bulk_credits, f"SELECT user_id, count(*) AS n, CAST(floor(sum(tokens) * (10 + least(count(*), 10)) / 10.0) AS BIGINT) AS credits FROM {USAGE} GROUP BY 1"),
    "a54_consensus": (
        a54_consensus,
        f"SELECT user_id, count(*) FILTER (kind = 'click') AS click, count(*) FILTER (kind = 'error') AS error, count(*) FILTER (kind = 'view') AS view, round(avg(confidence), 4) AS confidence, round(greatest(count(*) FILTER (kind = 'click'), count(*) FILTER (kind = 'error'), count(*) FILTER (kind = 'view')) / CAST(count(*) AS DOUBLE), 4) AS consensus FROM {USAGE} GROUP BY 1",
    ),
    "a55_share": (a55_share, f"SELECT user_id, round(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE), 1) AS share FROM {USAGE} GROUP BY 1"),
    "a56_a58_status_counts": (a56_a58_status_counts, f"SELECT status, count(*) AS n, min(created_at) AS first, max(created_at) AS last, count(*) FILTER (canceled_at > TIMESTAMP '2000-01-01 00:00:00') AS late FROM {SUBS} GROUP BY status"),
}
