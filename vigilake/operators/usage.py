"""Usage, cost, churn and revenue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cents for a thousand tokens of models of three sizes; callers give their own table.
TOKEN_CENTS = {"small": "0.10", "medium": "0.50", "large": "1.00"}


def price(model: Column, cents: dict[str, str]) -> Column:
    chain = F
    for name, each in cents.items():
        chain = chain.when(model == name, F.lit(each).cast("decimal(10,2)"))
    return chain


def cost_cents(usage: DataFrame, cents: dict[str, str] = TOKEN_CENTS) -> DataFrame:
    """usage with cents: tokens / 1000 * price of the model, exact to a hundredth of a cent; null for a model that the table lacks."""
    return usage.withColumn("cents", F.round(F.col("tokens").cast("decimal(18,0)") * price(F.col("model"), cents) / 1000, 4).cast("decimal(18,4)"))


def daily_usage(usage: DataFrame, now: Column) -> DataFrame:
    """By day of the three months before now: users, scans, tokens, cents, insights, threats, mean milliseconds, cache hits, fallbacks."""
    rows = usage.where(F.col("seen_at") >= F.add_months(now, -3))
    return rows.groupBy(F.to_date("seen_at").alias("day")).agg(
        F.count_distinct("user_id").alias("users"),
        F.count("*").alias("scans"),
        *[F.sum(c).cast("long").alias(c) for c in ("tokens", "insights", "threats")],
        F.sum("cost").cast("double").alias("cost"),
        F.round(F.avg("millis"), 4).alias("millis"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if("fallback").alias("fallbacks"),
    )


def churn_view(usage: DataFrame, now: Column) -> DataFrame:
    """user_id, last, scans, threats (a scan, on average), category of the users seen in the 30 days before now: HIGH_RISK after 14 silent days, MEDIUM_RISK with under 5 scans after 7, LOW_ENGAGEMENT with under 0.1 threats, else HEALTHY."""
    by = usage.where(F.col("seen_at") >= now - F.expr("interval 30 days")).groupBy("user_id").agg(F.max("seen_at").alias("last"), F.count("*").alias("scans"), F.avg("threats").alias("threats"))
    silent = lambda days: F.col("last") < now - F.make_dt_interval(F.lit(days))
    category = F.when(silent(14), "HIGH_RISK").when((F.col("scans") < 5) & silent(7), "MEDIUM_RISK").when(F.col("threats") < 0.1, "LOW_ENGAGEMENT").otherwise("HEALTHY")
    return by.select("user_id", "last", "scans", F.round("threats", 4).alias("threats"), category.alias("category"))


def threat_trends(found: DataFrame, now: Column) -> DataFrame:
    """day, threat_type, severity, discoveries, zero_days, mean confidence of the six months before now."""
    rows = found.where(F.col("seen_at") >= F.add_months(now, -6))
    return rows.groupBy(F.to_date("seen_at").alias("day"), "threat_type", "severity").agg(F.count("*").alias("discoveries"), F.count_if("zero_day").alias("zero_days"), F.round(F.avg("confidence"), 4).alias("confidence"))


def user_report(usage: DataFrame, found: DataFrame, since: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames of what is newer than since: by user scans, tokens, cents, insights, threats and zero_days; by user and day scans, tokens, insights and threats; and each user's five
    most frequent threat types with their number and mean confidence, ties by name.
    """
    rows, threats = usage.where(F.col("seen_at") > since), found.where(F.col("seen_at") > since)
    sums = lambda *names: [F.sum(c).cast("long").alias(c) for c in names]
    days = threats.where("zero_day").groupBy("user_id").agg(F.count("*").alias("zero_days"))
    total = rows.groupBy("user_id").agg(F.count("*").alias("scans"), *sums("tokens", "insights", "threats"), F.sum("cost").cast("double").alias("cost")).join(days, "user_id", "left").withColumn("zero_days", F.coalesce("zero_days", F.lit(0)))
    daily = rows.groupBy("user_id", F.to_date("seen_at").alias("day")).agg(F.count("*").alias("scans"), *sums("tokens", "insights", "threats"))
    kinds = threats.groupBy("user_id", "threat_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "threat_type"))
    return total, daily, kinds.withColumn("rank", rank).where("rank <= 5")


def usage_report(usage: DataFrame) -> DataFrame:
    """One row for the whole input: rates are 0 when there is nothing."""
    rate = lambda c: F.coalesce(F.round(F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(0.0))
    return usage.agg(
        F.count("*").alias("events"),
        F.count_distinct("user_id").alias("users"),
        rate(F.col("kind") == "error").alias("error_rate"),
        rate(F.col("confidence") > 0.7).alias("confident_rate"),
        F.coalesce(F.sum("cost"), F.lit(0)).cast("double").alias("cost"),
    )


def churn_risk(users: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """user_id, score, level of users(user_id) from their usage(user_id, seen_at, hit, minutes) in the 30 days before now.

    Points: 25 for under 4 events, 35 for over 14 days of silence or 20 for over 7, 20 for hits in under a tenth of the events, 15 for sessions of under
    5 minutes on average; 90 for users that did nothing. HIGH_RISK from 60, MEDIUM_RISK from 35, else LOW_ENGAGEMENT with hits in under a fifth.
    """
    recent = usage.where((F.col("seen_at") > now - F.expr("interval 30 days")) & (F.col("seen_at") <= now))
    seen = recent.groupBy("user_id").agg(F.datediff(now, F.max("seen_at")).alias("silent"), F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hits"), F.coalesce(F.avg("minutes"), F.lit(0.0)).alias("minutes"))
    points = (
        F.when(F.col("n") < 4, 25).otherwise(0) + F.when(F.col("silent") > 14, 35).when(F.col("silent") > 7, 20).otherwise(0)
        + F.when(F.col("hits") < 0.1, 20).otherwise(0) + F.when(F.col("minutes") < 5, 15).otherwise(0)
    )
    score = F.when(F.col("n").isNull(), 90).otherwise(points)
    level = F.when(score >= 60, "HIGH_RISK").when(score >= 35, "MEDIUM_RISK").when(F.col("hits") < 0.2, "LOW_ENGAGEMENT").otherwise("HEALTHY")
    return users.join(seen, "user_id", "left").select("user_id", score.alias("score"), level.alias("level"))


def credit_summary(entries: DataFrame, now: Column) -> DataFrame:
    """One row of entries(created_at, kind, amount, metadata) of the twelve months before now: credits consumed and purchased, their ratio (0 without any), revenue and number of purchases.

    Amounts below 0 are consumption; metadata is JSON with price_usd.
    """
    rows = entries.where(F.col("created_at") >= F.add_months(now, -12))
    price = F.get_json_object("metadata", "$.price_usd").cast("double")
    bought, used = F.col("kind") == "purchase", F.col("amount") < 0
    out = rows.agg(
        F.coalesce(F.sum(F.when(used, F.abs("amount"))), F.lit(0)).cast("double").alias("consumed"), F.coalesce(F.sum(F.when(bought, F.col("amount"))), F.lit(0)).cast("double").alias("purchased"),
        F.round(F.sum(F.when(bought, price)), 4).alias("revenue"), F.count_if(bought).alias("purchases"),
    )
    return out.withColumn("monetization", F.when(F.col("consumed") > 0, F.round(F.col("purchased") / F.col("consumed"), 6)).otherwise(0.0))


def top_features(entries: DataFrame, now: Column, top: int = 10) -> DataFrame:
    """feature, credits, uses: the features that used most credits in the 30 days before now."""
    rows = entries.where((F.col("amount") < 0) & (F.col("created_at") >= now - F.expr("interval 30 days")))
    by = rows.groupBy(F.get_json_object("metadata", "$.feature_type").alias("feature")).agg(F.sum(F.abs("amount")).cast("double").alias("credits"), F.count("*").alias("uses"))
    return by.orderBy(F.desc("credits"), "feature").limit(top)


def top_per_user(usage: DataFrame, n: int = 5) -> DataFrame:
    """user_id, kind, events, rank: the n kinds a user has most."""
    counted = usage.groupBy("user_id", "kind").agg(F.count("*").alias("events"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("events"), "kind"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= n)


def model_routing(usage: DataFrame, cents: dict[str, str] = TOKEN_CENTS) -> DataFrame:
    """model, events, share, mean confidence, cents, and what the dearest model would have cost more."""
    dearest = max(cents.values(), key=float)
    costs = cost_cents(usage, cents).withColumn("full", F.round(F.col("tokens").cast("decimal(18,0)") * F.lit(dearest).cast("decimal(10,2)") / 1000, 4).cast("decimal(18,4)"))
    by = costs.groupBy("model").agg(F.count("*").alias("events"), F.round(F.avg("confidence"), 4).alias("confidence"), F.sum("cents").cast("double").alias("cents"), F.sum("full").cast("double").alias("full"))
    return by.select("model", "events", F.round(F.col("events") * 100 / F.sum("events").over(Window.partitionBy()), 4).alias("share"), "confidence", F.round("cents", 2).alias("cents"), F.round(F.col("full") - F.col("cents"), 2).alias("saved"))


def activity_profile(usage: DataFrame) -> DataFrame:
    """weekday (Monday 0), hour, events."""
    return usage.groupBy(F.weekday("seen_at").alias("weekday"), F.hour("seen_at").alias("hour")).agg(F.count("*").alias("events"))


def recurring_revenue(subs: DataFrame) -> DataFrame:
    """plan, subscribers, cents a month of active subscriptions, and all plans as 'total'."""
    live = subs.where("status = 'active'")
    out = live.groupingSets([("plan",), ()], "plan").agg(F.grouping("plan").alias("__all"), F.count_distinct("user_id").alias("subscribers"), F.sum("price_cents").cast("long").alias("cents"))
    return out.select(F.when(F.col("__all") == 1, "total").otherwise(F.col("plan")).alias("plan"), "subscribers", "cents")


def revenue_trend(subs: DataFrame, end: Column, steps: int = 12, days: int = 30) -> DataFrame:
    """step, as_of, cents: what was live at each of the last steps, days apart.

    Each subscription is spread over the steps it spans by arithmetic, so no range join is needed.
    """
    last = F.lit(steps - 1)
    first_at = F.date_sub(end, days * (steps - 1))
    low = F.greatest(F.lit(0), F.ceil(F.datediff("created_at", first_at) / days)).cast("int")
    high = F.least(last, F.coalesce(F.ceil(F.datediff("canceled_at", first_at) / days) - 1, last)).cast("int")
    rows = subs.where("price_cents > 0").select("price_cents", low.alias("low"), high.alias("high")).where("low <= high")
    return (
        rows.select("price_cents", F.explode(F.sequence("low", "high")).alias("step"))
        .groupBy("step")
        .agg(F.sum("price_cents").cast("long").alias("cents"))
        .select(F.col("step").cast("long").alias("step"), F.date_add(first_at, (F.col("step") * days).cast("int")).alias("as_of"), "cents")
    )


def conversion(subs: DataFrame) -> DataFrame:
    """One row: users, those that ever paid, their share, and mean days from the first subscription to the first paid one."""
    users = subs.groupBy("user_id").agg(F.min("created_at").alias("first"), F.min(F.when(F.col("price_cents") > 0, F.col("created_at"))).alias("paid"))
    return users.agg(
        F.count("*").alias("users"), F.count("paid").alias("paying"), F.round(F.count("paid") / F.count("*"), 4).alias("rate"), F.round(F.avg(F.datediff("paid", "first")), 4).alias("days")
    )


def churn_by_tenure(subs: DataFrame) -> DataFrame:
    """bucket, subscriptions, share of those canceled by days they lasted."""
    days = F.datediff("canceled_at", "created_at")
    bucket = F.when(days < 30, "0-1 months").when(days < 90, "1-3 months").when(days < 180, "3-6 months").when(days < 365, "6-12 months").otherwise("over a year")
    by = subs.where("status = 'canceled'").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("subscriptions"))
    return by.withColumn("share", F.round(F.col("subscriptions") * 100 / F.sum("subscriptions").over(Window.partitionBy()), 4))


def churn_by_plan(subs: DataFrame) -> DataFrame:
    return subs.groupBy("plan").agg(F.count("*").alias("subscriptions"), F.round(F.count_if(F.col("status") == "canceled") / F.count("*"), 4).alias("churn"))


# What a year of a plan brings by interval of payment, the price of a month of each, and the cost of acquiring a customer.
YEARLY = {("pro", "monthly"): 348.0, ("pro", "annual"): 232.0, ("team", "monthly"): 1188.0, ("team", "annual"): 792.0}
ONCE = {("pro", "monthly"): 29.0, ("pro", "annual"): 232.0, ("team", "monthly"): 99.0, ("team", "annual"): 792.0}
ACQUISITION, PRO_MONTH = 75.0, 29.0


def _by_plan(values: dict) -> Column:
    chain = F
    for (plan, interval), value in values.items():
        chain = chain.when((F.col("plan") == plan) & (F.col("interval") == interval), value)
    return chain.otherwise(0.0)


def lifetime_value(subs: DataFrame, now: Column, acquisition_cents: int = 5000) -> DataFrame:
    """plan, mean price, mean tenure in days, lifetime value and its ratio to the cost of acquisition."""
    tenure = F.datediff(F.coalesce("canceled_at", now), "created_at")
    by = subs.where("price_cents > 0").groupBy("plan").agg(F.avg("price_cents").alias("price"), F.avg(tenure).alias("tenure"))
    value = F.col("price") * F.col("tenure") / 30
    return by.select("plan", F.round("price", 2).alias("price"), F.round("tenure", 2).alias("tenure"), F.round(value, 2).alias("value"), F.round(value / acquisition_cents, 2).alias("ratio"))


def yearly_value(subs: DataFrame, now: Column) -> DataFrame:
    """One row of the paid plans among subs(plan, interval, created_at, updated_at): mean value of a year, its ratio to the cost of acquisition, months until that is paid back, and mean tenure in days of pro and team. 348 without any."""
    days = F.datediff(F.coalesce("updated_at", now), "created_at")
    out = subs.where("plan <> 'free'").agg(F.avg(_by_plan(YEARLY)).alias("v"), *[F.round(F.avg(F.when(F.col("plan") == p, days)), 4).alias(f"{p}_days") for p in ("pro", "team")])
    value = F.when(F.coalesce("v", F.lit(0.0)) == 0, 348.0).otherwise(F.col("v"))
    return out.select(F.round(value, 4).alias("value"), F.round(value / ACQUISITION, 4).alias("ratio"), F.lit(round(ACQUISITION / PRO_MONTH, 4)).alias("payback_months"), "pro_days", "team_days")


def payment_metrics(transactions: DataFrame, subs: DataFrame, now: Column) -> DataFrame:
    """One row of the day before now: payments that went through and that failed, the share of the former (1 without any), and revenue, of every subscription of the users that paid for one.

    transactions have user_id, kind, status, amount, created_at; subs have user_id, plan, interval. The join is on users with a payment, each payment with each subscription.
    """
    day = transactions.where(F.col("created_at") >= now - F.expr("interval 24 hours"))
    paid = (F.col("kind") == "subscription") & (F.col("amount") > 0)
    counts = day.where(F.col("kind").isin("subscription", "purchase")).agg(F.count_if(paid).alias("successful"), F.count_if(F.col("status") == "failed").alias("failed"))
    income = day.where(paid).select("user_id").join(subs, "user_id").agg(F.coalesce(F.sum(_by_plan(ONCE)), F.lit(0.0)).alias("revenue"))
    tried = F.col("successful") + F.col("failed")
    rate = F.when(tried > 0, F.round(F.col("successful") / tried, 6)).otherwise(1.0)
    return counts.crossJoin(F.broadcast(income)).select("successful", "failed", rate.alias("success_rate"), "revenue")  # one row each


def top_consumers(transactions: DataFrame, users: DataFrame, now: Column, top: int = 10) -> DataFrame:
    """user_id, name, credits, transactions: the users(user_id, name) that used most credits in the week before now, ties by id."""
    used = transactions.where((F.col("created_at") >= now - F.expr("interval 7 days")) & (F.col("amount") < 0)).groupBy("user_id").agg(F.sum(-F.col("amount")).cast("double").alias("credits"), F.count("*").alias("transactions"))
    return used.join(users, "user_id").orderBy(F.desc("credits"), "user_id").limit(top).select("user_id", "name", "credits", "transactions")


def at_risk(subs: DataFrame, usage: DataFrame, now: Column, top: int = 20) -> DataFrame:
    """The top paying users by revenue whose payment is late or who have been silent for a week."""
    paying = subs.where("price_cents > 0 and status <> 'canceled'").groupBy("user_id").agg(F.sum("price_cents").cast("long").alias("cents"), F.bool_or(F.col("status") == "past_due").alias("late"))
    seen = usage.groupBy("user_id").agg(F.max("seen_at").alias("last"))
    rows = paying.join(seen, "user_id", "left").where(F.col("late") | F.col("last").isNull() | (F.datediff(now, F.col("last")) > 7))
    return rows.orderBy(F.desc("cents"), "user_id").limit(top)


def quota(usage: DataFrame) -> DataFrame:
    """user_id, year_month, used."""
    return usage.groupBy("user_id", F.date_format("seen_at", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("used"))


def sliding_rejections(usage: DataFrame, seconds: int, limit: int) -> DataFrame:
    """user_id, requests, rejected: a request is rejected if the distinct seconds before it in the window reach the limit."""
    sec = F.unix_seconds(F.col("seen_at").cast("timestamp"))
    rows = usage.select("user_id", sec.alias("s")).groupBy("user_id", "s").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("user_id").orderBy("s").rangeBetween(-seconds + 1, -1)
    held = rows.withColumn("before", F.count("*").over(ahead))
    return held.groupBy("user_id").agg(F.sum("n").cast("long").alias("requests"), F.sum(F.when(F.col("before") >= limit, F.col("n")).otherwise(0)).cast("long").alias("rejected"))


def insights(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """user_id, threats, confidence of rows(user_id, insights (array of confidences)): those over least, and the mean of each row's, 0 for none."""
    own = F.coalesce("insights", F.array().cast("array<double>"))
    mean = F.when(F.size(own) > 0, F.aggregate(own, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.size(own)).otherwise(0.0)
    return rows.select("user_id", F.size(F.filter(own, lambda x: x > least)).alias("n"), mean.alias("m")).groupBy("user_id").agg(F.sum("n").alias("threats"), F.round(F.avg("m"), 6).alias("confidence"))


def personal_activity(events: DataFrame, top: int = 10) -> DataFrame:
    """user_id, what, value, n: events by type, the most viewed and tracked tools (the first of equals by name), sources of searches, categories, ecosystems, weekdays (Monday 0) and hours.

    events have user_id, kind, tool, source, category, ecosystem, at. One pass explodes what an event counts for; null values count for nothing, a search
    without a source for "unknown".
    """
    def entry(what: str, value: Column, when: Column | None = None) -> Column:
        found = F.struct(F.lit(what).alias("what"), value.cast("string").alias("value"))
        return F.when(value.isNotNull() if when is None else when & value.isNotNull(), found)

    kind = F.col("kind")
    parts = F.array_compact(F.array(
        entry("type", kind), entry("viewed", F.col("tool"), kind == "tool_viewed"), entry("tracked", F.col("tool"), kind == "tool_tracked"), entry("source", F.coalesce("source", F.lit("unknown")), kind == "search_performed"),
        entry("category", F.col("category")), entry("ecosystem", F.col("ecosystem")), entry("weekday", F.weekday("at")), entry("hour", F.hour("at")),
    ))
    counted = events.select("user_id", F.explode(parts).alias("p")).groupBy("user_id", "p.what", "p.value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id", "what").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).where(~F.col("what").isin("viewed", "tracked") | (F.col("rank") <= top)).drop("rank")
