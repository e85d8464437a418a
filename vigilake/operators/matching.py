"""Tools that fit together, look-alike names, trends and similar findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from . import setjoin

# What fits what among tools.
PROTOCOL_FITS = {"HTTP": ["HTTP", "REST", "Webhook"], "WebSocket": ["WebSocket", "HTTP"], "gRPC": ["gRPC", "HTTP"], "GraphQL": ["GraphQL", "HTTP"], "Webhook": ["Webhook", "HTTP"]}
CAPABILITY_FITS = {
    "accesses_database": ["reads_files", "processes_user_input"],
    "makes_network_calls": ["handles_credentials", "processes_user_input"],
    "reads_files": ["processes_user_input", "generates_content"],
    "processes_user_input": ["generates_content", "accesses_database"],
    "handles_credentials": ["makes_network_calls", "accesses_database"],
}
CATEGORY_FITS = {
    "Database": ["API Integration", "Data Pipeline", "Monitoring"],
    "API Integration": ["Database", "Communication", "Security"],
    "Code Tools": ["Testing", "DevOps", "Security"],
    "File System": ["Code Tools", "Data Pipeline", "Security"],
    "AI/LLM": ["API Integration", "Data Pipeline", "Communication"],
    "Security": ["Code Tools", "API Integration", "Monitoring"],
    "DevOps": ["Code Tools", "Monitoring", "Security"],
    "Communication": ["API Integration", "AI/LLM"],
    "Data Pipeline": ["Database", "AI/LLM", "File System"],
    "Testing": ["Code Tools", "DevOps"],
    "Search": ["Database", "API Integration", "AI/LLM"],
    "Monitoring": ["DevOps", "Database", "Security"],
}
#: Words that say nothing of a group of texts.
STOP_WORDS = ["the", "and", "for", "with", "from", "this", "that", "have", "been", "were", "are", "was"]


def lookalikes(packages: DataFrame, targets: list[str]) -> DataFrame:
    """packages(name, ...) with target: every popular name that the package looks like. Targets are a short fixed list."""
    every = F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")
    return packages.select("*", every).where(N.is_lookalike(F.col("name"), F.col("target")))


def lookalike_alerts(packages: DataFrame, targets: list[str]) -> DataFrame:
    """name, target, distance, similarity, level, without equal names."""
    low = F.lower(F.element_at(F.split("name", "/"), -1))
    rows = packages.select("name", low.alias("low"), F.explode(F.array(*[F.lit(t) for t in targets])).alias("target")).where("low <> target")
    rows = rows.select("name", "target", F.levenshtein("low", "target").alias("distance"), F.round(N.similarity(F.col("low"), F.col("target")), 6).alias("similarity"))
    return rows.withColumn("level", N.lookalike_level(F.col("distance"), F.col("similarity"))).where("level is not null")


def item_classes(tools: DataFrame, items: str) -> DataFrame:
    """tool_id, class: tools with equal sets of items are one class, named by its sorted set as JSON; tools without items are left out."""
    own = F.array_sort(F.array_distinct(items))
    return tools.where(F.size(own) > 0).select("tool_id", F.to_json(own).alias("class"))


def _classes(members: DataFrame) -> DataFrame:
    """class, tools, size, item: a row for each item of each class of item_classes."""
    own = F.from_json("class", "array<string>")
    return members.groupBy("class").agg(F.count("*").alias("tools")).select("class", "tools", F.size(own).alias("size"), F.explode(own).alias("item"))


def shared_variable_classes(members: DataFrame, least: float = 0.3) -> DataFrame:
    """a, b (a <= b), score, tools_a, tools_b: classes of item_classes by the share of common items in the larger set; with itself if a class has two tools.

    Each tool of a matches each other tool of b. Classes meet by the rare items of their sets only.
    """
    own = members.groupBy("class").agg(F.count("*").alias("tools"))
    pairs = setjoin.by_larger(own.select(F.col("class").alias("id"), F.from_json("class", "array<string>").alias("items")), least)
    pairs = pairs.join(own.select(F.col("class").alias("a"), F.col("tools").alias("tools_a")), "a").join(own.select(F.col("class").alias("b"), F.col("tools").alias("tools_b")), "b")
    itself = own.where("tools > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("score"), F.col("tools").alias("tools_a"), F.col("tools").alias("tools_b"))
    return pairs.select("a", "b", F.round("share", 6).alias("score"), "tools_a", "tools_b").unionByName(itself)


def _fitting(item: Column, fits: dict[str, list[str]]) -> Column:
    """What the fixed table says fits the item; nothing for an item it lacks."""
    table = F.create_map(*[F.lit(x) for have, wants in fits.items() for x in (have, wants)])
    return F.try_element_at(table, item)


def complementary_classes(members: DataFrame, fits: dict[str, list[str]], each: float = 0.3, most: float = 1.0) -> DataFrame:
    """a, b, score, tools_a, tools_b: between classes of item_classes, each pair of items of a and b that fits names adds up; with itself if a class has two tools."""
    own = _classes(members)
    wants = own.select(F.col("class").alias("a"), F.col("tools").alias("tools_a"), F.explode(_fitting(F.col("item"), fits)).alias("want"))
    pairs = wants.join(own, (F.col("want") == F.col("item")) & ((F.col("a") != F.col("class")) | (F.col("tools") > 1)))
    pairs = pairs.groupBy("a", F.col("class").alias("b")).agg(F.count("*").alias("n"), F.max("tools_a").alias("tools_a"), F.max("tools").alias("tools_b"))
    return pairs.select("a", "b", F.round(F.least(F.col("n") * each, F.lit(most)), 6).alias("score"), "tools_a", "tools_b")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Class pairs with a <= b, also as (b, a)."""
    turned = pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "score", F.col("tools_b").alias("tools_a"), F.col("tools_a").alias("tools_b"))
    return pairs.unionByName(turned)


def matches_per_tool(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """tool_id, matches, best: how many other tools each tool matches and the best score, from class pairs in both directions."""
    sums = pairs.groupBy(F.col("a").alias("class")).agg(F.sum(F.col("tools_b") - (F.col("a") == F.col("b")).cast("int")).alias("matches"), F.max("score").alias("best"))
    return members.join(sums, "class").select("tool_id", "matches", "best")


def _first(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def category_matches(tools: DataFrame, related: dict[str, list[str]], top: int = 10) -> DataFrame:
    """a, b, score: for each tool the first few by score and id of the related categories; another ecosystem gives 0.6, the same 0.4.

    tools have tool_id, category, ecosystem. The score depends on the two ecosystems only, so few tools of each
    category and ecosystem can be matches of anything, and only kinds of tools are ranked, not tools.
    """
    few = _first(tools.select("tool_id", "category", "ecosystem"), ["category", "ecosystem"], ["tool_id"], top + 1)
    few = few.select(F.col("tool_id").alias("b"), F.col("category").alias("want"), F.col("ecosystem").alias("other"))
    kinds = tools.select("category", "ecosystem").distinct().withColumn("want", F.explode(_fitting(F.col("category"), related)))
    score = F.when(F.col("ecosystem").eqNullSafe(F.col("other")), 0.4).otherwise(0.6).alias("score")
    ranked = _first(kinds.join(few, "want").select("category", "ecosystem", "b", score), ["category", "ecosystem"], [F.desc("score"), "b"], top + 1)
    of = tools.select(F.col("tool_id").alias("a"), F.col("category").alias("c"), F.col("ecosystem").alias("e"))
    rows = of.join(ranked, (F.col("c") == F.col("category")) & F.col("e").eqNullSafe(F.col("ecosystem"))).where("a <> b")
    return _first(rows.select("a", "b", "score"), ["a"], [F.desc("score"), "b"], top)


def best_matches(tools: DataFrame, protocols: dict, capabilities: dict, related: dict, top: int = 20) -> DataFrame:
    """a, b, value, rank: the best tools b for each tool a by score times mean trust, over shared variables, fitting protocols and capabilities, and related categories.

    tools have tool_id, trust, category, ecosystem, and arrays variables, protocols, capabilities. In one
    class of equal items the score is the same, so only its most trusted few can be among the best. They are ranked
    for each kind of tool (its classes and its trust); a tool takes those of its kind less itself.
    """
    own = {"v": "variables", "p": "protocols", "c": "capabilities"}
    rows = tools.select("tool_id", "trust", *[F.to_json(F.array_sort(F.array_distinct(items))).alias(k) for k, items in own.items()], "category", "ecosystem")
    members = {k: item_classes(tools, items) for k, items in own.items()}
    pairs = {"v": both_ways(shared_variable_classes(members["v"])), "p": complementary_classes(members["p"], protocols, 0.4, 0.8), "c": complementary_classes(members["c"], capabilities)}
    keys = [*own, "category", "ecosystem", "trust"]
    rows = rows.withColumn("kind", F.xxhash64(*keys))
    kinds = rows.select("kind", *keys).distinct()
    found = None
    for k in own:
        few = _first(rows.select("tool_id", F.col("trust").alias("other"), k), [k], [F.desc("other"), "tool_id"], top + 1)
        part = kinds.select("kind", "trust", F.col(k).alias("a")).join(pairs[k].select("a", F.col("b").alias(k), "score"), "a").join(few, k)
        part = part.select("kind", F.col("tool_id").alias("b"), (F.col("score") * (F.col("trust") + F.col("other")) / 2).alias("value"))
        found = part if found is None else found.unionByName(part)
    near = kinds.select("kind", "trust", "ecosystem", F.explode(_fitting(F.col("category"), related)).alias("want"))
    few = _first(rows.select("tool_id", F.col("trust").alias("other"), F.col("category").alias("want"), F.col("ecosystem").alias("e")), ["want", "e"], [F.desc("other"), "tool_id"], top + 1)
    score = F.when(F.col("ecosystem").eqNullSafe(F.col("e")), 0.4).otherwise(0.6)
    found = found.unionByName(near.join(few, "want").select("kind", F.col("tool_id").alias("b"), (score * (F.col("trust") + F.col("other")) / 2).alias("value")))
    best = found.groupBy("kind", "b").agg(F.round(F.max("value"), 6).alias("value"))
    best = _first(best, ["kind"], [F.desc("value"), "b"], top + 1)
    each = rows.select(F.col("tool_id").alias("a"), "kind").join(best, "kind").where("a <> b")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("value"), "b"))
    return each.select("a", "b", "value", rank.alias("rank")).where(F.col("rank") <= top)


def stack(tools: DataFrame, least_trust: int = 70, among: int = 5) -> DataFrame:
    """category, tool_id, trust: of the most starred few of each category the most trusted that reaches least_trust."""
    trust = 100 - F.col("risk_score")
    first = Window.partitionBy("category").orderBy(F.desc("stars"), "tool_id")
    rows = tools.select("category", "tool_id", trust.alias("trust"), F.row_number().over(first).alias("n")).where(F.col("n") <= among).where(F.col("trust") >= least_trust)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("trust"), "tool_id"))).where("k = 1").select("category", "tool_id", "trust")


def collected_trust(stars: Column, downloads: Column, forks: Column, version: Column, issues: Column) -> Column:
    """0 to 100 points: stars up to 30, downloads up to 25, forks up to 20, 15 for a known version, 10 for under a tenth as many open issues as stars."""
    def points(n: Column, per: float, most: int) -> Column:
        return F.when(n > 0, F.least(F.lit(float(most)), n * per)).otherwise(0.0)

    known = F.when(F.coalesce(version, F.lit("")).isin("", "unknown"), 0.0).otherwise(15.0)
    calm = F.when((stars > 0) & (issues >= 0) & (issues / F.greatest(stars, F.lit(1)) < 0.1), 10.0).otherwise(0.0)
    return F.least(F.lit(100.0), points(stars, 1 / 10, 30) + points(downloads, 1 / 100, 25) + points(forks, 2, 20) + known + calm)


def growth(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.when(now > 0, 100.0).otherwise(0.0)).when(now == 0, -100.0).otherwise((now - before) * 100.0 / before)


def trending(metrics: DataFrame, tools: DataFrame, split: Column) -> DataFrame:
    """tool_id, score, growth, rank, direction from metrics(tool_id, seen_at, downloads, stars) before and after the split.

    Both periods are one conditional aggregation of one scan, not two joins.
    """
    new = F.col("seen_at") >= split
    periods = metrics.groupBy("tool_id").agg(
        F.avg(F.when(new, F.col("downloads"))).alias("now"), F.coalesce(F.avg(F.when(~new, F.col("downloads"))), F.lit(0.0)).alias("then"), F.coalesce(F.avg(F.when(new, F.col("stars"))), F.lit(0.0)).alias("stars")
    ).where("now is not null")
    rows = tools.select("tool_id", (100 - F.col("risk_score")).alias("trust")).join(periods, "tool_id").withColumn("growth", growth(F.col("now"), F.col("then")))
    most = rows.agg(F.max("now").alias("__d"), F.max("stars").alias("__s"))

    def norm(value, top):
        return F.when(top == 0, 0.0).otherwise(F.least(F.lit(1.0), value / top))

    grown = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("growth") + 100) / 600))
    score = (norm(F.col("now"), F.col("__d")) * 0.4 + grown * 0.3 + norm(F.col("stars"), F.col("__s")) * 0.2 + F.col("trust") / 100.0 * 0.1) * 100
    rows = rows.crossJoin(F.broadcast(most)).select("tool_id", F.round(score, 4).alias("score"), F.round("growth", 4).alias("growth"), F.col("then").alias("before"), "now")
    direction = F.when(F.col("growth") >= 25, "up").when(F.col("growth") <= -25, "down").otherwise("stable")
    return rows.withColumn("direction", direction)


def top_ranked(scored: DataFrame, n: int) -> DataFrame:
    """The n best by score with their rank; the limit runs before the window, so the window is small."""
    top = scored.orderBy(F.desc("score"), "tool_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "tool_id")))


def previous_ranks(cache: DataFrame, now: Column) -> DataFrame:
    """tool_id, previous: the rank in the oldest entry of cache(tool_id, rank, created_at, expires_at) that expired no more than a day ago and is over an hour old; of equally old ones the least."""
    kept = cache.where((F.col("expires_at") > now - F.expr("interval 24 hours")) & (F.col("created_at") < now - F.expr("interval 1 hour")))
    return kept.groupBy("tool_id").agg(F.min(F.struct("created_at", "rank")).getField("rank").alias("previous"))


def rank_changes(ranked: DataFrame, previous: DataFrame) -> DataFrame:
    """ranked(tool_id, rank, growth, before, now, ...) with change (places gained since the previous rank, 0 without one) and direction: new, up, down or stable."""
    rows = ranked.join(previous, "tool_id", "left").withColumn("change", F.coalesce(F.col("previous") - F.col("rank"), F.lit(0)))
    new = (F.col("before") == 0) & (F.col("now") > 0)
    up, down = (F.col("growth") >= 25) | (F.col("change") > 0), (F.col("growth") <= -25) | (F.col("change") < 0)
    return rows.withColumn("direction", F.when(new, "new").when(up, "up").when(down, "down").otherwise("stable"))


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """The newest row of each tool of metrics(tool_id, date, ...); of equally new ones the largest by the other columns. A maximum of structs combines before the shuffle."""
    rest = [c for c in metrics.columns if c not in ("tool_id", "date")]
    return metrics.groupBy("tool_id").agg(F.max(F.struct("date", *rest)).alias("m")).select("tool_id", "m.*")


def pattern_groups(findings: DataFrame) -> DataFrame:
    """rule, findings, files, worst severity, severities as 'name=count' in order, common: the words of four letters or more in at least half of the descriptions, in order.

    findings have rule, severity, file, description.
    """
    from ..functions.severity import RANK, lookup

    by = findings.groupBy("rule", "severity").agg(F.count("*").alias("n"))
    files = findings.groupBy("rule").agg(F.count_distinct("file").alias("files"))
    part = F.struct((-lookup(F.col("severity"), RANK, 0)).alias("k"), F.concat_ws("=", "severity", F.col("n").cast("string")).alias("s"))
    levels = by.groupBy("rule").agg(F.sum("n").cast("long").alias("findings"), F.min(F.struct((-lookup(F.col("severity"), RANK, 0)).alias("k"), "severity")).getField("severity").alias("worst"), F.array_sort(F.collect_list(part)).alias("parts"))
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"(\w+)"))), lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))
    counts = findings.select("rule", F.explode(words).alias("word")).groupBy("rule", "word").agg(F.count("*").alias("n")).join(by.groupBy("rule").agg(F.sum("n").alias("all")), "rule")
    common = counts.where(F.col("n") * 2 >= F.col("all")).groupBy("rule").agg(F.array_join(F.array_sort(F.collect_list("word")), ",").alias("common"))
    levels = levels.join(common, "rule", "left")
    return levels.join(files, "rule").select("rule", "findings", "files", "worst", F.coalesce("common", F.lit("")).alias("common"), F.array_join(F.transform("parts", lambda p: p["s"]), ",").alias("severities"))


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """a, b (a < b), jaccard over least of sets(id, items). Meant for classes of equal sets; they meet by their rare items only."""
    return setjoin.by_jaccard(sets, least).select("a", "b", F.round("jaccard", 6).alias("jaccard")).where(F.col("jaccard") > least)


#: Different word sets of a group that are compared in one row; those of a larger group are joined.
FEW = 48


def _weighted_likeness(sets: Column) -> Column:
    """The sum, over pairs of an array of (words, n), of both n times the Jaccard similarity of the words."""

    def with_later(i: Column) -> Column:
        one = F.element_at(sets, i)
        shared = lambda t: F.size(F.array_intersect(one["words"], t["words"])).cast("double")
        part = lambda t: one["n"] * t["n"] * shared(t) / (F.size(one["words"]) + F.size(t["words"]) - shared(t))
        return F.aggregate(F.slice(sets, i + 1, F.size(sets)), F.lit(0.0), lambda total, t: total + part(t))

    return F.aggregate(F.sequence(F.lit(1), F.size(sets) - 1), F.lit(0.0), lambda total, i: total + with_later(i))


def root_cause_similarity(findings: DataFrame, keys: list[str], lines: int = 50) -> DataFrame:
    """keys, findings, similarity: the mean over all pairs of findings of a group of 0.3 for the same file, 0.2 for lines less than 50 apart, 0.1 for the same severity and 0.4 times the Jaccard similarity of the words of their evidence.

    findings have file, line, severity, evidence. A group of one has 0. Pairs are counted, not made: equal files
    and severities by group sizes, near lines by a range window over distinct lines, evidence by pairs of distinct word
    sets, weighted by their sizes, inside one row where a group has few, else by a join on common words. A null file or severity is a value of its own, a null line is near none, evidence without words is like none.
    """
    def pairs(n: Column) -> Column:
        return n * (n - 1) / 2

    def same(column: str) -> DataFrame:
        return findings.groupBy(*keys, column).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias(f"same_{column}"))

    total = findings.groupBy(*keys).agg(F.count("*").alias("findings"))
    before = Window.partitionBy(*keys).orderBy("line").rangeBetween(-(lines - 1), -1)
    near = findings.where("line is not null").groupBy(*keys, F.col("line").cast("long").alias("line")).agg(F.count("*").alias("n"))
    near = near.withColumn("m", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy(*keys).agg(F.sum(pairs(F.col("n")) + F.col("n") * F.col("m")).alias("near"))
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("evidence"), F.lit(r"(\w+)"))))
    sets = findings.select(*keys, words.alias("words")).where(F.size("words") > 0).groupBy(*keys, "words").agg(F.count("*").alias("n"))
    equal = sets.groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias("equal"))
    counted = sets.groupBy(*keys).agg(F.count("*").alias("kinds"))
    placed = sets.join(counted, keys)
    few = placed.where((F.col("kinds") > 1) & (F.col("kinds") <= FEW)).groupBy(*keys).agg(F.collect_list(F.struct("words", F.col("n").cast("double").alias("n"))).alias("s"))
    within = few.select(*keys, _weighted_likeness(F.col("s")).alias("alike"))
    each = placed.where(F.col("kinds") > FEW).select(*keys, F.to_json("words").alias("id"), F.size("words").alias("size"), "n", F.explode("words").alias("word"))
    other = each.select(*keys, F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("n").alias("n2"), "word")
    alike = each.join(other, [*keys, "word"]).where("id < id2").groupBy(*keys, "id", "id2").agg(F.count("*").alias("s"), F.max("size").alias("a"), F.max("size2").alias("b"), F.max(F.col("n") * F.col("n2")).alias("w"))
    alike = alike.groupBy(*keys).agg(F.sum(F.col("w") * F.col("s") / (F.col("a") + F.col("b") - F.col("s"))).alias("alike")).unionByName(within)
    rows = total
    for part in (same("file"), same("severity"), near, equal, alike):
        rows = rows.join(part, keys, "left")

    def of(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    mean = (0.3 * of("same_file") + 0.2 * of("near") + 0.1 * of("same_severity") + 0.4 * (of("equal") + of("alike"))) / pairs(F.col("findings"))
    return rows.select(*keys, "findings", F.when(F.col("findings") < 2, 0.0).otherwise(F.round(F.least(F.lit(1.0), mean), 6)).alias("similarity"))
