"""Pairs of similar sets without meeting all that share an item.

Items are ordered by how many sets hold them, rare ones first. Two sets that must share o items share any k of these (k up to o) among the first n - o + k of
each, so sets of few items meet at combinations of up to three of their first items, of which there are many more than items, and a pair is
looked at where the combination is of its first common items. Pairs with a larger set meet at single items of these prefixes. What sizes and positions
rule out is passed over. Combinations and items that very many sets hold are dealt in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.runs import shared_path

#: Sets that meet at one item or combination in one task.
MOST = 4096
#: Items that are ordered by how many sets hold them; all others are rarer and go by themselves.
FREQUENT = 100_000
#: Items of a combination, items of a set that meets at combinations, and its combinations, each at most.
DEPTH, SMALL, KEYS = 3, 16, 128

#: The number of common items that sets of two sizes need, in numbers or columns.
Bound = Callable[[object, object, Callable], object]


def ordered(sets: DataFrame) -> DataFrame:
    """id, tokens (rare items first), n of sets(id, items) that are not empty."""
    each = sets.select("id", F.explode(F.array_distinct("items")).alias("item")).where("id is not null and item is not null")
    counts = each.groupBy("item").agg(F.count("*").alias("holders")).orderBy(F.desc("holders"), "item").limit(FREQUENT)
    told = each.join(F.broadcast(counts), "item", "left").select("id", F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "item").alias("x"))
    tokens = told.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("tokens"))
    return tokens.select("id", "tokens", F.size("tokens").alias("n"))


def _at_items(tokens: DataFrame, least: float) -> DataFrame:
    needed = F.greatest(F.ceil(F.col("n") * least - 1e-9).cast("int"), F.lit(1))
    return tokens.select("id", "tokens", "n", F.posexplode(F.slice("tokens", F.lit(1), F.col("n") - needed + 1)).alias("at", "item"))


def prefixes(sets: DataFrame, least: float) -> DataFrame:
    """id, tokens (rare items first), n, at (from 0), item: the items of sets(id, items) at which a set may meet others that share the bound with it."""
    return _at_items(ordered(sets), least)


def _needed(n: int, m: int, least: float, bound: Bound) -> int:
    return max(1, ceil(bound(n, m, max) - 1e-9))


def _spots(size: int, most: int, least: float, bound: Bound) -> list[tuple[int, ...]]:
    """Positions, from 1, of the items at which a set of a size meets others of up to most items."""
    low: dict[int, int] = {}
    for m in range(1, most + 1):
        if min(size, m) >= max(size, m) * least - 1e-9:
            o = _needed(size, m, least, bound)
            if o <= min(size, m):
                low[min(o, DEPTH)] = min(o, low.get(min(o, DEPTH), o))
    return [c for k, o in sorted(low.items()) for c in combinations(range(1, size - o + k + 1), k)]


def _small(least: float, bound: Bound) -> int:
    """The largest size up to which all sets have few combinations."""
    most = SMALL
    while most and any(len(_spots(n, most, least, bound)) > KEYS for n in range(1, most + 1)):
        most -= 1
    return most


def _met(heads: DataFrame, key: str, most: int, like: Column) -> list[DataFrame]:
    """Pairs of rows of heads, as a and b, that have a key in common: keys of up to most rows as they are, the others in blocks."""
    held = heads.groupBy(key).agg(F.count("*").alias("held")).where(F.col("held") > most)
    rare = heads.join(held, key, "left_anti")
    rows = heads.join(held, key).withColumn("blocks", F.ceil(F.col("held") / most).cast("int")).drop("held")
    a = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    b = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    same = F.col(f"a.{key}") == F.col(f"b.{key}")
    return [rare.alias("a").join(rare.alias("b"), same & like), a.alias("a").join(b.alias("b"), same & (F.col("a.block") == F.col("b.block")) & like)]


def _pairs(sets: DataFrame, least: float, bound: Bound, score: Callable[[Column, Column, Column], Column], name: str, most: int) -> DataFrame:
    """a, b and the score, of at least so much, of pairs by sizes and common items; bound gives the number of these that a pair needs, from both sizes.

    Ordered sets are written to the shared folder, as they are read several times.
    """
    spark, few, path = sets.sparkSession, _small(least, bound), shared_path(sets.sparkSession, "sets")
    ordered(sets).write.parquet(path)
    # Nulls, of which there are none, are ruled out here, so that both sides of a join are the same rows and share a shuffle.
    tokens = spark.read.parquet(path).where("id is not null and tokens is not null and n is not null")
    largest = tokens.agg(F.max("n")).first()[0] or 0
    n, m = F.col("a.n"), F.col("b.n")
    need = bound(n, m, F.greatest)
    sizes = (F.col("a.id") < F.col("b.id")) & (F.least(n, m) >= F.greatest(n, m) * least - 1e-9)
    parts = []

    def scored(met: DataFrame, first: Column) -> DataFrame:
        """Common items are told once for each row: what is asked of an expression alone would be told in the join, for each place that names it."""
        told = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), n.alias("n"), m.alias("m"), first.alias("first"), F.explode(F.array(F.array_intersect("a.tokens", "b.tokens"))).alias("both"))
        share = score(F.col("n"), F.col("m"), F.size("both"))
        return told.where((F.get("both", F.col("first.depth") - 1) == F.col("first.item")) & (share >= least)).select("a", "b", share.alias(name))

    spots = [(size, sum(p << 5 * j for j, p in enumerate(c)), len(c)) for size in range(1, min(few, largest) + 1) for c in _spots(size, few, least, bound)]
    if spots:
        def spot(side: str, j: int) -> Column:
            return F.shiftright(f"{side}code", 5 * j).bitwiseAND(31)

        def item(side: str, j: int) -> Column:
            return F.get(f"{side}tokens", spot(side, j) - 1)

        table = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, spots))} AS t(n, code, depth)")
        heads = tokens.join(F.broadcast(table), "n").select("id", "tokens", "n", "code", F.xxhash64("depth", *[item("", j) for j in range(DEPTH)]).alias("key"))
        depth = {s: F.when(spot(s, 2) > 0, 3).when(spot(s, 1) > 0, 2).otherwise(1) for s in ("a.", "b.")}
        last = {s: F.greatest(*[spot(s, j) for j in range(DEPTH)]) for s in ("a.", "b.")}
        asked = F.greatest(F.lit(1), F.ceil(need - 1e-9))
        deep = F.least(asked, F.lit(DEPTH))
        fits = (depth["a."] == deep) & (depth["b."] == deep) & (F.least(n - last["a."], m - last["b."]) >= asked - deep)
        # Equal in two comparisons, as an equation would become a key of the join and another shuffle.
        same = reduce(Column.__and__, [F.coalesce((item("a.", j) <= item("b.", j)) & (item("a.", j) >= item("b.", j)), F.lit(True)) for j in range(DEPTH)])
        first = F.struct(depth["a."].alias("depth"), F.get("a.tokens", last["a."] - 1).alias("item"))
        parts += [scored(met, first) for met in _met(heads, "key", most, sizes & fits & same)]
    if largest > few or not parts:
        at = _at_items(tokens.where(F.col("n") >= (few + 1) * least - 1e-9), least)
        like = sizes & (F.greatest(n, m) > few) & (F.least(n - F.col("a.at"), m - F.col("b.at")) >= need - 1e-9)
        first = F.struct(F.lit(1).alias("depth"), F.col("a.item").alias("item"))
        parts += [scored(met, first) for met in _met(at, "item", most, like)]
    return reduce(DataFrame.unionByName, parts)


def by_larger(sets: DataFrame, least: float, most: int = MOST) -> DataFrame:
    """a, b (a < b), share: pairs of sets(id, items) by the number of common items over the size of the larger set, at least so much. Empty sets are in no pair."""
    return _pairs(sets, least, lambda n, m, larger: larger(n, m) * least, lambda n, m, shared: shared / F.greatest(n, m), "share", most)


def by_jaccard(sets: DataFrame, least: float, most: int = MOST) -> DataFrame:
    """a, b (a < b), jaccard of at least so much, for sets(id, items). Empty sets are in no pair."""
    return _pairs(sets, least, lambda n, m, _: (n + m) * (least / (1 + least)), lambda n, m, shared: shared / (n + m - shared), "jaccard", most)
