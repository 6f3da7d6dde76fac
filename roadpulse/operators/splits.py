"""Validation folds and hold-out splits as columns.

Rows are put into a seeded hash order (or time order). Only the cut points of that
order are searched for; every row then compares its own sort key with them, so the
wide rows are neither shuffled nor sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roadpulse.operators.ranking import running_totals, shuffle_key
from roadpulse.operators.selection import ranked_values
from roadpulse.session import settle


def _order(key: str, seed) -> Column:
    """The row's place in a seeded order; rows without a key share one."""
    return shuffle_key(F.coalesce(F.col(key).cast("string"), F.lit("")), seed)


def _number(hashed: str, digits: int) -> Column:
    """The first hexadecimal digits as a number in the same order."""
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("bigint")


def _cuts(df: DataFrame, keys: list[str], order: Column, value: Column, shares: list[float], ranks: Column) -> DataFrame:
    """Per group the sort keys found at ``ranks``, as one array in rank order."""
    _, found = ranked_values(df, keys, order, value, shares, ranks)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda c: c["value"])
    return found.groupBy(*keys).agg(listed.alias("_cuts"))


def _attach(df: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Bring the cut points (one row per class) to the rows."""
    if keys:
        side = cuts.withColumnRenamed(keys[0], "_ck")
        return df.join(side, F.col(keys[0]).eqNullSafe(F.col("_ck")), "left").drop("_ck")
    row = cuts.first()
    values = row["_cuts"] if row else []
    kind = cuts.schema["_cuts"].dataType.simpleString()
    return df.withColumn("_cuts", F.array(*[F.lit(v) for v in values]).cast(kind))


def _part_cuts(parts: int) -> Column:
    """Last ranks of all but the final part when rows are dealt as NTILE deals them."""
    small = F.floor(F.col("_all") / F.lit(parts)).cast("bigint")
    extra = F.col("_all") - small * F.lit(parts)
    return F.array(*[F.lit(j) * small + F.least(F.lit(j).cast("bigint"), extra) for j in range(1, parts)])


def random_folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "id",
                 stratify: str | None = None) -> DataFrame:
    """Seeded folds 1..k of equal size (within each class if stratified), by one plan at every size.

    Copies of one key always share a fold, and so do rows without a key; a key with more
    rows than a fold makes its fold larger and others smaller.
    """
    keys = [stratify] if stratify else []
    hashed = df.withColumn("_h", _order(key, seed))
    cuts = _cuts(hashed.select(*keys, "_h"), keys, _number("_h", 15), F.col("_h"), [j / k for j in range(1, k)], _part_cuts(k))
    return _attach(hashed, cuts, keys).withColumn(
        "fold", F.size(F.filter("_cuts", lambda c: F.col("_h") > c)) + F.lit(1)).drop("_h", "_cuts")


def holdout_split(df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "id",
                  stratify: str = "requires_road_closure") -> DataFrame:
    """``part`` = test for a seeded share of every class (rounded up), else train."""
    hashed = df.withColumn("_h", _order(key, seed))
    cuts = _cuts(hashed.select(stratify, "_h"), [stratify], _number("_h", 15), F.col("_h"), [share],
                 F.array(F.ceil(F.col("_all") * F.lit(share)).cast("bigint")))
    inside = F.coalesce(F.col("_h") <= F.try_element_at("_cuts", F.lit(1)), F.lit(False))
    return _attach(hashed, cuts, [stratify]).withColumn(
        "part", F.when(inside, "test").otherwise("train")).drop("_h", "_cuts")


def temporal_split(df: DataFrame, fraction: float = 0.8, key: str = "id") -> DataFrame:
    """``part`` = train for the earliest share of rows, test for the rest.

    Rows without a start count as the latest; equal starts are ordered by key hash.
    """
    far = F.lit(2 ** 62)
    keyed = df.withColumns({
        "_u": F.coalesce(F.unix_micros("start_datetime"), far), "_h": _order(key, "time")})
    # Starts as far as 51 bits of microseconds reach (the year 2041), then three digits of the hash: equal starts spread.
    order = F.greatest(F.least(F.col("_u"), F.lit(2 ** 51 - 1)), F.lit(-2 ** 51)) * F.lit(4096) + _number("_h", 3)
    cuts = _cuts(keyed.select("_u", "_h"), [], order, F.struct("_u", "_h"), [fraction],
                 F.array(F.floor(F.col("_all") * F.lit(fraction)).cast("bigint")))
    row = cuts.first()
    if row is None or not row["_cuts"]:
        return keyed.withColumn("part", F.lit("test")).drop("_u", "_h")
    at = row["_cuts"][0]
    early = (F.col("_u") < at["_u"]) | ((F.col("_u") == at["_u"]) & (F.col("_h") <= at["_h"]))
    return keyed.withColumn("part", F.when(early, "train").otherwise("test")).drop("_u", "_h")


def group_folds(df: DataFrame, group: str = "cluster_id", k: int = 5) -> DataFrame:
    """Whole groups per fold, for any number of groups; a null group is a group.

    Groups too large for an even share of what is left get a fold to themselves (fewer than
    ``k`` can be that large). The others go round the remaining folds there and back by
    falling size, so the loads of those folds differ by the largest of them at most. A
    group's place in that order is a running total over buckets of sizes and hashes: no task
    and no driver holds the list of groups.
    """
    sizes = settle(df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_h", _order("_g", "group")), "groups")
    left = sizes.agg(F.sum("_n")).first()[0] or 0
    alone = 0
    for row in sizes.orderBy(F.desc("_n"), "_h").limit(k - 1).collect():   # at most k - 1 rows
        if row["_n"] * (k - alone) <= left:
            break
        alone, left = alone + 1, left - row["_n"]
    ordered = sizes.withColumns({"_class": -F.floor(F.log2("_n")), "_small": -F.col("_n"), "_prefix": F.substring("_h", 1, 4)})
    ranked = running_totals(ordered, [], ["_class", "_small", "_prefix"], ["_h", F.col("_g").isNull()], {"_rank": F.lit(1)})
    folds = k - alone
    place = F.pmod(F.col("_rank") - F.lit(1 + alone), F.lit(2 * folds))
    fold = F.when(F.col("_rank") <= alone, F.col("_rank")).otherwise(
        F.lit(alone + 1) + F.when(place < folds, place).otherwise(F.lit(2 * folds - 1) - place))
    dealt = ranked.select("_g", fold.cast("int").alias("fold"))
    return df.join(dealt, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
