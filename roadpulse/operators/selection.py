"""Pick the rows at given ranks of a sorted table without sorting it, in two scans.

The first scan gathers a quantile sketch per group; its quantiles a little below and above
each wanted share bracket the wanted rank. The second scan counts exactly: rows outside the
brackets collapse into one count per gap, rows inside (about a hundredth of the table) into
one per distinct value (one shuffle, read twice). What follows works on those counts alone, and its windows run over
the cells of one group or the values of one cell. All groups take part at once, and a group
or value that holds a third of all rows is no harder: both scans combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadpulse.session import settle

SKETCH = 4096     # sketch size: ranks to about 0.0013 of the group; smaller groups are counted whole
MARGIN = 0.006    # half width of a bracket, more than four times that error
CELLS = 1000      # parts of a bracket in which values are ordered apart


def same_keys(pairs) -> Column:
    """Join condition that treats nulls as equal."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def bracket(df: DataFrame, keys: list[str], shares: list[float], ranks: Column) -> DataFrame:
    """Per group its row count ``_all``, the wanted ``_ranks`` and brackets ``_lo``, ``_hi`` of ``_k``."""
    kind = "bigint" if df.schema["_k"].dataType.simpleString() == "bigint" else "double"
    grid = [end for s in shares for end in (max(s - MARGIN, 0.0), min(s + MARGIN, 1.0))]
    groups = df.groupBy(*keys).agg(getattr(F, f"kll_sketch_agg_{kind}")("_k", F.lit(SKETCH)).alias("_s"),
                                   F.min("_k").alias("_min"), F.max("_k").alias("_max"), F.count("_k").alias("_all"))
    ends = getattr(F, f"kll_sketch_get_quantile_{kind}")(F.col("_s"), F.array(*map(F.lit, grid)))
    groups = groups.withColumn("_e", F.when(F.col("_all") > SKETCH, ends))   # small groups: one bracket around all

    def side(first: int, whole: str) -> Column:
        return F.when(F.col("_e").isNull(), F.array(whole)).otherwise(F.array(*[F.col("_e")[i] for i in range(first, len(grid), 2)]))

    # A sketch draws at random: settled, so that a task that runs again meets the same brackets.
    return settle(groups.select(*keys, "_all", ranks.alias("_ranks"), side(0, "_min").alias("_lo"), side(1, "_max").alias("_hi")), "brackets")


def with_group(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a group's row; a table without keys has one, whose values become constants."""
    if keys:
        side = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
        return df.join(side, same_keys([(k, f"_g_{k}") for k in keys])).drop(*[f"_g_{k}" for k in keys])
    row = groups.first()
    if row is None:
        return df.where("false").withColumns({f.name: F.lit(None).cast(f.dataType) for f in groups.schema})
    return df.withColumns({f.name: (F.array(*map(F.lit, row[f.name])) if isinstance(row[f.name], list) else F.lit(row[f.name])).cast(f.dataType)
                           for f in groups.schema})


def ranked_values(df: DataFrame, keys: list[str], order: Column, value: Column, shares: list[float],
                  ranks: Column) -> tuple[DataFrame, DataFrame]:
    """The values at ``ranks`` of the order (``order``, ``value``), per group.

    ``order`` is a bigint or double that never falls as ``value`` grows; rows without one
    (null, NaN) do not count. ``ranks`` is an array of 1-based ranks and may use ``_all``, the
    group's row count; the ranks lie within one row of ``shares`` of it. Returns the groups (all
    of them, ``_all`` may be 0) and rows of ``keys``, ``i`` (index in ``ranks``), ``value``.
    """
    rows = df.select(*keys, F.when(~F.isnan(order.cast("double")), order).alias("_k"), value.alias("_v"))
    groups = bracket(rows, keys, shares, ranks)
    placed = with_group(rows.where(F.col("_k").isNotNull()), groups, keys)
    gap = F.size(F.filter("_lo", lambda lo: lo <= F.col("_k")))
    low, high = (F.element_at(c, F.greatest(gap, F.lit(1))) for c in ("_lo", "_hi"))
    inside = (gap > 0) & (F.col("_k") <= high)
    width = F.nullif(high.cast("double") - low.cast("double"), F.lit(0.0))
    cell = F.floor(F.coalesce((F.col("_k").cast("double") - low.cast("double")) / width, F.lit(0.0)) * CELLS)
    counts = placed.select(*keys, gap.alias("_gap"), F.when(inside, cell).otherwise(CELLS + 1).alias("_cell"),
                                  F.when(inside, F.col("_k")).alias("_k"), F.when(inside, F.col("_v")).alias("_v")).groupBy(
        *keys, "_gap", "_cell", "_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_gap", "_cell").rowsBetween(W.unboundedPreceding, W.currentRow))
    cells = counts.groupBy(*keys, "_gap", "_cell").agg(F.sum("_n").alias("_n")).withColumn("_before", upto - F.col("_n"))
    cells = with_group(cells, groups.select(*keys, "_ranks"), keys)
    wanted = F.filter(F.transform("_ranks", lambda r, i: F.struct(i.alias("i"), r.cast("bigint").alias("r"))),
                      lambda w: (w["r"] > F.col("_before")) & (w["r"] <= F.col("_before") + F.col("_n")))
    cells = cells.select(*keys, "_gap", F.when((F.size(wanted) > 0) & (F.col("_cell") > CELLS), F.raise_error(
        F.lit("a sketch missed its bracket"))).otherwise(F.col("_cell")).alias("_cell"), "_before", wanted.alias("_wanted")).where(F.size("_wanted") > 0)
    on = [*keys, "_gap", "_cell"]
    near = cells.withColumnsRenamed({k: f"_t_{k}" for k in on})
    ordered = counts.join(near, same_keys([(k, f"_t_{k}") for k in on])).withColumn("_upto", F.col("_before") + F.sum("_n").over(
        W.partitionBy(*on).orderBy("_k", "_v").rowsBetween(W.unboundedPreceding, W.currentRow)))
    picked = ordered.withColumn("_w", F.explode("_wanted")).where(
        (F.col("_w.r") <= F.col("_upto")) & (F.col("_w.r") > F.col("_upto") - F.col("_n")))
    return groups, picked.select(*keys, F.col("_w.i").alias("i"), F.col("_v").alias("value"))
