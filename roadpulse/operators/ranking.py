"""Running totals over a whole table without a single-partition window.

A running total over a whole table in sorted order normally needs one task. Here
the order is split into buckets (a coarse, monotone function of the sort key).
Totals per bucket are tiny, their prefix sums are joined back as offsets, and the
exact window runs inside each bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadpulse.operators.selection import same_keys


def running_totals(df: DataFrame, keys: list[str], buckets: list[str], order: list,
                   totals: dict[str, Column]) -> DataFrame:
    """Add inclusive running totals in the order (``buckets``, ``order``) per ``keys``.

    ``buckets`` are columns from coarse to fine; each one splits its parent into a
    bounded number of buckets. ``totals`` maps output columns to summed columns;
    ``<output>_all`` receives the total of the whole group.
    """
    rows = df.withColumns({f"_s_{n}": c for n, c in totals.items()})
    offsets = None
    for depth in range(1, len(buckets) + 1):
        on = keys + buckets[:depth]
        level = rows.groupBy(*on).agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in totals])
        siblings = W.partitionBy(*keys, *buckets[:depth - 1])
        before = siblings.orderBy(buckets[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        level = level.withColumns({
            f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in totals})
        if depth == 1:
            level = level.withColumns({f"_g_{n}": F.sum(f"_t_{n}").over(siblings) for n in totals})
        level = level.drop(*[f"_t_{n}" for n in totals])
        if offsets is not None:
            parent = offsets.withColumnsRenamed({f"_o_{n}": f"_p_{n}" for n in totals})
            level = _match(level, parent, keys + buckets[:depth - 1]).withColumns(
                {f"_o_{n}": F.col(f"_o_{n}") + F.col(f"_p_{n}") for n in totals}
            ).drop(*[f"_p_{n}" for n in totals])
        offsets = level
    inside = (W.partitionBy(*keys, *buckets).orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = rows.withColumns({n: F.sum(f"_s_{n}").over(inside) for n in totals})
    ranked = _match(ranked, offsets, keys + buckets)
    ranked = ranked.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in totals}).withColumnsRenamed(
        {f"_g_{n}": f"{n}_all" for n in totals})
    return ranked.drop(*[f"_{p}_{n}" for p in ("s", "o") for n in totals])


def _match(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in on})
    return left.join(renamed, same_keys([(k, f"_k_{k}") for k in on])).drop(*[f"_k_{k}" for k in on])


def shuffle_key(key: Column, seed) -> Column:
    """Reproducible pseudo-random sort key: the same in every engine with md5."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))
