"""Exact grouped medians that never hold a group in one task's memory.

All columns and groups share two scans of the rows (see ``selection``): quantile sketches
bracket the middle ranks, exact counts inside the brackets find them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadpulse.operators.selection import ranked_values, same_keys


def medians_by(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per group with exact interpolated medians; null and NaN are no values.

    ``columns`` maps an output name to an input column. A group without values keeps a row
    with a null median.
    """
    stacked = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns.values())])))
    middle = F.array(F.expr("(_all + 1) div 2"), F.expr("(_all + 2) div 2"))
    groups, picked = ranked_values(stacked, [*keys, "_m"], F.col("_x"), F.col("_x"), [0.5], middle)
    outputs = [(F.sum(F.when(F.col("_m") == i, F.col("value"))) / F.lit(2.0)).alias(n) for i, n in enumerate(columns)]
    found = picked.groupBy(*keys).agg(*outputs)
    if not keys:
        return found
    found = found.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return groups.select(*keys).distinct().join(found, same_keys([(k, f"_r_{k}") for k in keys]), "left").drop(*[f"_r_{k}" for k in keys])
