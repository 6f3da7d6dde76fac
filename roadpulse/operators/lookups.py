"""Historical counts and priors, and the joins that bring them to rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY, CLOSURE_FLAG
from roadpulse.operators.medians import medians_by

DENSITY_KEYS = ("corridor", "junction", "zone", "cluster_id")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, out: str, default=None) -> DataFrame:
    """Left lookup of one column; a miss gives ``default``.

    ``table`` should be settled: then the optimizer knows its true size and decides
    between broadcasting it and a skew-split sort-merge join.
    """
    side = table.select(F.col(key).alias("_lk"), F.col(value).alias("_lv"))
    joined = df.join(side, F.col(key) == F.col("_lk"), "left")
    found = F.col("_lv") if default is None else F.coalesce(F.col("_lv"), F.lit(default))
    return joined.withColumn(out, found).drop("_lk", "_lv")


def counts_by(df: DataFrame, key: str, out: str = "events") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def density_counts(df: DataFrame, keys: tuple[str, ...] = DENSITY_KEYS) -> DataFrame:
    """Rows per value of each key column as one long table, from a single scan."""
    present = [k for k in keys if k in df.columns]
    return (df.select(F.explode(F.array(*[
                F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value"))
                for k in present])).alias("_d"))
            .groupBy("_d.dimension", "_d.value").agg(F.count(F.lit(1)).alias("events")))


def add_densities(df: DataFrame, table: DataFrame, keys: tuple[str, ...] = DENSITY_KEYS) -> DataFrame:
    """Join the long count table once per key column; unseen values count 0."""
    names = {"cluster_id": "cluster_density"}
    for key in keys:
        if key in df.columns:
            part = table.where(F.col("dimension") == key).select(
                F.col("value").alias(key), "events")
            df = lookup(df, part, key, "events", names.get(key, f"{key}_density"), 0)
    return df


def median_duration_by_cause(df: DataFrame, out: str = "median_duration", **options) -> DataFrame:
    known = df.where(F.col("duration_min").isNotNull()).select("event_cause", "duration_min")
    return medians_by(known, ["event_cause"], {out: "duration_min"}, **options)


def overall_median_duration(df: DataFrame, out: str = "overall_median_duration", **options) -> DataFrame:
    known = df.where(F.col("duration_min").isNotNull()).select("duration_min")
    return medians_by(known, [], {out: "duration_min"}, **options)


def closure_rate_by_cause(df: DataFrame, out: str = "closure_rate") -> DataFrame:
    return df.groupBy("event_cause").agg(F.avg(CLOSURE_FLAG).alias(out))


def reference_tables(df: DataFrame, city: CityConfig = DEFAULT_CITY,
                     thresholds: dict[str, float] | None = None) -> DataFrame:
    """All priors in one long table ``(kind, key, value)``."""
    parts = [
        median_duration_by_cause(df).select(
            F.lit("median_duration_by_cause").alias("kind"), F.col("event_cause").alias("key"),
            F.bround("median_duration", 1).alias("value")),
        closure_rate_by_cause(df).select(
            F.lit("closure_rate_by_cause").alias("kind"), F.col("event_cause").alias("key"),
            F.bround("closure_rate", 3).alias("value")),
        counts_by(df, "corridor").select(
            F.lit("corridor_event_counts").alias("kind"), F.col("corridor").alias("key"),
            F.col("events").cast("double").alias("value")),
        overall_median_duration(df).select(
            F.lit("overall_median_duration").alias("kind"), F.lit("all").alias("key"),
            F.col("overall_median_duration").alias("value")),
    ]
    limits = {"closure": city.default_threshold, **(thresholds or {})}
    parts.append(df.sparkSession.createDataFrame(
        [("thresholds", k, float(v)) for k, v in sorted(limits.items())], parts[0].schema))
    return reduce(DataFrame.unionByName, parts)


def threshold(tables: DataFrame, name: str, city: CityConfig = DEFAULT_CITY) -> float:
    """One operating threshold out of the priors; the default where it is absent."""
    row = tables.where((F.col("kind") == "thresholds") & (F.col("key") == name)).select("value").first()
    return float(row["value"]) if row else city.default_threshold
