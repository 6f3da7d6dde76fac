"""Historical summaries and the live board."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from roadpulse.config import CHOICE_SIZES, CLOSURE_FLAG, CityConfig, DEFAULT_CITY
from roadpulse.functions import temporal
from roadpulse.operators import lookups
from roadpulse.operators.ranking import shuffle_key


def duration_by_cause(df: DataFrame) -> DataFrame:
    """Median impact per cause, longest first."""
    return lookups.median_duration_by_cause(df, "median_duration").orderBy(
        F.desc("median_duration"), "event_cause")


def closure_percent_by_cause(df: DataFrame) -> DataFrame:
    return (df.groupBy("event_cause").agg((F.avg(CLOSURE_FLAG) * 100).alias("closure_percent"))
            .orderBy(F.desc("closure_percent"), "event_cause"))


def events_by_hour(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    hour = temporal.local_hour(F.col("start_datetime"), city)
    return (df.where(F.col("start_datetime").isNotNull()).groupBy(hour.alias("hour"))
            .agg(F.count(F.lit(1)).alias("events")).orderBy("hour"))


def busiest_corridors(df: DataFrame, n: int = 12) -> DataFrame:
    return lookups.counts_by(df, "corridor").orderBy(F.desc("events"), "corridor").limit(n)


def busiest_stations(directory: DataFrame, n: int = 5) -> DataFrame:
    return directory.orderBy(F.desc("events_handled"), "police_station").limit(n)


def top_choices(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Most frequent values of each form field, listed alphabetically.

    One scan counts all fields at once. The per-field rank is limited, so Spark
    cuts candidates inside the map tasks.
    """
    sizes = sizes or CHOICE_SIZES
    counts = lookups.density_counts(df.select(*sizes), tuple(sizes)).where(F.col("value").isNotNull())
    rank = F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("events"), "value"))
    keep = reduce(lambda a, b: a | b, [
        (F.col("dimension") == c) & (F.col("_rn") <= n) for c, n in sizes.items()])
    return (counts.withColumn("_rn", rank).where(F.col("_rn") <= max(sizes.values())).where(keep)
            .select("dimension", "value").orderBy("dimension", "value"))


def hot_spots(df: DataFrame, size: int = 3000, seed: int = 1) -> DataFrame:
    """Seeded random sample of locations for a density map."""
    return (df.withColumn("_h", shuffle_key(F.col("id"), seed)).orderBy("_h", "id").limit(size)
            .select("id", "latitude", "longitude"))


def active_orders(orders: DataFrame, active: DataFrame) -> DataFrame:
    """Orders whose event still affects traffic."""
    return orders.join(active.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def active_with_severity(active: DataFrame, orders: DataFrame) -> DataFrame:
    """Active events with their order's band and score, or the monitoring defaults."""
    side = orders.select(F.col("event_id").alias("id"), "severity_band", "impact_score")
    return active.join(side, "id", "left").select(
        *[active[c] for c in active.columns],
        F.coalesce("severity_band", F.lit("Monitoring")).alias("severity"),
        F.coalesce("impact_score", F.lit(20.0)).alias("score"))


def newest_orders(orders: DataFrame, n: int = 4) -> DataFrame:
    return orders.orderBy(F.desc("issued_at_ist"), F.desc("order_id")).limit(n)


def live_kpis(active: DataFrame, congestion: DataFrame, orders: DataFrame) -> DataFrame:
    """Active events, affected and congested corridors, orders, officers deployed: one row."""
    parts = [
        active.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("corridor").alias("m")).select(
            F.explode(F.array(
                F.struct(F.lit("active_events").alias("k"), F.col("n").alias("v")),
                F.struct(F.lit("affected_corridors").alias("k"), F.col("m").alias("v")))).alias("_x")
        ).select("_x.*"),
        congestion.agg(F.count_if(F.col("status") != "Light").alias("v")).select(
            F.lit("congested_corridors").alias("k"), "v"),
        orders.agg(F.count(F.lit(1)).alias("v")).select(F.lit("orders").alias("k"), "v"),
        active_orders(orders, active).agg(
            F.coalesce(F.sum(F.col("manpower").cast("bigint")), F.lit(0)).alias("v")).select(
            F.lit("officers_deployed").alias("k"), "v"),
    ]
    names = ("active_events", "affected_corridors", "congested_corridors", "orders", "officers_deployed")
    return reduce(DataFrame.unionByName, parts).agg(*[
        F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])
