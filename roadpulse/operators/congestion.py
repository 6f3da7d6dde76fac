"""Corridor congestion for one instant or for every clock tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from roadpulse.config import CLOSURE_FLAG, CityConfig, DEFAULT_CITY
from roadpulse.functions import scoring
from roadpulse.operators import feed as feed_ops


def corridor_congestion(active: DataFrame, *by: str, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Weighted load, status, active events and closures per corridor (and ``by``)."""
    weight = scoring.congestion_weight(
        F.col(CLOSURE_FLAG), F.col("is_peak"), F.col("corridor"), city)
    return (active.groupBy(*by, "corridor")
            .agg(F.bround(F.sum(weight), 2).alias("congestion_index"),
                 F.count(F.lit(1)).alias("active_events"),
                 F.sum(F.col(CLOSURE_FLAG).cast("bigint")).alias("closures"))
            .withColumn("status", scoring.congestion_status(F.col("congestion_index")))
            .select(*by, "corridor", "congestion_index", "status", "active_events", "closures"))


def congestion_at(feed: DataFrame, instant, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Congestion table at one instant, worst corridor first."""
    return corridor_congestion(feed_ops.active_at(feed, instant), city=city).orderBy(
        F.desc("congestion_index"), "corridor")


def congestion_per_tick(feed: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Congestion at every tick. Only four columns travel past the explode, and the
    aggregation combines map-side before its one shuffle."""
    narrow = feed.select("start_datetime", "sim_end", "corridor", CLOSURE_FLAG, "is_peak")
    return feed_ops.with_tick_instant(
        corridor_congestion(feed_ops.active_ticks(narrow, city), "tick_no", city=city), city)


def at_or_above(congestion: DataFrame, min_status: str = "Moderate") -> DataFrame:
    worst = scoring.status_rank(F.lit(min_status))
    return congestion.where(scoring.status_rank(F.col("status")) <= worst)


def congested_count(congestion: DataFrame) -> DataFrame:
    return congestion.agg(F.count_if(F.col("status") != "Light").alias("congested_corridors"))
