"""The live feed as tables: lifetimes, arrivals, the active set, clock ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY
from roadpulse.functions import numeric, temporal
from roadpulse.operators.lookups import lookup, median_duration_by_cause
from roadpulse.session import settle


def started(df: DataFrame) -> DataFrame:
    return df.where(F.col("start_datetime").isNotNull())


def cause_priors(df: DataFrame) -> DataFrame:
    """Median duration per cause over events on the feed, settled for reuse."""
    return settle(median_duration_by_cause(started(df)), "cause-median")


def add_lifetime(df: DataFrame, priors: DataFrame, city: CityConfig = DEFAULT_CITY,
                 known: Column | None = None) -> DataFrame:
    """Minutes on the feed and the instant an event leaves it.

    ``known`` is the best duration at hand (default: the recorded one; live, the
    forecast); then the cause's median; then the city's default.
    """
    known = F.col("duration_min") if known is None else known
    df = lookup(started(df), priors, "event_cause", "median_duration", "_prior")
    minutes = numeric.clip(F.coalesce(known, F.col("_prior"), F.lit(city.default_lifetime)),
                           *city.lifetime_range)
    return df.withColumn("sim_duration_min", minutes).withColumn(
        "sim_end", temporal.add_minutes(F.col("start_datetime"), F.col("sim_duration_min"))).drop("_prior")


def new_between(feed: DataFrame, since, until) -> DataFrame:
    """Events reported in (since, until]."""
    start = F.col("start_datetime")
    return feed.where((start > F.lit(since)) & (start <= F.lit(until)))


def may_be_active(instant, city: CityConfig = DEFAULT_CITY) -> Column:
    """Starts that can still be on the feed at an instant: lifetimes are capped.

    A plain bound on the start column, so it reaches the scan.
    """
    start, at = F.col("start_datetime"), F.lit(instant)
    return (start <= at) & (start > temporal.add_minutes(at, F.lit(-float(city.lifetime_range[1]))))


def active_at(feed: DataFrame, instant, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Events affecting traffic at an instant: started, not yet over."""
    return feed.where(may_be_active(instant, city) & (F.col("sim_end") > F.lit(instant)))


def with_arrival_tick(feed: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Tick at which a control room first sees the event."""
    return feed.withColumn("tick_no", temporal.tick_after(F.col("start_datetime"), city.tick_minutes))


def active_ticks(feed: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """One row per event and tick at which it is active.

    Lifetimes are capped, so an event spans a fixed number of ticks at most. This
    turns the interval join "events x instants" into a narrow explode followed by
    an ordinary hash aggregation.
    """
    first = temporal.tick_after(F.col("start_datetime"), city.tick_minutes)
    last = temporal.last_tick_before(F.col("sim_end"), city.tick_minutes)
    return (feed.withColumns({"_first": first, "_last": last})
            .where(F.col("_last") >= F.col("_first"))
            .withColumn("tick_no", F.explode(F.sequence("_first", "_last")))
            .drop("_first", "_last"))


def with_tick_instant(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    return df.withColumn("tick", temporal.tick_instant(F.col("tick_no"), city.tick_minutes))


def newest_per_tick(new: DataFrame, limit: int | None, issued: DataFrame | None = None) -> DataFrame:
    """The newest ``limit`` arrivals of each tick; ``None`` keeps all of them.

    ``row_number`` under a constant limit is cut inside each map task before the
    shuffle, so a busy tick never gathers in one task. ``issued`` (tick_no, orders)
    holds what earlier batches gave out; only the rest of a tick's limit is left then.
    """
    if limit is None:
        return new
    latest = W.partitionBy("tick_no").orderBy(F.desc("start_datetime"), F.desc("id"))
    kept = new.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= limit)
    if issued is not None:
        kept = kept.join(issued.select("tick_no", F.col("orders").alias("_given")), "tick_no", "left").where(
            F.col("_rn") <= limit - F.coalesce("_given", F.lit(0))).drop("_given")
    return kept.drop("_rn")


def without_issued(new: DataFrame, orders: DataFrame) -> DataFrame:
    """Drop events that already have an order."""
    return new.join(orders.select(F.col("event_id").alias("id")), "id", "left_anti")


def events_per_day(feed: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    day = temporal.local_date(F.col("start_datetime"), city)
    return started(feed).groupBy(day.alias("date")).agg(F.count(F.lit(1)).alias("events"))


def busiest_days(feed: DataFrame, n: int = 10, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """The ``n`` local dates with most reports, in date order."""
    return events_per_day(feed, city).orderBy(F.desc("events"), "date").limit(n).orderBy("date")


def busiest_day(feed: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """The top date (earliest on a tie) and the start of its morning shift."""
    top = events_per_day(feed, city).agg(
        F.max(F.struct("events", (-F.unix_date("date")).alias("early"), "date")).alias("top"))
    return top.select(F.col("top.date").alias("date"), F.col("top.events").alias("events"),
                      temporal.shift_start(F.col("top.date"), 7, city).alias("day_start"))
