"""Streaming jobs run to completion over files derived from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from roadpulse.operators import feed, features
from roadpulse.operators.recommend import recommend
from roadpulse.plans import oracle as o
from roadpulse.plans.base import raw_incidents, stamp
from roadpulse.plans.registry import query
from roadpulse.session import scratch_path, settle
from roadpulse.sources import fixture, incidents as source
from roadpulse.streaming import jobs
from roadpulse.streaming.refresh import PriorStore

DELIVERIES = 3


def history_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The incident table and its engineered form: what is known before the stream starts."""
    raw = settle(raw_incidents(spark, sf_dir), "history")
    return raw, features.engineer(raw)


def open_folder(spark: SparkSession, schema: T.StructType, path: str) -> None:
    """A stream's folder must exist before its first delivery."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)


def feed_stream(history: DataFrame, path: str) -> DataFrame:
    open_folder(history.sparkSession, history.schema, path)
    raw = source.read_stream(history.sparkSession, path, schema=history.schema)
    return jobs.engineered_stream(raw, features.CoordinateMedians.fit(history))


def replay(history: DataFrame, path: str, *start, deliveries: int = DELIVERIES, held: Column | None = None) -> None:
    """Deliver the incidents in time order and let the queries catch up each time.

    Every third event is delivered twice; events that meet ``held`` come one delivery late.
    A query restarts from its checkpoint for each delivery, which makes one micro-batch of
    however many files it has.
    """
    due = F.coalesce(F.floor((F.dayofmonth("start_datetime") - 1) * deliveries / F.lit(31)), F.lit(0))
    if held is not None:
        due = due + F.when(held, 1).otherwise(0)
    for part in range(deliveries + (held is not None)):
        share = history.where(due == part)
        repeats = share.where(F.substring("id", 4, 20).cast("bigint") % 3 == 0)
        share.unionByName(repeats).write.mode("append").parquet(path)
        for begin in start:
            begin().awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))


@query("stream_dedup", o.with_tables(
    f"SELECT id, {o.tick('start_datetime')} AS tick_no FROM feed", "feed"))
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, _ = history_tables(spark, sf_dir)
    path, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "arrivals", "checkpoint"))
    rows = jobs.arrivals(feed_stream(history, path)).select("id", "tick_no")
    replay(history, path, lambda: to_table(rows, out, checkpoint))
    return spark.read.parquet(out)


@query("stream_arrivals_per_tick", o.with_tables(
    f"""SELECT {o.stamp(f"make_timestamp({o.tick('start_datetime')} * {o.US30})")} AS tick,
 CAST(sum(CASE WHEN CAST(substr(id, 4) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS new_events
 FROM feed GROUP BY 1""", "feed"))
def stream_arrivals_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries per tick, repeats included."""
    history, _ = history_tables(spark, sf_dir)
    path, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "arrival-counts", "checkpoint"))
    counts = jobs.arrival_counts(feed_stream(history, path))
    replay(history, path, lambda: jobs.start_upserts(counts, out, checkpoint))
    return jobs.latest_rows(spark.read.parquet(out), "tick").select(stamp("tick").alias("tick"), "new_events")


@query("stream_congestion", o.with_tables(
    f"""SELECT {o.stamp(f'make_timestamp(tick_no * {o.US30})')} AS tick, corridor, congestion_index, status,
 active_events, closures FROM cong""", "cong"))
def stream_congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated arrivals land in a table; a second stream turns it into congestion."""
    history, rows = history_tables(spark, sf_dir)
    path, silver, out, first, second = (
        scratch_path(spark, n) for n in ("feed", "silver", "congestion", "checkpoint", "checkpoint"))
    arrived = jobs.arrivals(feed_stream(history, path)).select(
        "id", "start_datetime", "event_cause", "corridor", "requires_road_closure", "is_peak", "duration_min")
    open_folder(spark, arrived.schema, silver)
    events = source.read_stream(spark, silver, schema=arrived.schema)
    congested = jobs.congestion_stream(feed.add_lifetime(events, feed.cause_priors(rows)))
    replay(history, path, lambda: to_table(arrived, silver, first),
           lambda: jobs.start_upserts(congested, out, second))
    return jobs.latest_rows(spark.read.parquet(out), "tick", "corridor").withColumn("tick", stamp("tick"))


@query("stream_orders", o.with_tables(
    """SELECT order_id, issued_at_ist, police_station, distance_km, impact_score, manpower FROM ord
 WHERE issued_at_ist IS NOT NULL""", "ord"))
def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    history, rows = history_tables(spark, sf_dir)
    path, priors, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "priors", "orders", "checkpoint"))
    store = PriorStore(spark, priors)
    store.publish(rows, features.CoordinateMedians.fit(history))
    arrived = jobs.arrival_ticks(feed_stream(history, path))
    replay(history, path, lambda: jobs.start_orders(
        arrived, lambda b: recommend(fixture.pseudo_forecasts(b)), store.cells, out, checkpoint))
    return spark.read.parquet(out).select(
        "order_id", "issued_at_ist", "police_station", "distance_km", "impact_score", "manpower")


@query("stream_orders_restart", o.with_tables(
    """SELECT CASE WHEN CAST(substr(event_id, 4) AS BIGINT) % 50 = 9 THEN 'DSP-EVT-NA' ELSE order_id END AS order_id,
 issued_at_ist, police_station, distance_km FROM ord WHERE issued_at_ist IS NOT NULL""", "ord"))
def stream_orders_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes again one delivery (and restart) later, one in fifty has no id: one order each."""
    history, rows = history_tables(spark, sf_dir)
    path, priors, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "priors", "orders", "checkpoint"))
    store = PriorStore(spark, priors)
    store.publish(rows, features.CoordinateMedians.fit(history))
    arrived = jobs.arrival_ticks(feed_stream(history, path))
    nameless = F.substring("id", 4, 20).cast("bigint") % 50 == 9
    first = F.coalesce(F.floor((F.dayofmonth("start_datetime") - 1) * DELIVERIES / F.lit(31)), F.lit(0))
    for part in range(DELIVERIES + 1):
        again = history.where((first == part - 1) & ~nameless)
        fresh = history.where(first == part).withColumn("id", F.when(~nameless, F.col("id")))
        fresh.unionByName(again).write.mode("append").parquet(path)
        jobs.start_orders(arrived, lambda b: recommend(fixture.pseudo_forecasts(b)), store.cells, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("order_id", "issued_at_ist", "police_station", "distance_km")


_PARTS = 4
_DUE = f"coalesce(CAST(extract('day' FROM start_datetime) AS BIGINT) - 1, 0) * {_PARTS} // 31"
_VERSIONS = f"""part AS MATERIALIZED (SELECT *, {_DUE} AS due FROM inc),
 vmed AS MATERIALIZED (SELECT n, median(latitude) AS vlat, median(longitude) AS vlon, max(until) AS until
  FROM (SELECT n, latitude, longitude, max(start_datetime) OVER (PARTITION BY n) AS until
   FROM part JOIN (SELECT unnest(range(1, {_PARTS})) AS n) v ON due < n) q WHERE {o.OK} GROUP BY n),
 placed AS MATERIALIZED (SELECT n, due, e.* EXCLUDE (latitude, longitude), CASE WHEN ok THEN p.latitude ELSE vlat END AS latitude,
  CASE WHEN ok THEN p.longitude ELSE vlon END AS longitude, until
  FROM (SELECT id, due, latitude, longitude, {o.OK} AS ok FROM part) p JOIN vmed ON due <= n JOIN eng e USING (id)),
 vprior AS MATERIALIZED (SELECT n, event_cause AS pc, median(duration_min) AS pm FROM placed
  WHERE due < n AND start_datetime IS NOT NULL AND duration_min IS NOT NULL GROUP BY ALL),
 vstation AS MATERIALIZED (SELECT s.*, z.zone FROM (SELECT n, police_station, median(latitude) AS latitude,
   median(longitude) AS longitude FROM placed WHERE due < n AND police_station <> 'Unknown' GROUP BY ALL HAVING count(*) >= 5) s
  JOIN (SELECT n, police_station, zone, row_number() OVER (PARTITION BY n, police_station ORDER BY count(*) DESC, zone) AS rn
   FROM placed WHERE due < n GROUP BY 1, 2, 3) z ON z.n = s.n AND z.police_station = s.police_station AND rn = 1)"""


@query("stream_refresh", o.with_tables(
    f"""SELECT concat('DSP-', id) AS order_id, {o.stamp('until')} AS known_until, latitude, longitude, station AS police_station,
 distance_km, round(stay, 6) AS sim_duration_min,
 {o.stamp("make_timestamp(epoch_us(start_datetime) + CAST(round(stay * 6e7) AS BIGINT))")} AS sim_end
 FROM (SELECT e.*, s.police_station AS station, round_even(round_even({o.HAVERSINE}, 9), 2) AS distance_km,
  greatest(least(coalesce(CASE WHEN is_high_priority = 1 THEN p50 END, pm, 60E0), 720E0), 5E0) AS stay,
  row_number() OVER (PARTITION BY e.id ORDER BY round_even({o.HAVERSINE}, 9), s.police_station) AS rn
  FROM placed e JOIN (SELECT id AS fid, p50 FROM fc) f ON id = fid JOIN vstation s ON s.n = e.n
  LEFT JOIN vprior ON vprior.n = e.n AND pc = event_cause
  WHERE due = e.n AND start_datetime IS NOT NULL) q WHERE rn = 1""", "fc", extra=_VERSIONS))
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One running stream of orders; before each delivery a version learned from all earlier ones is published.

    Only events of high priority count on their forecast; the others stay for their cause's median.
    """
    history = settle(raw_incidents(spark, sf_dir), "history")
    path, priors, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "priors", "orders", "checkpoint"))
    store = PriorStore(spark, priors)
    due = F.coalesce(F.floor((F.dayofmonth("start_datetime") - 1) * _PARTS / F.lit(31)), F.lit(0))
    open_folder(spark, history.schema, path)
    running = None
    try:
        for part in range(1, _PARTS):
            known = history.where(due < part)
            medians = features.CoordinateMedians.fit(known)
            store.publish(features.engineer(known, medians), medians)
            history.where(due == part).write.mode("append").parquet(path)
            if running is None:
                running = jobs.start_refreshed_orders(
                    source.read_stream(spark, path, schema=history.schema), store, out, checkpoint,
                    lambda b: recommend(fixture.pseudo_forecasts(b)), F.when(F.col("is_high_priority") == 1, F.col("p50")),
                    processingTime="0 seconds")
            running.processAllAvailable()
    finally:
        if running is not None:
            running.stop()
    return spark.read.parquet(out).select(
        "order_id", stamp("known_until").alias("known_until"), "latitude", "longitude", "police_station", "distance_km",
        F.round("sim_duration_min", 6).alias("sim_duration_min"), stamp("sim_end").alias("sim_end"))


@query("stream_late_counts", o.with_tables(
    f"""SELECT d.b AS batch_id, CAST(sum(n) AS BIGINT) AS rows,
 CAST(coalesce(sum(CASE WHEN t <= before.newest - 2 THEN n END), 0) AS BIGINT) AS late_rows,
 {o.stamp(f"make_timestamp(m.newest * {o.US30})")} AS max_tick
 FROM d JOIN m ON d.b = m.b LEFT JOIN m AS before ON before.b = d.b - 1 GROUP BY d.b, m.newest""",
    "feed", extra=f"""d AS MATERIALIZED (SELECT (extract('day' FROM start_datetime) - 1) * 3 // 31
  + CASE WHEN CAST(substr(id, 4) AS BIGINT) % 50 = 7 THEN 1 ELSE 0 END AS b, {o.tick('start_datetime')} AS t,
  CASE WHEN CAST(substr(id, 4) AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS n FROM feed),
 m AS MATERIALIZED (SELECT b, max(max(t)) OVER (ORDER BY b) AS newest FROM d GROUP BY b)"""))
def stream_late_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event in fifty comes a delivery late: rows, rows beyond the watermark, newest tick."""
    history, _ = history_tables(spark, sf_dir)
    path, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "late", "checkpoint"))
    rows = feed_stream(history, path)
    replay(history, path, lambda: jobs.start_late_counts(rows, out, checkpoint),
           held=F.substring("id", 4, 20).cast("bigint") % 50 == 7)
    return spark.read.parquet(out).select("batch_id", "rows", "late_rows", stamp("max_tick").alias("max_tick"))


@query("refreshed_priors", o.with_tables(
    """SELECT event_cause, round(median(duration_min), 6) AS median_duration FROM feed
 WHERE duration_min IS NOT NULL GROUP BY 1""", "feed"))
def refreshed_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors published twice, first from part of the history; the newest version counts."""
    raw = settle(raw_incidents(spark, sf_dir), "history")
    store = PriorStore(spark, scratch_path(spark, "priors"))
    for part in (raw.where(F.dayofmonth("start_datetime") <= 15), raw):
        medians = features.CoordinateMedians.fit(part)
        store.publish(features.engineer(part, medians), medians)
    return store.table("cause_priors").select("event_cause", F.round("median_duration", 6).alias("median_duration"))
