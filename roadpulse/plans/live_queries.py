"""Feed, congestion, dispatch and plan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpulse.functions import geo, scoring
from roadpulse.operators import congestion, dispatch, feed, features, insight
from roadpulse.plans import oracle as o
from roadpulse.plans.base import engineered, live_feed, orders, planned, six, stamp, unplaced
from roadpulse.plans.registry import query
from roadpulse.schema import FORECAST_COLUMNS
from roadpulse.session import scratch_path, settle
from roadpulse.sources import sinks

# One fixed instant of the replay, a weekday evening peak.
INSTANT = "2024-01-10 13:30:00"
SINCE = "2024-01-10 13:00:00"
_AT = f"TIMESTAMP '{INSTANT}'"


def _instant(text: str):
    return F.lit(text).cast("timestamp")


@query("feed_lifetime", o.with_tables(
    f"""SELECT id, round(sim_duration_min, 6) AS sim_duration_min, {o.stamp('start_datetime')} AS start_at,
 {o.stamp('sim_end')} AS end_at FROM feed""", "feed"))
def feed_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_feed(spark, sf_dir).select(
        "id", six("sim_duration_min").alias("sim_duration_min"), stamp("start_datetime").alias("start_at"),
        stamp("sim_end").alias("end_at"))


@query("new_events_window", o.with_tables(
    f"""SELECT id, {o.stamp('start_datetime')} AS start_at FROM feed
 WHERE start_datetime > TIMESTAMP '{SINCE}' AND start_datetime <= {_AT}""", "feed"))
def new_events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = feed.new_between(live_feed(spark, sf_dir), _instant(SINCE), _instant(INSTANT))
    return new.select("id", stamp("start_datetime").alias("start_at"))


@query("new_events_per_tick", o.with_tables(
    f"SELECT {o.tick('start_datetime')} AS tick_no, count(*) AS new_events FROM feed GROUP BY 1", "feed"))
def new_events_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = feed.with_arrival_tick(feed.started(unplaced(spark, sf_dir)))
    return arrivals.groupBy("tick_no").agg(F.count(F.lit(1)).alias("new_events"))


@query("active_at_instant", o.with_tables(
    f"SELECT id, corridor FROM feed WHERE start_datetime <= {_AT} AND sim_end > {_AT}", "feed"))
def active_at_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.active_at(live_feed(spark, sf_dir), _instant(INSTANT)).select("id", "corridor")


@query("active_per_tick", o.with_tables(
    """SELECT tick_no, count(*) AS active_events, count(DISTINCT corridor) AS corridors
 FROM active GROUP BY 1""", "active"))
def active_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.active_ticks(live_feed(spark, sf_dir)).groupBy("tick_no", "corridor").agg(
        F.count(F.lit(1)).alias("n")).groupBy("tick_no").agg(
        F.sum("n").alias("active_events"), F.count(F.lit(1)).alias("corridors"))


@query("corridor_congestion", o.with_tables(
    f"""SELECT strftime(make_timestamp(tick_no * {o.US30}), '%Y-%m-%d %H:%M:%S.%f') AS tick, corridor,
 congestion_index, status, active_events, closures FROM cong""", "cong"))
def corridor_congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = congestion.congestion_per_tick(live_feed(spark, sf_dir))
    return table.select(stamp("tick").alias("tick"), "corridor", "congestion_index", "status",
                        "active_events", "closures")


@query("congestion_board", o.with_tables(
    f"""SELECT * FROM ({o.congestion('(SELECT * FROM feed WHERE start_datetime <= ' + _AT + ' AND sim_end > ' + _AT + ') x')}) y
 ORDER BY congestion_index DESC, corridor LIMIT 5""", "feed"))
def congestion_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return congestion.congestion_at(live_feed(spark, sf_dir), _instant(INSTANT)).limit(5)


@query("congested_corridors", o.with_tables(
    """SELECT tick_no, corridor, status FROM cong WHERE status IN ('Severe', 'Heavy', 'Moderate')""", "cong"))
def congested_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = congestion.congestion_per_tick(live_feed(spark, sf_dir))
    return congestion.at_or_above(table, "Moderate").select("tick_no", "corridor", "status")


@query("congested_corridor_count", o.with_tables(
    "SELECT tick_no, count(*) FILTER (WHERE status <> 'Light') AS congested_corridors FROM cong GROUP BY 1",
    "cong"))
def congested_corridor_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = congestion.congestion_per_tick(live_feed(spark, sf_dir))
    return table.groupBy("tick_no").agg(
        F.count_if(F.col("status") != "Light").alias("congested_corridors"))


@query("busiest_days", o.with_tables(
    """SELECT CAST(CAST(loc AS DATE) AS VARCHAR) AS date, count(*) AS events FROM feed GROUP BY 1
 ORDER BY events DESC, date LIMIT 10""", "feed"))
def busiest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.busiest_days(unplaced(spark, sf_dir), 10).select(
        F.col("date").cast("string").alias("date"), "events")


@query("busiest_day", o.with_tables(
    f"""SELECT CAST(d AS VARCHAR) AS date, events,
 {o.stamp("CAST(d AS TIMESTAMP) + INTERVAL '7' HOUR - INTERVAL '330' MINUTE")} AS day_start FROM (
 SELECT CAST(loc AS DATE) AS d, count(*) AS events FROM feed GROUP BY 1 ORDER BY events DESC, d LIMIT 1) q""",
    "feed"))
def busiest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.busiest_day(unplaced(spark, sf_dir)).select(
        F.col("date").cast("string").alias("date"), "events", stamp("day_start").alias("day_start"))


@query("station_directory", o.with_tables(
    """SELECT police_station, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
 events_handled, zone FROM station""", "station"))
def station_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.station_directory(engineered(spark, sf_dir)).select(
        "police_station", six("latitude").alias("latitude"), six("longitude").alias("longitude"),
        "events_handled", "zone")


@query("busiest_stations", o.with_tables(
    "SELECT police_station, events_handled FROM station ORDER BY events_handled DESC, police_station LIMIT 5",
    "station"))
def busiest_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.busiest_stations(dispatch.station_directory(engineered(spark, sf_dir))).select(
        "police_station", "events_handled")


@query("haversine_to_centre", o.with_tables(
    """SELECT id, round(2E0 * 6371 * asin(sqrt(pow(sin(radians(12.9716E0 - latitude) / 2), 2) + cos(radians(latitude))
 * cos(radians(12.9716E0)) * pow(sin(radians(77.5946E0 - longitude) / 2), 2))), 6) AS km FROM eng""", "eng"))
def haversine_to_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(12.9716), F.lit(77.5946))
    return engineered(spark, sf_dir).select("id", six(km).alias("km"))


@query("nearest_station", o.with_tables(
    """SELECT nid AS id, station, station_zone, round(station_latitude, 6) AS station_latitude,
 round(station_longitude, 6) AS station_longitude, distance_km FROM near""", "near"))
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engineered(spark, sf_dir)
    cells, per_axis = dispatch.station_cells(dispatch.station_directory(rows))
    return dispatch.nearest_station(rows, cells, per_axis).select(
        "id", "station", "station_zone", six("station_latitude").alias("station_latitude"),
        six("station_longitude").alias("station_longitude"), "distance_km")


@query("impact_score", o.with_tables(
    "SELECT id, round(dc, 6) AS duration_part, impact_score, severity_band FROM plan", "plan"))
def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select(
        "id", six(scoring.duration_component(F.col("p50"))).alias("duration_part"),
        "impact_score", "severity_band")


_PLAN = ", ".join(FORECAST_COLUMNS)


@query("recommendation", o.with_tables(f"SELECT id, {_PLAN} FROM plan", "plan"))
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select("id", *FORECAST_COLUMNS).withColumn(
        "drivers", F.array_join("drivers", "; "))


@query("dispatch_orders", o.with_tables(
    """SELECT * REPLACE (round(latitude, 6) AS latitude, round(longitude, 6) AS longitude) FROM ord""", "ord"))
def dispatch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).withColumns({
        "latitude": six("latitude"), "longitude": six("longitude"),
        "drivers": F.array_join("drivers", "; ")})


@query("dispatch_log", o.with_tables(
    """SELECT order_id, issued_at_ist, police_station, distance_km, event_cause, corridor, severity_band,
 impact_score, manpower, barricades, need_diversion, expected_duration_min, status FROM ord""", "ord"))
def dispatch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported log, read back from the written CSV."""
    path = scratch_path(spark, "dispatch-log")
    log = sinks.dispatch_log(orders(spark, sf_dir))
    sinks.write_csv(log, path)
    return spark.read.schema(log.schema).options(header=True, escape='"').csv(path)


@query("order_json", o.with_tables(
    """SELECT order_id, event_id, impact_score, manpower, need_diversion, drivers FROM ord""", "ord"))
def order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders serialised to JSON documents and parsed again."""
    table = orders(spark, sf_dir)
    back = sinks.order_json(table).select(
        "order_id", F.from_json("json", table.schema.simpleString()).alias("o"))
    return back.select("order_id", "o.event_id", "o.impact_score", "o.manpower", "o.need_diversion",
                       F.array_join("o.drivers", "; ").alias("drivers"))


@query("forecast_json", o.with_tables(
    f"""SELECT id, impact_score, event_cause AS asked_cause, {o.ASKED} AS asked_at FROM plan""", "plan"))
def forecast_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sinks.forecast_json(planned(spark, sf_dir))
    return docs.select(
        "id", F.get_json_object("json", "$.impact_score").cast("double").alias("impact_score"),
        F.get_json_object("json", "$.input.event_cause").alias("asked_cause"),
        F.get_json_object("json", "$.input.start_datetime").alias("asked_at"))


@query("prediction_table", o.with_tables(
    """SELECT id, event_type, event_cause, veh_type, corridor, zone, is_peak,
 round_even(duration_min, 1) AS actual_duration_min, requires_road_closure AS actual_requires_closure,
 CASE WHEN duration_min IS NOT NULL THEN CASE WHEN duration_min >= 180 OR requires_road_closure = 1
  THEN 1 ELSE 0 END END AS actual_major,
 expected_duration_min AS pred_duration_p50_min, duration_p90_min AS pred_duration_p90_min,
 closure_probability AS pred_closure_prob, major_event_probability AS pred_major_prob, impact_score,
 severity_band, manpower AS rec_manpower, barricades AS rec_barricades, need_barricading, need_diversion
 FROM plan""", "plan"))
def prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.prediction_table(features.add_major_label(planned(spark, sf_dir)))


@query("dispatch_capped_per_tick", o.with_tables(
    f"""SELECT tick_no, id FROM (SELECT id, {o.tick('start_datetime')} AS tick_no, row_number() OVER (
 PARTITION BY {o.tick('start_datetime')} ORDER BY start_datetime DESC, id DESC) AS rn FROM feed) q
 WHERE rn <= 15""", "feed"))
def dispatch_capped_per_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = feed.with_arrival_tick(feed.started(unplaced(spark, sf_dir)))
    return feed.newest_per_tick(arrivals, 15).select("tick_no", "id")


def _issued(rows: DataFrame) -> DataFrame:
    """Stand-in order log: everything reported before the instant's window."""
    return rows.where(F.col("start_datetime") <= _instant(SINCE)).select(F.col("id").alias("event_id"))


@query("undispatched_anti", o.with_tables(
    f"SELECT id FROM feed WHERE start_datetime > TIMESTAMP '{SINCE}'", "feed"))
def undispatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.started(engineered(spark, sf_dir))
    return feed.without_issued(rows, _issued(rows)).select("id")


@query("order_log_append", o.with_tables(
    f"""SELECT order_id, CASE WHEN start_datetime <= TIMESTAMP '{SINCE}' THEN 1 ELSE 2 END AS batch
 FROM ord JOIN eng ON id = event_id WHERE start_datetime IS NOT NULL""", "ord"))
def order_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log grows by union: orders of the past plus those of newly seen events."""
    rows = feed.started(engineered(spark, sf_dir))
    past = _issued(rows).select(F.concat(F.lit("DSP-"), "event_id").alias("order_id"), F.lit(1).alias("batch"))
    fresh = feed.without_issued(rows, _issued(rows)).select(
        F.concat(F.lit("DSP-"), "id").alias("order_id"), F.lit(2).alias("batch"))
    return past.unionByName(fresh)


_ACTIVE_NOW = f"act AS MATERIALIZED (SELECT * FROM feed WHERE start_datetime <= {_AT} AND sim_end > {_AT})"


def _board(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The active set, small enough to settle, and the order log up to the window's start.

    Boards read no addresses, so the log is not routed; both sides bound the start column.
    """
    active = settle(feed.active_at(live_feed(spark, sf_dir), _instant(INSTANT)), "active")
    event_id = F.coalesce(F.col("id").cast("string"), F.lit("EVT-NA"))
    log = planned(spark, sf_dir).where(F.col("start_datetime") <= _instant(SINCE)).withColumns({
        "event_id": event_id, "order_id": F.concat(F.lit("DSP-"), event_id)})
    return active, log


@query("active_orders", o.with_tables(
    """SELECT order_id, severity_band, manpower FROM ord WHERE issued_at_ist <= '2024-01-10 18:30:00'
 AND event_id IN (SELECT id FROM act)""", "ord", "feed", extra=_ACTIVE_NOW))
def active_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    active, log = _board(spark, sf_dir)
    return insight.active_orders(log, active).select("order_id", "severity_band", "manpower")


@query("active_severity", o.with_tables(
    """SELECT id, coalesce(severity_band, 'Monitoring') AS severity, coalesce(impact_score, 20E0) AS score
 FROM act LEFT JOIN (SELECT event_id, severity_band, impact_score FROM ord
 WHERE issued_at_ist <= '2024-01-10 18:30:00') q
 ON id = event_id""", "ord", "feed", extra=_ACTIVE_NOW))
def active_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events reported after the log was last written show the monitoring defaults."""
    active, log = _board(spark, sf_dir)
    return insight.active_with_severity(active, log).select("id", "severity", "score")


@query("live_kpis", o.with_tables(
    f"""SELECT (SELECT count(*) FROM act) AS active_events,
 (SELECT count(DISTINCT corridor) FROM act) AS affected_corridors,
 (SELECT count(*) FROM ({o.congestion('act')}) c WHERE status <> 'Light') AS congested_corridors,
 (SELECT count(*) FROM log) AS orders,
 (SELECT CAST(coalesce(sum(manpower), 0) AS BIGINT) FROM log WHERE event_id IN (SELECT id FROM act)) AS officers_deployed""",
    "ord", "feed", extra=_ACTIVE_NOW
    + ", log AS MATERIALIZED (SELECT * FROM ord WHERE issued_at_ist <= '2024-01-10 18:30:00')"))
def live_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    active, log = _board(spark, sf_dir)
    return insight.live_kpis(active, congestion.corridor_congestion(active), log)


@query("newest_orders", o.with_tables(
    """SELECT order_id, issued_at_ist FROM ord WHERE issued_at_ist IS NOT NULL
 ORDER BY issued_at_ist DESC, order_id DESC LIMIT 4""", "ord"))
def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.newest_orders(orders(spark, sf_dir)).select("order_id", "issued_at_ist")
