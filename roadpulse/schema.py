"""Explicit schemas, so no source is ever scanned for type inference."""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMP_COLUMNS = (
    "start_datetime", "end_datetime", "closed_datetime", "resolved_datetime",
)

_TEXT = (
    "id", "event_type", "event_cause", "veh_type", "corridor", "zone",
    "police_station", "junction", "description", "priority", "requires_road_closure",
)

# As found in text sources: timestamps stay text and are parsed by the pipeline.
RAW_TEXT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude")]
    + [T.StructField(c, T.StringType()) for c in TIMESTAMP_COLUMNS]
)

# As found in columnar sources.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.DoubleType()) for c in ("latitude", "longitude")]
    + [T.StructField(c, T.TimestampType()) for c in TIMESTAMP_COLUMNS]
)

REQUEST_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "id", "event_type", "event_cause", "veh_type", "corridor", "zone",
        "police_station", "junction", "description", "start_datetime")]
    + [T.StructField("latitude", T.DoubleType()),
       T.StructField("longitude", T.DoubleType()),
       T.StructField("requires_road_closure", T.IntegerType())]
)

# Fields of a request: what is known when an incident is reported.
REQUEST_COLUMNS = (
    "event_type", "event_cause", "veh_type", "corridor", "zone", "police_station",
    "junction", "latitude", "longitude", "description", "start_datetime",
    "requires_road_closure",
)

FORECAST_COLUMNS = (
    "impact_score", "severity_band", "expected_duration_min", "duration_p90_min",
    "closure_probability", "major_event_probability", "manpower", "barricades",
    "need_barricading", "need_diversion", "diversion_plan", "summary", "drivers",
)

ORDER_COLUMNS = (
    "order_id", "issued_at_ist", "police_station", "station_zone", "distance_km",
    "event_id", "event_cause", "corridor", "zone", "latitude", "longitude",
    "description", "impact_score", "severity_band", "expected_duration_min",
    "duration_p90_min", "closure_probability", "major_event_probability", "manpower",
    "barricades", "need_diversion", "diversion_plan", "summary", "drivers", "status",
)

DISPATCH_LOG_COLUMNS = (
    "order_id", "issued_at_ist", "police_station", "distance_km", "event_cause",
    "corridor", "severity_band", "impact_score", "manpower", "barricades",
    "need_diversion", "expected_duration_min", "status",
)

PREDICTION_COLUMNS = (
    "id", "event_type", "event_cause", "veh_type", "corridor", "zone", "is_peak",
    "actual_duration_min", "actual_requires_closure", "actual_major",
    "pred_duration_p50_min", "pred_duration_p90_min", "pred_closure_prob",
    "pred_major_prob", "impact_score", "severity_band", "rec_manpower",
    "rec_barricades", "need_barricading", "need_diversion",
)

CONGESTION_COLUMNS = (
    "corridor", "congestion_index", "status", "active_events", "closures",
)
