"""Sources, cleaning and feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpulse.config import KEYWORDS
from roadpulse.functions import numeric, temporal
from roadpulse.operators import dispatch, features, lookups
from roadpulse.plans import oracle as o
from roadpulse.plans.base import engineered, raw_incidents, six, stamp
from roadpulse.plans.registry import query
from roadpulse.session import prepare, scratch_path, settle
from roadpulse.sources import incidents as source, sinks


@query("csv_roundtrip", o.with_tables(
    f"""SELECT id, event_type, event_cause, corridor, description_text,
 requires_road_closure, {o.stamp('start_datetime')} AS start_at, round(duration_min, 6) AS duration_min FROM eng""",
    "eng"))
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    raw = raw_incidents(spark, sf_dir)
    written = raw.withColumns({c: stamp(c) for c in raw.columns if c.endswith("_datetime")})
    sinks.write_csv(written, path)
    rows = features.engineer(source.read_csv(spark, path))
    return rows.select("id", "event_type", "event_cause", "corridor", "description_text",
                       "requires_road_closure", stamp("start_datetime").alias("start_at"),
                       six("duration_min").alias("duration_min"))


@query("clean_categoricals", o.with_tables(
    """SELECT id, event_type, event_cause, veh_type, corridor, zone, police_station, junction, is_corridor,
 long_lived_cause, requires_road_closure, is_high_priority FROM eng""", "eng"))
def clean_categoricals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_incidents(spark, sf_dir).transform(features.clean_categories).transform(
        features.add_category_flags)
    return rows.select("id", "event_type", "event_cause", "veh_type", "corridor", "zone", "police_station",
                       "junction", "is_corridor", "long_lived_cause", "requires_road_closure",
                       "is_high_priority")


@query("impact_duration", o.with_tables(
    """SELECT id, round(duration_min, 6) AS duration_min, CASE WHEN duration_min IS NOT NULL THEN
 CASE WHEN duration_min >= 180 OR requires_road_closure = 1 THEN 1 ELSE 0 END END AS major_actual,
 round(ln(1 + duration_min), 6) AS log_target FROM eng""", "eng"))
def impact_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_incidents(spark, sf_dir).transform(features.parse_timestamps).transform(
        features.add_duration).transform(features.clean_categories).transform(features.add_category_flags)
    return features.add_major_label(rows).select(
        "id", six("duration_min").alias("duration_min"), "major_actual",
        six(numeric.to_log_minutes(F.col("duration_min"))).alias("log_target"))


@query("target_inverse", o.with_tables(
    """SELECT id, round(greatest(least(exp(y) - 1, 4320E0), 1E0), 4) AS p50,
 round(greatest(greatest(least(exp(y * 1.1E0) - 1, 4320E0), 1E0), greatest(least(exp(y) - 1, 4320E0), 1E0)), 4) AS p90
 FROM (SELECT id, ln(1 + duration_min) AS y FROM eng WHERE duration_min IS NOT NULL) q""", "eng"))
def target_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = numeric.to_log_minutes(F.col("duration_min"))
    rows = engineered(spark, sf_dir).where(F.col("duration_min").isNotNull())
    p50, p90 = numeric.from_log_minutes(y), numeric.from_log_minutes(y * F.lit(1.1))
    return rows.select("id", F.round(p50, 4).alias("p50"), F.round(F.greatest(p90, p50), 4).alias("p90"))


@query("feature_time", o.with_tables(
    """SELECT id, hour, dow, month, is_weekend, is_peak,
 round(sin(2 * pi() * hour / 24), 6) + 0.0E0 AS hour_sin, round(cos(2 * pi() * hour / 24), 6) + 0.0E0 AS hour_cos,
 round(sin(2 * pi() * dow / 7), 6) + 0.0E0 AS dow_sin, round(cos(2 * pi() * dow / 7), 6) + 0.0E0 AS dow_cos,
 round(sin(2 * pi() * month / 12), 6) + 0.0E0 AS month_sin, round(cos(2 * pi() * month / 12), 6) + 0.0E0 AS month_cos
 FROM eng""", "eng"))
def feature_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_incidents(spark, sf_dir).transform(features.parse_timestamps).transform(features.add_clock)
    waves = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")
    return rows.select("id", "hour", "dow", "month", "is_weekend", "is_peak",
                       *[six(c).alias(c) for c in waves])


@query("feature_holiday", o.with_tables(
    f"""SELECT id, {o.holiday_gap_sql()} AS days_to_holiday,
 CASE WHEN {o.holiday_gap_sql()} = 0 THEN 1 ELSE 0 END AS is_holiday FROM eng""", "eng"))
def feature_holiday(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_incidents(spark, sf_dir).transform(features.parse_timestamps).transform(features.add_clock)
    return rows.select("id", "days_to_holiday", "is_holiday")


_FLAGS = ", ".join(KEYWORDS)


@query("feature_text_flags", o.with_tables(
    f"""SELECT id, desc_length, desc_word_count, {_FLAGS}, {' + '.join(KEYWORDS)} AS kw_total FROM (
 SELECT id, CAST(length(description_text) AS INT) AS desc_length,
 CAST(len(regexp_extract_all(description_text, '{o.BLANK_FREE}')) AS INT) AS desc_word_count,
 {o.keyword_sql()} FROM (SELECT *, lower(description_text) AS low FROM eng) a) b""", "eng"))
def feature_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_incidents(spark, sf_dir).transform(features.add_text)
    return rows.select("id", "desc_length", "desc_word_count", *KEYWORDS, "kw_total")


@query("document_text_flags", f"""SELECT doc_id, desc_length, desc_word_count, {_FLAGS},
 {' + '.join(KEYWORDS)} AS kw_total FROM (SELECT doc_id, CAST(length(text) AS INT) AS desc_length,
 CAST(len(regexp_extract_all(text, '{o.BLANK_FREE}')) AS INT) AS desc_word_count, {o.keyword_sql()}
 FROM (SELECT doc_id, text, lower(text) AS low FROM documents) a) b""")
def document_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.transform(features.add_text, source="text").select(
        "doc_id", "desc_length", "desc_word_count", *KEYWORDS, "kw_total")


@query("coords_imputed", o.with_tables(
    "SELECT id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM eng", "eng"))
def coords_imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_incidents(spark, sf_dir)
    return features.clean_coordinates(raw, features.CoordinateMedians.fit(raw)).select(
        "id", six("latitude").alias("latitude"), six("longitude").alias("longitude"))


@query("feature_spatial", o.with_tables(
    """SELECT id, round(sqrt(pow(latitude - 12.9716E0, 2) + pow(longitude - 77.5946E0, 2)) * 111, 6) AS dist_to_center,
 is_peak * CAST(is_corridor AS INT) AS peak_corridor, is_weekend * is_peak AS weekend_peak FROM eng""", "eng"))
def feature_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineered(spark, sf_dir).select(
        "id", six("dist_to_center").alias("dist_to_center"), "peak_corridor", "weekend_peak")


@query("density_counts", o.with_tables(
    " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS value, count(*) AS events FROM eng GROUP BY {k}"
                       for k in ("corridor", "junction", "zone")), "eng"))
def density_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.density_counts(engineered(spark, sf_dir), ("corridor", "junction", "zone"))


@query("density_lookup", o.with_tables(
    """SELECT id, coalesce(c.n, 0) AS corridor_density, coalesce(j.n, 0) AS junction_density,
 coalesce(z.n, 0) AS zone_density FROM eng
 LEFT JOIN (SELECT corridor, count(*) AS n FROM eng WHERE hour < 18 GROUP BY 1) c USING (corridor)
 LEFT JOIN (SELECT junction, count(*) AS n FROM eng WHERE hour < 18 GROUP BY 1) j USING (junction)
 LEFT JOIN (SELECT zone, count(*) AS n FROM eng WHERE hour < 18 GROUP BY 1) z USING (zone)""", "eng"))
def density_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts fitted on one part of the history (daytime) and applied to all rows."""
    rows = engineered(spark, sf_dir)
    table = settle(lookups.density_counts(
        rows.where("hour < 18"), ("corridor", "junction", "zone")), "density")
    return lookups.add_densities(rows, table).select(
        "id", "corridor_density", "junction_density", "zone_density")


@query("model_frame", o.with_tables(
    f"""SELECT id, event_type, event_cause, veh_type, zone, is_corridor, long_lived_cause, corridor,
 police_station, junction, CAST(hour AS DOUBLE) AS hour, CAST(is_peak AS DOUBLE) AS is_peak,
 round(latitude, 6) AS latitude, CAST(n AS DOUBLE) AS corridor_density,
 CAST(requires_road_closure AS DOUBLE) AS requires_road_closure, description_text, 58 AS width
 FROM eng JOIN (SELECT corridor, count(*) AS n FROM eng GROUP BY 1) c USING (corridor)""", "eng"))
def model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engineered(spark, sf_dir).withColumn("cluster_id", F.lit("0"))
    rows = lookups.add_densities(rows, settle(lookups.density_counts(rows), "density"))
    frame = features.model_frame(rows, "id")
    return frame.select(
        "id", "event_type", "event_cause", "veh_type", "zone", "is_corridor", "long_lived_cause", "corridor",
        "police_station", "junction", "hour", "is_peak", six("latitude").alias("latitude"),
        "corridor_density", "requires_road_closure", "description_text",
        F.lit(len(frame.columns) - 1).alias("width"))


@query("request_rows", o.with_tables(
    f"""SELECT id, event_cause, corridor, round(latitude, 6) AS latitude, description_text AS description,
 CASE WHEN requires_road_closure = 1 THEN 'true' ELSE 'false' END AS requires_road_closure,
 {o.stamp('start_datetime')} AS start_at, {o.ASKED} AS asked_at, CAST(NULL AS VARCHAR) AS priority
 FROM eng WHERE start_datetime IS NOT NULL""", "eng"))
def request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows reduced to requests (local clock) and turned back into raw rows (UTC)."""
    rows = engineered(spark, sf_dir).where(F.col("start_datetime").isNotNull())
    asked = dispatch.as_requests(rows).withColumn("asked_at", F.col("start_datetime"))
    raw = source.requests_to_raw(asked.withColumn("id", F.concat_ws("|", "id", "asked_at")))
    return raw.select(
        F.split_part("id", F.lit("|"), F.lit(1)).alias("id"), "event_cause", "corridor",
        six("latitude").alias("latitude"), "description", "requires_road_closure",
        stamp("start_datetime").alias("start_at"), F.split_part("id", F.lit("|"), F.lit(2)).alias("asked_at"),
        "priority")


@query("local_clock", o.with_tables(
    f"""SELECT id, {o.stamp('loc')} AS local_at, {o.stamp('start_datetime')} AS utc_at,
 {o.stamp("date_trunc('day', loc) + INTERVAL '7' HOUR - INTERVAL '330' MINUTE")} AS shift_at,
 {o.tick('start_datetime')} AS tick_no FROM eng WHERE start_datetime IS NOT NULL""", "eng"))
def local_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_incidents(spark, sf_dir).transform(features.parse_timestamps).where(
        F.col("start_datetime").isNotNull())
    local = temporal.to_local(F.col("start_datetime"))
    return rows.select(
        "id", stamp(local).alias("local_at"), stamp(temporal.to_utc(local)).alias("utc_at"),
        stamp(temporal.shift_start(temporal.local_date(F.col("start_datetime")))).alias("shift_at"),
        temporal.tick_after(F.col("start_datetime"), 30).alias("tick_no"))
