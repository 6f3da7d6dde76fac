"""Historical summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadpulse.operators import insight, lookups
from roadpulse.plans import oracle as o
from roadpulse.plans.base import engineered, six, unplaced
from roadpulse.plans.registry import query


@query("median_duration_by_cause", o.with_tables(
    """SELECT event_cause, round(median(duration_min), 6) AS median_duration FROM eng
 WHERE duration_min IS NOT NULL GROUP BY 1""", "eng"))
def median_duration_by_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.duration_by_cause(unplaced(spark, sf_dir)).select(
        "event_cause", six("median_duration").alias("median_duration"))


@query("closure_rate_by_cause", o.with_tables(
    """SELECT event_cause, round(avg(requires_road_closure) * 100, 6) AS closure_percent FROM eng GROUP BY 1""",
    "eng"))
def closure_rate_by_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.closure_percent_by_cause(unplaced(spark, sf_dir)).select(
        "event_cause", six("closure_percent").alias("closure_percent"))


@query("events_by_hour", o.with_tables(
    """SELECT hour, count(*) AS events FROM eng WHERE start_datetime IS NOT NULL GROUP BY 1""", "eng"))
def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.events_by_hour(unplaced(spark, sf_dir))


@query("busiest_corridors", o.with_tables(
    """SELECT corridor, count(*) AS events FROM eng GROUP BY 1 ORDER BY events DESC, corridor LIMIT 5""", "eng"))
def busiest_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.busiest_corridors(unplaced(spark, sf_dir), 5)


# below the number of values of each field, so that every list is cut
LISTED = {"event_cause": 6, "veh_type": 3, "corridor": 5, "zone": 3, "police_station": 25}


@query("top_choices", o.with_tables(" UNION ALL ".join(
    f"""SELECT '{c}' AS dimension, value FROM (SELECT {c} AS value, count(*) AS n FROM eng GROUP BY 1
 ORDER BY n DESC, value LIMIT {n}) q""" for c, n in LISTED.items()), "eng"))
def top_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.top_choices(unplaced(spark, sf_dir), LISTED)


@query("hot_spots", o.with_tables(
    """SELECT id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude FROM eng
 ORDER BY md5(concat(id, '#1')), id LIMIT 3000""", "eng"))
def hot_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insight.hot_spots(engineered(spark, sf_dir)).select(
        "id", six("latitude").alias("latitude"), six("longitude").alias("longitude"))


@query("reference_tables", o.with_tables(
    """SELECT 'median_duration_by_cause' AS kind, event_cause AS key, round_even(median(duration_min), 1) AS value
 FROM eng WHERE duration_min IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'closure_rate_by_cause', event_cause, round_even(avg(requires_road_closure), 3) FROM eng GROUP BY 2
 UNION ALL SELECT 'corridor_event_counts', corridor, CAST(count(*) AS DOUBLE) FROM eng GROUP BY 2
 UNION ALL SELECT 'overall_median_duration', 'all', round(median(duration_min), 6) FROM eng
 UNION ALL SELECT 'thresholds', 'closure', 0.5E0""", "eng"))
def reference_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.reference_tables(engineered(spark, sf_dir)).withColumn("value", six("value"))
