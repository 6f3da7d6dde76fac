"""An incident table derived from the generic ``events`` table.

One SQL text that Spark and DuckDB both run. It plants the hard cases: null and
out-of-city coordinates, a rarely seen station, negative and absurd durations,
padded and mixed-case causes, substring traps and Kannada text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.functions.temporal import parse_utc
from roadpulse.schema import TIMESTAMP_COLUMNS

INCIDENTS_SQL = """
SELECT concat('EVT', event_id) AS id,
 CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'Planned' ELSE 'unplanned' END AS event_type,
 CASE (event_id * 7 + user_id) % 11 WHEN 0 THEN 'vehicle_breakdown' WHEN 1 THEN ' Vehicle_Breakdown '
  WHEN 2 THEN 'accident' WHEN 3 THEN 'construction' WHEN 4 THEN 'water_logging' WHEN 5 THEN 'pot_holes'
  WHEN 6 THEN 'road_conditions' WHEN 7 THEN 'tree_fall' WHEN 8 THEN 'public_event' WHEN 9 THEN 'others' END AS event_cause,
 CASE (event_id + user_id) % 6 WHEN 0 THEN 'bmtc_bus' WHEN 1 THEN 'LCV' WHEN 2 THEN 'truck' WHEN 3 THEN 'car'
  WHEN 4 THEN 'bike' END AS veh_type,
 CASE user_id % 9 WHEN 0 THEN 'Non-corridor' WHEN 1 THEN NULL ELSE concat('Corridor ', user_id % 9) END AS corridor,
 CASE WHEN user_id % 5 = 0 THEN NULL ELSE concat('Zone ', event_id % 4) END AS zone,
 CASE WHEN event_id % 4001 = 17 THEN 'PS rare' WHEN user_id % 13 = 0 THEN NULL
  ELSE concat('PS ', user_id % 40) END AS police_station,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('J', (event_id * 31) % 60) END AS junction,
 CASE WHEN event_id % 41 = 0 THEN 0.0E0 WHEN event_id % 43 = 0 THEN NULL
  ELSE 12.8E0 + 0.01E0 * ((user_id * 17 + event_id * 3) % 35) END AS latitude,
 CASE WHEN event_id % 47 = 0 THEN 78.5E0 ELSE 77.4E0 + 0.01E0 * ((user_id * 29 + event_id * 5) % 40) END AS longitude,
 CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'BUS stuck near metro flyover'
  WHEN 3 THEN 'Tree branch fell, heavy rain' WHEN 4 THEN 'Protest rally, traffic diverted both sides'
  WHEN 5 THEN 'ಅಪಘಾತ near school' WHEN 6 THEN 'business training notice' ELSE 'routine check' END AS description,
 CASE event_id % 12 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'yes' WHEN 2 THEN '1.0' WHEN 3 THEN NULL ELSE 'false' END
  AS requires_road_closure,
 CASE WHEN user_id % 9 = 0 THEN 'Low' ELSE 'High' END AS priority,
 CASE WHEN event_id % 97 = 0 THEN NULL ELSE ts END AS start_datetime,
 CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 53 = 0 THEN ts - INTERVAL '5' MINUTE
  ELSE ts + INTERVAL '1' SECOND * CAST(floor(value * 60) AS INT) END AS resolved_datetime,
 CASE WHEN event_id % 2 = 0 THEN NULL ELSE ts + INTERVAL '1' SECOND * CAST(floor(value * 180) AS INT) END AS closed_datetime,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL '1' SECOND * CAST(floor(value * 600) AS INT) END AS end_datetime
FROM {events}
"""

# Deterministic stand-in for model output, so the plan rules can be checked exactly.
FORECAST_SQL = """
SELECT *,
 1.0E0 + (CAST(substr(id, 4) AS BIGINT) * 37 % 4001) / 2.0E0 AS p50,
 CASE WHEN CAST(substr(id, 4) AS BIGINT) % 10 = 0 THEN NULL
  ELSE (1.0E0 + (CAST(substr(id, 4) AS BIGINT) * 37 % 4001) / 2.0E0) * (1 + CAST(substr(id, 4) AS BIGINT) % 5) END AS p90,
 (CAST(substr(id, 4) AS BIGINT) * 13 % 129) / 128.0E0 AS closure_p,
 (CAST(substr(id, 4) AS BIGINT) * 29 % 97) / 96.0E0 AS major_p
FROM {rows}
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(INCIDENTS_SQL, events=events(spark, sf_dir))
    # the table holds zone-less instants; the pipeline works on UTC timestamps
    return raw.withColumns({c: parse_utc(raw[c], raw.schema[c].dataType) for c in TIMESTAMP_COLUMNS})


def pseudo_forecasts(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(FORECAST_SQL, rows=rows)
