"""Independent SQL statements of the same results, for another engine (DuckDB)."""

from __future__ import annotations

from roadpulse.config import HOLIDAYS, KEYWORDS, LONG_LIVED_CAUSES
from roadpulse.sources.fixture import FORECAST_SQL, INCIDENTS_SQL

OK = "coalesce(latitude BETWEEN 12.6E0 AND 13.3E0 AND longitude BETWEEN 77.3E0 AND 77.9E0, false)"


def _strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


INC = f"inc AS MATERIALIZED ({INCIDENTS_SQL.format(events='events')})"
MED = f"""med AS MATERIALIZED (SELECT median(latitude) AS mlat, median(longitude) AS mlon
 FROM inc WHERE {OK})"""
ENG = f"""eng AS MATERIALIZED (
 SELECT *, CASE WHEN minutes BETWEEN 0.5E0 AND 4320E0 THEN minutes END AS duration_min,
  CASE WHEN corridor <> 'Non-corridor' THEN '1' ELSE '0' END AS is_corridor,
  CASE WHEN event_cause IN ({_strings(LONG_LIVED_CAUSES)}) THEN '1' ELSE '0' END AS long_lived_cause,
  coalesce(CAST(extract('hour' FROM loc) AS INT), 12) AS hour,
  coalesce(CAST(extract('isodow' FROM loc) AS INT) - 1, 0) AS dow,
  coalesce(CAST(extract('month' FROM loc) AS INT), 1) AS month,
  CASE WHEN extract('isodow' FROM loc) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN extract('hour' FROM loc) BETWEEN 8 AND 11 OR extract('hour' FROM loc) BETWEEN 17 AND 21
   THEN 1 ELSE 0 END AS is_peak
 FROM (SELECT id,
  lower(coalesce(event_type, 'unplanned')) AS event_type,
  lower(trim(coalesce(event_cause, 'others'))) AS event_cause,
  lower(coalesce(veh_type, 'none')) AS veh_type,
  coalesce(corridor, 'Unknown') AS corridor, coalesce(zone, 'Unknown') AS zone,
  coalesce(police_station, 'Unknown') AS police_station, coalesce(junction, 'Unknown') AS junction,
  CASE WHEN {OK} THEN latitude ELSE mlat END AS latitude,
  CASE WHEN {OK} THEN longitude ELSE mlon END AS longitude,
  coalesce(description, '') AS description_text,
  CASE WHEN lower(requires_road_closure) IN ('true', '1', 'yes') THEN 1 ELSE 0 END AS requires_road_closure,
  CASE WHEN priority = 'High' THEN 1 ELSE 0 END AS is_high_priority,
  start_datetime, start_datetime + INTERVAL '330' MINUTE AS loc,
  (epoch_us(coalesce(resolved_datetime, closed_datetime, end_datetime)) - epoch_us(start_datetime)) / 6e7 AS minutes
  FROM inc, med) q)"""
PRIOR = """prior AS MATERIALIZED (SELECT event_cause AS pc, median(duration_min) AS pm FROM eng
 WHERE start_datetime IS NOT NULL AND duration_min IS NOT NULL GROUP BY 1)"""
FEED = """feed AS MATERIALIZED (SELECT *, make_timestamp(epoch_us(start_datetime)
  + CAST(round(sim_duration_min * 6e7) AS BIGINT)) AS sim_end
 FROM (SELECT eng.*, greatest(least(coalesce(duration_min, pm, 60E0), 720E0), 5E0) AS sim_duration_min
  FROM eng LEFT JOIN prior ON event_cause = pc WHERE start_datetime IS NOT NULL) q)"""
FC = f"fc AS MATERIALIZED ({FORECAST_SQL.format(rows='eng')})"
DIR = """station AS MATERIALIZED (SELECT s.police_station, s.latitude, s.longitude, s.events_handled, z.zone
 FROM (SELECT police_station, median(latitude) AS latitude, median(longitude) AS longitude,
   count(*) AS events_handled FROM eng WHERE police_station <> 'Unknown'
   GROUP BY 1 HAVING count(*) >= 5) s
 JOIN (SELECT police_station, zone, row_number() OVER (PARTITION BY police_station
   ORDER BY count(*) DESC, zone) AS rn FROM eng GROUP BY 1, 2) z
 ON s.police_station = z.police_station AND z.rn = 1)"""
HAVERSINE = """2E0 * 6371 * asin(sqrt(least(1E0, pow(sin(radians(s.latitude - e.latitude) / 2), 2)
 + cos(radians(e.latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - e.longitude) / 2), 2))))"""
NEAR = f"""near AS MATERIALIZED (SELECT * FROM (
 SELECT e.id AS nid, s.police_station AS station, s.zone AS station_zone, s.latitude AS station_latitude,
  s.longitude AS station_longitude, round_even(round_even({HAVERSINE}, 9), 2) AS distance_km,
  row_number() OVER (PARTITION BY e.id ORDER BY round_even({HAVERSINE}, 9), s.police_station) AS rn
 FROM eng e CROSS JOIN station s) q WHERE rn = 1)"""
TICK = "CAST(ceil(epoch_us({0}) / {1}E0) AS BIGINT)"
US30 = 30 * 60_000_000


def tick(column: str) -> str:
    return TICK.format(column, US30)


ACTIVE = f"""active AS MATERIALIZED (SELECT feed.*, t.tick_no FROM feed
 JOIN (SELECT unnest(range((SELECT min({tick('start_datetime')}) FROM feed),
   (SELECT max({tick('sim_end')}) FROM feed) + 1)) AS tick_no) t
 ON epoch_us(start_datetime) <= t.tick_no * {US30} AND epoch_us(sim_end) > t.tick_no * {US30})"""
_WEIGHT = """(1E0 + 1.5E0 * requires_road_closure + 0.5E0 * is_peak)
 * CASE WHEN corridor IN ('Non-corridor', 'Unknown') THEN 1E0 ELSE 1.25E0 END"""


def congestion(source: str, *by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"""SELECT {keys}corridor, congestion_index,
 CASE WHEN congestion_index >= 6 THEN 'Severe' WHEN congestion_index >= 3.5 THEN 'Heavy'
  WHEN congestion_index >= 1.5 THEN 'Moderate' ELSE 'Light' END AS status, active_events, closures
 FROM (SELECT {keys}corridor, round_even(sum({_WEIGHT}), 2) AS congestion_index,
  count(*) AS active_events, CAST(sum(requires_road_closure) AS BIGINT) AS closures
  FROM {source} GROUP BY ALL) q"""


CONG = f"cong AS MATERIALIZED ({congestion('active', 'tick_no')})"

_DC = "least(1E0, ln(1 + greatest(p50, 0E0)) / ln(1441E0))"
_IMP = "CASE corridor WHEN 'Non-corridor' THEN 0.8E0 WHEN 'Unknown' THEN 1E0 ELSE 1.25E0 END"
_WIDE = "(hi > greatest(p50, 1E0) * 2.5E0 AND hi > 180)"


def _minutes(c: str) -> str:
    return (f"CASE WHEN {c} < 90 THEN concat(CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR), ' min') "
            f"ELSE concat(printf('%.1f', round_even({c} / 60, 1)), ' h') END")


PLAN = f"""plan AS MATERIALIZED (
 SELECT *, concat(severity_band, ' impact (score ', CAST(impact_score AS VARCHAR), '). Expected ~', {_minutes('p50')},
   ' (worst-case ~', {_minutes('hi')}, '). Deploy ', manpower, ' officer(s), ',
   CASE WHEN need_barricading THEN CAST(barricades AS VARCHAR) ELSE 'no' END, ' barricades; ',
   CASE WHEN need_diversion THEN 'set up a diversion.' ELSE 'no diversion needed.' END) AS summary,
  CASE WHEN NOT need_diversion THEN 'Keep traffic on its route; officers and signs on site suffice.'
   WHEN corridor NOT IN ('Non-corridor', 'Unknown') THEN concat('Sign a detour away from ', corridor,
    ': staff the two junctions upstream, send through traffic to parallel service roads, warn the neighbouring corridor and announce it early.')
   ELSE 'Lead traffic around the blocked stretch by the closest cross streets, warn drivers 200 m ahead both ways and post a flagger.'
   END AS diversion_plan,
  concat_ws('; ', CASE WHEN reasons = '' THEN 'routine, low-impact event' ELSE reasons END,
   CASE WHEN wide THEN 'high duration uncertainty' END) AS drivers,
  round_even(p50, 1) AS expected_duration_min, round_even(hi, 1) AS duration_p90_min,
  round_even(closure_p, 3) AS closure_probability, round_even(major_p, 3) AS major_event_probability
 FROM (SELECT *,
  CASE WHEN need_barricading THEN 4 + CASE WHEN closure_p > 0.6E0 THEN 4 ELSE 0 END
   + CASE WHEN need_diversion THEN 4 ELSE 0 END + CASE WHEN impact_score >= 75 THEN 4 ELSE 0 END ELSE 0 END AS barricades,
  concat_ws('; ', CASE WHEN dc > 0.6E0 THEN 'long expected duration' END,
   CASE WHEN closure_p > 0.4E0 THEN 'likely road closure' END,
   CASE WHEN major_p > 0.6E0 THEN 'high-impact event profile' END,
   CASE WHEN imp >= 1.25E0 THEN concat('arterial corridor (', corridor, ')') END,
   CASE WHEN is_peak = 1 THEN 'occurs during peak hours' END) AS reasons
  FROM (SELECT *,
   CASE WHEN impact_score < 25 THEN 'Low' WHEN impact_score < 50 THEN 'Moderate'
    WHEN impact_score < 75 THEN 'High' ELSE 'Severe' END AS severity_band,
   closure_p >= 0.5E0 OR (impact_score >= 65 AND p50 > 90) AS need_diversion,
   closure_p >= 0.5E0 OR impact_score >= 60 AS need_barricading,
   {_WIDE} AS wide,
   CASE WHEN impact_score < 25 THEN 2 WHEN impact_score < 50 THEN 4 WHEN impact_score < 75 THEN 7 ELSE 11 END
    + CASE WHEN closure_p > 0.5E0 THEN 3 ELSE 0 END + CASE WHEN is_peak = 1 THEN 2 ELSE 0 END
    + CASE WHEN {_WIDE} THEN 2 ELSE 0 END AS manpower
   FROM (SELECT *, coalesce(p90, p50) AS hi, {_DC} AS dc, {_IMP} AS imp,
     round_even(least(100E0, (0.45E0 * {_DC} + 0.3E0 * closure_p + 0.25E0 * major_p) * 100 * {_IMP}
      * CASE WHEN is_peak = 1 THEN 1.15E0 ELSE 1E0 END), 1) AS impact_score
    FROM fc) a) b) c)"""
_LOCAL = """CASE WHEN epoch_us(start_datetime) % 1000000 = 0 THEN strftime(loc, '%Y-%m-%d{0}%H:%M:%S')
 ELSE strftime(loc, '%Y-%m-%d{0}%H:%M:%S.%f') END"""
ISSUED, ASKED = _LOCAL.format(" "), _LOCAL.format("T")
ORD = f"""ord AS MATERIALIZED (SELECT concat('DSP-', id) AS order_id, {ISSUED} AS issued_at_ist,
 station AS police_station, station_zone, distance_km, id AS event_id, event_cause, corridor, zone,
 latitude, longitude, substr(description_text, 1, 300) AS description, impact_score, severity_band,
 expected_duration_min, duration_p90_min, closure_probability, major_event_probability, manpower,
 barricades, need_diversion, diversion_plan, summary, drivers, 'SENT' AS status
 FROM plan JOIN near ON id = nid)"""

_CHAIN = {
    "inc": INC, "med": MED, "eng": ENG, "prior": PRIOR, "feed": FEED, "fc": FC, "station": DIR,
    "near": NEAR, "active": ACTIVE, "cong": CONG, "plan": PLAN, "ord": ORD,
}
_NEEDS = {
    "inc": (), "med": ("inc",), "eng": ("inc", "med"), "prior": ("eng",), "feed": ("prior", "eng"),
    "fc": ("eng",), "station": ("eng",), "near": ("station",), "active": ("feed",), "cong": ("active",),
    "plan": ("fc",), "ord": ("plan", "near"),
}


def with_tables(body: str, *tables: str, extra: str = "") -> str:
    """Prefix ``body`` with the named building blocks and what they build on."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS[name]:
            add(need)
        if name not in wanted:
            wanted.append(name)

    for name in tables:
        add(name)
    parts = [_CHAIN[n] for n in wanted] + ([extra] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" + body


def keyword_sql() -> str:
    out = []
    for flag, parts in KEYWORDS.items():
        hits = " OR ".join(f"contains(low, '{p}')" for p in parts)
        out.append(f"CASE WHEN {hits} THEN 1 ELSE 0 END AS {flag}")
    return ", ".join(out)


def holiday_gap_sql() -> str:
    gaps = ", ".join(f"abs(datediff('day', DATE '{h}', CAST(loc AS DATE)))" for h in HOLIDAYS)
    return f"CAST(coalesce(least({gaps}, 30), 30) AS DOUBLE)"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


BLANK_FREE = (r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
