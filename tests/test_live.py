"""Feed, congestion, dispatch and plan rules."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import congestion, dispatch, feed, insight
from roadpulse.operators.recommend import recommend


def events(spark, rows):
    return spark.createDataFrame(rows, "id string, s string, e string, corridor string, requires_road_closure int, is_peak int").select(
        "id", F.col("s").cast("timestamp").alias("start_datetime"), F.col("e").cast("timestamp").alias("sim_end"),
        "corridor", "requires_road_closure", "is_peak")


def test_active_ticks_edges(spark):
    df = events(spark, [
        ("on", "2024-01-01 10:00:00", "2024-01-01 10:30:00", "A", 0, 0),        # ends on a tick: not active there
        ("between", "2024-01-01 10:00:01", "2024-01-01 10:29:00", "A", 0, 0),   # never active at a tick
        ("long", "2024-01-01 10:00:00", "2024-01-01 22:00:00", "A", 0, 0)])
    counts = {r["id"]: r["n"] for r in feed.active_ticks(df).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"on": 1, "long": 24}


def test_congestion_rounding_levels_and_empty(spark):
    df = events(spark, [("1", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "A", 1, 0),
                        ("2", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "Unknown", 0, 1),
                        ("3", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "Non-corridor", 1, 0),
                        ("4", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "Non-corridor", 0, 0)])
    rows = {r["corridor"]: r for r in congestion.corridor_congestion(df).collect()}
    assert rows["A"]["congestion_index"] == 3.12 and rows["A"]["status"] == "Moderate"  # 3.125, half to even
    assert rows["Unknown"]["congestion_index"] == 1.5 and rows["Unknown"]["status"] == "Moderate"
    assert rows["Non-corridor"]["congestion_index"] == 3.5 and rows["Non-corridor"]["status"] == "Heavy"
    empty = congestion.corridor_congestion(df.where("false"))
    assert empty.columns == ["corridor", "congestion_index", "status", "active_events", "closures"] and empty.count() == 0
    assert {r["corridor"] for r in congestion.at_or_above(congestion.corridor_congestion(df), "Heavy").collect()} == {"Non-corridor"}
    assert congestion.congested_count(congestion.corridor_congestion(df)).first()[0] == 3


def plan(spark, **values):
    base = dict(p50=60.0, p90=60.0, closure_p=0.0, major_p=0.0, corridor="Unknown", is_peak=0, threshold=0.5)
    base.update(values)
    df = spark.createDataFrame([tuple(base[k] for k in ("p50", "p90", "closure_p", "major_p", "corridor", "is_peak"))],
                               "p50 double, p90 double, closure_p double, major_p double, corridor string, is_peak int")
    return recommend(df, threshold=base["threshold"]).first()


def test_plan_rules(spark):
    calm = plan(spark, p50=0.0, p90=None)
    assert calm["impact_score"] == 0.0 and calm["severity_band"] == "Low" and calm["manpower"] == 2
    assert list(calm["drivers"]) == ["routine, low-impact event"] and calm["barricades"] == 0
    assert calm["summary"].startswith("Low impact (score 0.0). Expected ~0 min (worst-case ~0 min). Deploy 2 officer(s), no barricades")
    worst = plan(spark, p50=1440.0, p90=4320.0, closure_p=1.0, major_p=1.0, corridor="ORR", is_peak=1)
    assert worst["impact_score"] == 100.0 and worst["severity_band"] == "Severe"
    assert worst["manpower"] == 11 + 3 + 2 + 2 and worst["barricades"] == 16 and "ORR" in worst["diversion_plan"]
    assert list(worst["drivers"])[-1] == "high duration uncertainty" and len(worst["drivers"]) == 6
    at = plan(spark, closure_p=0.275, threshold=0.275)
    assert at["need_diversion"] and at["need_barricading"] and at["barricades"] == 8
    below = plan(spark, closure_p=0.274, threshold=0.275)
    assert not below["need_diversion"] and not below["need_barricading"]


def test_uncertainty_needs_both_limits(spark):
    assert "high duration uncertainty" in plan(spark, p50=72.0, p90=181.0)["drivers"]
    assert "high duration uncertainty" not in plan(spark, p50=72.0, p90=180.0)["drivers"]
    assert "high duration uncertainty" not in plan(spark, p50=80.0, p90=200.0)["drivers"]


@pytest.mark.parametrize("p50, score", [(30.0, 0.472), (120.0, 0.659), (480.0, 0.849), (5000.0, 1.0)])
def test_duration_component(spark, p50, score):
    row = plan(spark, p50=p50)
    assert row["impact_score"] == pytest.approx(45 * score, abs=0.06)


def test_station_directory(spark):
    rows = [("A", 12.9, 77.5, "Z2")] * 2 + [("A", 13.0, 77.6, "Z1")] * 2 + [("A", 13.1, 77.7, "Z3")]
    rows += [("B", 12.8, 77.4, "Z1")] * 4 + [("Unknown", 12.8, 77.4, "Z1")] * 9
    df = spark.createDataFrame(rows, "police_station string, latitude double, longitude double, zone string")
    got = dispatch.station_directory(df).collect()
    assert [(r["police_station"], r["events_handled"], r["zone"], r["latitude"]) for r in got] == [("A", 5, "Z1", 13.0)]


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371 * math.asin(math.sqrt(
        math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


@pytest.mark.parametrize("stations", [1, 7, 300, 5000])
def test_nearest_station_equals_brute_force(spark, stations):
    draw = random.Random(stations)
    directory = [(f"S{i:04d}", draw.uniform(12.6, 13.3), draw.uniform(77.3, 77.9), 5, "Z") for i in range(stations)]
    directory.append(("S0000 twin", directory[0][1], directory[0][2], 5, "Z"))
    points = [(i, draw.uniform(12.6, 13.3), draw.uniform(77.3, 77.9)) for i in range(200)]
    points += [(900, 12.6, 77.3), (901, 13.3, 77.9), (902, 20.0, 70.0), (903, directory[0][1], directory[0][2])]
    cells, per_axis = dispatch.station_cells(spark.createDataFrame(
        directory, "police_station string, latitude double, longitude double, events_handled long, zone string"))
    got = {r["i"]: r for r in dispatch.nearest_station(
        spark.createDataFrame(points, "i int, latitude double, longitude double"), cells, per_axis).collect()}
    for i, lat, lon in points:
        km, name = min((round(haversine(lat, lon, s[1], s[2]), 9), s[0]) for s in directory)
        assert got[i]["station"] == name and got[i]["distance_km"] == pytest.approx(km, abs=0.0051)


@pytest.mark.parametrize("stations", [5, 1500])
def test_nearest_station_beyond_the_box(spark, stations):
    """Far points, past the poles and the date line too; a cell of the rings keeps few stations."""
    draw = random.Random(stations)
    directory = [(f"S{i:04d}", draw.uniform(12.6, 13.3), draw.uniform(77.3, 77.9), 5, "Z") for i in range(stations)]
    if stations == 5:
        directory += [("far", 40.0, -75.0, 5, "Z"), ("south", -89.0, 10.0, 5, "Z")]
    directory.append(("nowhere", None, 77.5, 5, "Z"))
    points = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(300)]
    points += [(300 + i, 12.95 + draw.gauss(0, 1), 77.6 + draw.gauss(0, 1)) for i in range(300)]
    points += [(700, 95.0, 20.0), (701, -100.0, 700.0), (702, 13.0, 257.9), (703, 90.0, 0.0), (704, -90.0, 0.0), (705, 12.95, -102.0)]
    table, per_axis = dispatch.station_cells(spark.createDataFrame(
        directory, "police_station string, latitude double, longitude double, events_handled long, zone string"))
    # ring 53 of 64 ends at 75 degrees; the antipode is about as far from all stations
    kept = table.where(f"cell < 0 AND (-1 - cell) div {per_axis} <= 53").selectExpr("max(size(candidates))", "avg(size(candidates))").first()
    assert kept[0] <= 90 and kept[1] < 12
    got = {r["i"]: r for r in dispatch.nearest_station(spark.createDataFrame(
        points + [(800, float("inf"), 77.5), (801, float("nan"), 1.0), (802, None, 1.0)],
        "i int, latitude double, longitude double"), table, per_axis).collect()}
    assert len(got) == len(points) + 3 and all(got[i]["station"] is None for i in (800, 801, 802))
    for i, lat, lon in points:
        km, name = min((round(haversine(lat, lon, s[1], s[2]), 9), s[0]) for s in directory[:-1])
        assert got[i]["station"] == name and got[i]["distance_km"] == pytest.approx(km, abs=0.0051)


def test_new_between_and_cap(spark):
    df = events(spark, [(f"e{i}", f"2024-01-01 10:{i:02d}:00", "2024-01-01 12:00:00", "A", 0, 0) for i in range(0, 31)])
    new = feed.new_between(df, F.lit("2024-01-01 10:00:00").cast("timestamp"), F.lit("2024-01-01 10:30:00").cast("timestamp"))
    assert new.count() == 30  # the left end is open, the right end closed
    capped = feed.newest_per_tick(feed.with_arrival_tick(new), 15)
    assert {r["id"] for r in capped.collect()} == {f"e{i}" for i in range(16, 31)}
    assert feed.newest_per_tick(new, None).count() == 30


def test_active_severity_defaults(spark):
    df = events(spark, [("a", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "A", 0, 0),
                        ("b", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "A", 0, 0)])
    log = spark.createDataFrame([("a", "High", 61.0)], "event_id string, severity_band string, impact_score double")
    rows = {r["id"]: (r["severity"], r["score"]) for r in insight.active_with_severity(df, log).collect()}
    assert rows == {"a": ("High", 61.0), "b": ("Monitoring", 20.0)}
