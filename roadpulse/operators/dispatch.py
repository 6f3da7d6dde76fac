"""Station directory, nearest station and dispatch orders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY, TEXT_COLUMN
from roadpulse.functions import geo, temporal
from roadpulse.operators.medians import medians_by
from roadpulse.schema import ORDER_COLUMNS, REQUEST_COLUMNS
from roadpulse.session import settle

SPLIT = 8                # each grid level divides a cell into SPLIT x SPLIT
TIE_DIGITS = 9           # distances equal to a micrometre count as a tie
MARGIN_RAD = 1e-9        # about 6 mm: far above rounding and ties


def station_directory(df: DataFrame, city: CityConfig = DEFAULT_CITY, **options) -> DataFrame:
    """Station -> median location, events handled, most frequent zone.

    Counts go through (station, zone) first, so the modal zone (smallest name on a
    tie) needs no buffer of zones.
    """
    known = df.where(F.col("police_station") != city.unknown)
    places = medians_by(known.select("police_station", "latitude", "longitude"), ["police_station"], {
        "latitude": "latitude", "longitude": "longitude"}, **options)
    zones = (known.groupBy("police_station", "zone").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("police_station")
             .agg(F.sum("_n").alias("events_handled"),
                  F.min_by("zone", F.struct(-F.col("_n"), F.col("zone"))).alias("zone"))
             .where(F.col("events_handled") >= city.min_station_events))
    return places.join(zones, "police_station").select(
        "police_station", "latitude", "longitude", "events_handled", "zone")


def _unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    lat, lon = F.radians(lat), F.radians(lon)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


class _Rings:
    """Log-polar grid around the city box for the rest of the globe.

    Rings widen with their radius and sectors are equal angles, so a cell looks equally
    large from the city wherever it lies. Coordinates are plain degrees around the box's
    centre; a straight line in them is never shorter than the great circle.
    """

    def __init__(self, city: CityConfig):
        self.lat = sum(city.lat_range) / 2
        self.lon = sum(city.lon_range) / 2
        self.low = min(city.lat_range[1] - city.lat_range[0], city.lon_range[1] - city.lon_range[0]) / 2
        self.growth = math.log(math.hypot(90 + abs(self.lat), 180) / self.low)

    def cell(self, lat: Column, lon: Column, per_axis: int) -> Column:
        """Number below zero; any finite degrees, also past the poles or the date line."""
        turned = F.pmod(lat + F.lit(90.0), F.lit(360.0))
        over = turned > 180
        y = F.when(over, F.lit(270.0) - turned).otherwise(turned - F.lit(90.0)) - F.lit(self.lat)
        x = F.pmod(lon + F.when(over, F.lit(180.0)).otherwise(F.lit(0.0)) - F.lit(self.lon - 180.0), F.lit(360.0)) - F.lit(180.0)
        ring = F.log(F.greatest(F.hypot(x, y), F.lit(self.low)) / F.lit(self.low)) / F.lit(self.growth / per_axis)
        sector = (F.atan2(y, x) + F.lit(math.pi)) / F.lit(2 * math.pi / per_axis)
        ring, sector = (F.least(F.floor(v), F.lit(per_axis - 1)) for v in (ring, sector))
        return (F.lit(-1) - ring * per_axis - sector).cast("int")

    def centre(self, row: Column, col: Column, per_axis: int) -> tuple[Column, Column, Column]:
        """Latitude and longitude of a cell's middle, and an angle no point of it is farther away."""
        inner, outer = (F.lit(self.low) * F.exp((row + F.lit(i)) * F.lit(self.growth / per_axis)) for i in (0, 1))
        turn = (col + F.lit(0.5)) * F.lit(2 * math.pi / per_axis) - F.lit(math.pi)
        middle = (inner + outer) / 2
        far = F.radians((outer - inner) / 2 + outer * F.lit(math.pi / per_axis)) * F.lit(1.001) + F.lit(1e-9)
        return (F.lit(self.lat) + middle * F.sin(turn), F.lit(self.lon) + middle * F.cos(turn),
                F.least(far, F.lit(math.pi / 2)))


def _cell(lat: Column, lon: Column, per_axis: int, city: CityConfig) -> Column:
    """Row-major cell number inside the city box, below zero beyond it, null without a finite place."""
    def axis(value: Column, low: float, high: float) -> Column:
        position = F.floor((value - F.lit(low)) / F.lit((high - low) / per_axis))
        return F.greatest(F.lit(0), F.least(F.lit(per_axis - 1), position)).cast("int")
    number = axis(lat, *city.lat_range) * per_axis + axis(lon, *city.lon_range)
    return F.when(geo.in_city(lat, lon, city), number).when(
        _placed(lat, lon), _Rings(city).cell(lat, lon, per_axis))


def _placed(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf")), F.lit(False))


def _children(alive: DataFrame, split: int) -> DataFrame:
    child = F.explode(F.sequence(F.lit(0), F.lit(split * split - 1)))
    return alive.withColumn("_child", child).withColumns({
        "_row": F.col("_row") * split + (F.col("_child") / split).cast("int"),
        "_col": F.col("_col") * split + F.col("_child") % split}).drop("_child")


def _within(spots: DataFrame, levels: int, city: CityConfig) -> DataFrame:
    """Candidates per cell of the box.

    A station stays when its distance to the cell's centre is within one cell diameter of
    the best station's (triangle inequality).
    """
    height = city.lat_range[1] - city.lat_range[0]
    width = city.lon_range[1] - city.lon_range[0]
    alive, per_axis = spots, 1
    for _ in range(levels):
        per_axis *= SPLIT
        alive = _children(alive, SPLIT)
        step_lat, step_lon = height / per_axis, width / per_axis
        centre_lat = F.lit(city.lat_range[0]) + (F.col("_row") + F.lit(0.5)) * F.lit(step_lat)
        centre_lon = F.lit(city.lon_range[0]) + (F.col("_col") + F.lit(0.5)) * F.lit(step_lon)
        # no point of the cell is farther from its centre than this
        reach = math.radians(math.hypot(step_lat, step_lon) / 2) * city.earth_radius_km * 1.001 + 1e-6
        alive = alive.withColumn("_d", geo.haversine_km(
            centre_lat, centre_lon, F.col("latitude"), F.col("longitude"), city))
        best = alive.groupBy("_row", "_col").agg(F.min("_d").alias("_best"))
        alive = alive.join(best, ["_row", "_col"]).where(
            F.col("_d") <= F.col("_best") + F.lit(2 * reach)).drop("_best", "_d")
        if levels > 2:  # many stations: each level reads the previous one twice
            alive = settle(alive, "cells")
    return alive.withColumn("_cell", F.col("_row") * per_axis + F.col("_col"))


def _beyond(spots: DataFrame, levels: int, city: CityConfig) -> DataFrame:
    """Candidates per cell of the rings around the box.

    A station goes when the whole cell lies on the near side of the great circle halfway
    between it and the station nearest to the cell's centre. From far away only the few
    stations on the facing edge of the city remain, which distance bounds alone can't tell
    (about six of 1500 a cell; more beyond 90 degrees, up to all of them at the antipode).
    """
    rings = _Rings(city)
    alive, per_axis = spots, 1
    while per_axis < SPLIT ** levels:
        split = SPLIT if per_axis == 1 else 2   # coarse cells shed few stations: small steps from there
        per_axis *= split
        lat, lon, far = rings.centre(F.col("_row"), F.col("_col"), per_axis)
        alive = _children(alive, split).withColumn("_at", F.struct(lat.alias("lat"), lon.alias("lon"), far.alias("far")))
        km = geo.haversine_km(F.col("_at.lat"), F.col("_at.lon"), F.col("latitude"), F.col("longitude"), city)
        # a window reads each level once; it sorts on disk where a coarse cell holds many stations
        best = F.min_by(F.struct("latitude", "longitude"), F.struct(km, F.col("police_station"))).over(
            W.partitionBy("_row", "_col"))
        alive = alive.withColumn("_a", best)
        near, own = _unit(F.col("_a.latitude"), F.col("_a.longitude")), _unit(F.col("latitude"), F.col("longitude"))
        gap = tuple(a - b for a, b in zip(near, own))
        lead = _dot(_unit(F.col("_at.lat"), F.col("_at.lon")), gap)
        aside = F.sqrt(F.greatest(_dot(gap, gap) - lead * lead, F.lit(0.0)))
        least = lead * F.cos("_at.far") - aside * F.sin("_at.far")   # of the nearer one's lead, over the cell
        alive = alive.where(least <= F.lit(MARGIN_RAD)).drop("_a", "_at")
    return alive.withColumn("_cell", -1 - F.col("_row") * per_axis - F.col("_col"))


def station_cells(directory: DataFrame, city: CityConfig = DEFAULT_CITY,
                  levels: int | None = None) -> tuple[DataFrame, int]:
    """Grid over the city and rings around it: per cell the stations that can be nearest to a point in it.

    Both are split level by level and stations that cannot win a cell are dropped, so the
    true nearest one is never lost and the work grows with the number of stations, not with
    stations x cells. Cells of the box count from 0 up, those of the rings from -1 down.

    Returns the settled table ``(cell, candidates)`` and the cells per axis.
    """
    # of stations at one spot only the alphabetically first can be chosen
    spots = settle(directory.where(_placed(F.col("latitude"), F.col("longitude"))).groupBy("latitude", "longitude").agg(
        F.min_by(F.struct("police_station", "zone"), "police_station").alias("_s")).select(
        "_s.police_station", "_s.zone", "latitude", "longitude"), "stations")
    if levels is None:
        levels = max(2, math.ceil(math.log(max(spots.count(), 1), SPLIT * SPLIT)))
    start = spots.withColumns({"_row": F.lit(0), "_col": F.lit(0)})
    columns = ("_cell", "police_station", "zone", "latitude", "longitude")
    alive = _within(start, levels, city).select(*columns).unionByName(_beyond(start, levels, city).select(*columns))
    cells = alive.groupBy(F.col("_cell").alias("cell")).agg(F.collect_list(F.struct(*columns[1:])).alias("candidates"))
    return settle(cells, "station-cells"), SPLIT ** levels


def nearest_station(df: DataFrame, cells: DataFrame, per_axis: int,
                    city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Add the nearest station (alphabetically first on a tie), its zone, place and distance.

    A plain equi-join on the grid cell, then a minimum over that cell's few
    candidates inside the row. Works on streams too.
    """
    side = cells.select(F.col("cell").alias("_c"), "candidates")
    lat, lon = F.col("latitude"), F.col("longitude")
    ranked = F.transform("candidates", lambda s: F.struct(
        F.bround(geo.haversine_km(lat, lon, s["latitude"], s["longitude"], city), TIE_DIGITS).alias("km"),
        s["police_station"].alias("name"), s["zone"].alias("zone"),
        s["latitude"].alias("lat"), s["longitude"].alias("lon")))
    return (df.withColumn("_cell", _cell(lat, lon, per_axis, city))
            .join(side, F.col("_cell") == F.col("_c"), "left")
            .withColumn("_best", F.when(_placed(lat, lon), F.array_min(ranked)))
            .withColumns({
                "station": F.col("_best.name"), "station_zone": F.col("_best.zone"),
                "station_latitude": F.col("_best.lat"), "station_longitude": F.col("_best.lon"),
                "distance_km": F.bround(F.col("_best.km"), 2)})
            .drop("_cell", "_c", "candidates", "_best"))


def request_fields(city: CityConfig = DEFAULT_CITY) -> list[Column]:
    """The twelve request columns out of an engineered row (local clock text)."""
    special = {"description": F.col(TEXT_COLUMN),
               "start_datetime": local_stamp(F.col("start_datetime"), city, sep="T")}
    return [special.get(c, F.col(c)).alias(c) for c in REQUEST_COLUMNS]


def as_requests(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Engineered rows reduced to what was known at report time."""
    return df.select(*[c for c in ("id",) if c in df.columns], *request_fields(city))


def local_stamp(instant: Column, city: CityConfig = DEFAULT_CITY, sep: str = " ") -> Column:
    """Local time as text, with six decimals only when there is a fraction."""
    return temporal.local_text(instant, sep, city)


def dispatch_orders(forecast: DataFrame, cells: DataFrame, per_axis: int,
                    issued_at: Column | None = None, city: CityConfig = DEFAULT_CITY,
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """Forecast rows to 25-column orders addressed to the nearest station.

    ``carry`` names further columns of the rows to keep behind the 25.
    """
    issued = F.col("start_datetime") if issued_at is None else issued_at
    event_id = F.coalesce(F.col("id").cast("string"), F.lit("EVT-NA"))
    routed = nearest_station(forecast, cells, per_axis, city)
    return routed.withColumns({
        "event_id": event_id,
        "order_id": F.concat(F.lit("DSP-"), event_id),
        "issued_at_ist": local_stamp(issued, city),
        "police_station": F.col("station"),
        "description": F.substring(TEXT_COLUMN, 1, 300),
        "status": F.lit("SENT"),
    }).select(*ORDER_COLUMNS, *carry)
