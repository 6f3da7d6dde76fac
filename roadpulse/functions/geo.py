"""Coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY


def in_city(lat: Column, lon: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    return F.coalesce(lat.between(*city.lat_range) & lon.between(*city.lon_range), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 city: CityConfig = DEFAULT_CITY) -> Column:
    """Great-circle distance."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = (F.pow(F.sin(half_dlat), 2.0)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2.0))
    return F.lit(2.0 * city.earth_radius_km) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def centre_distance_km(lat: Column, lon: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Flat-earth distance from the city centre."""
    return F.sqrt(F.pow(lat - F.lit(city.centre_lat), 2.0)
                  + F.pow(lon - F.lit(city.centre_lon), 2.0)) * F.lit(city.km_per_degree)
