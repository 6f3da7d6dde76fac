"""Road-incident impact analytics as PySpark DataFrame transformations."""

from roadpulse.config import CityConfig, DEFAULT_CITY

__all__ = ["CityConfig", "DEFAULT_CITY"]
