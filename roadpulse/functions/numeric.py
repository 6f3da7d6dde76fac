"""Numeric expressions shared by features, scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY


def number_or_zero(name: str) -> Column:
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def to_log_minutes(minutes: Column) -> Column:
    return F.log1p(minutes)


def from_log_minutes(value: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Back from the log target to minutes, inside the believable range."""
    return clip(F.expm1(value), *city.forecast_range)


def fold_ratio(predicted: Column, actual: Column) -> Column:
    """How many times the larger of the two exceeds the smaller."""
    return F.greatest(predicted, actual) / F.greatest(F.least(predicted, actual), F.lit(1e-9))
