"""Forecast columns to an explained deployment plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY
from roadpulse.functions import scoring


def recommend(df: DataFrame, p50: str = "p50", p90: str | None = "p90", closure: str = "closure_p",
              major: str = "major_p", threshold: float | Column | None = None,
              city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Add the 13 plan columns. Rules read raw forecasts; rounding comes last.

    A null (or absent) ``p90`` falls back to ``p50``. Needs ``corridor`` and
    ``is_peak``. Pure column expressions: no shuffle, no Python.
    """
    if threshold is None:
        threshold = city.default_threshold
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    corridor, peak = F.col("corridor"), F.col("is_peak")
    low, pc, pm = F.col(p50), F.col(closure), F.col(major)
    df = df.withColumn("_p90", F.coalesce(F.col(p90), low) if p90 else low)
    high = F.col("_p90")
    df = df.withColumn("impact_score", scoring.impact_score(low, pc, pm, corridor, peak, city))
    score = F.col("impact_score")
    df = df.withColumns({
        "severity_band": scoring.severity_band(score),
        "need_diversion": scoring.needs_diversion(score, pc, low, threshold),
        "need_barricading": scoring.needs_barricades(score, pc, threshold),
        "manpower": scoring.manpower(score, pc, peak, low, high),
    })
    df = df.withColumn("barricades", scoring.barricade_count(
        F.col("need_barricading"), score, pc, F.col("need_diversion")))
    return df.withColumns({
        "diversion_plan": scoring.diversion_text(F.col("need_diversion"), corridor, city),
        "summary": scoring.summary_text(
            F.col("severity_band"), score, low, high, F.col("manpower"), F.col("barricades"),
            F.col("need_barricading"), F.col("need_diversion")),
        "drivers": scoring.drivers(low, high, pc, pm, corridor, peak, city),
        "expected_duration_min": F.bround(low, 1),
        "duration_p90_min": F.bround(high, 1),
        "closure_probability": F.bround(pc, 3),
        "major_event_probability": F.bround(pm, 3),
    }).drop("_p90")
