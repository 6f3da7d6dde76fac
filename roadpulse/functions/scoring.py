"""Impact score and deployment rules as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY, CONGESTION_LEVELS, SEVERITY_BANDS

# Labels listed in the drivers column, and the summary's wording.
DRIVER_DURATION = "long expected duration"
DRIVER_CLOSURE = "likely road closure"
DRIVER_MAJOR = "high-impact event profile"
DRIVER_ARTERIAL = "arterial corridor (%s)"
DRIVER_PEAK = "occurs during peak hours"
DRIVER_ROUTINE = "routine, low-impact event"
DRIVER_UNCERTAIN = "high duration uncertainty"


def pick(value: Column, steps, default) -> Column:
    """CASE over descending lower limits: the first limit reached wins."""
    (limit, result), *rest = steps
    out = F.when(value >= F.lit(limit), F.lit(result))
    for limit, result in rest:
        out = out.when(value >= F.lit(limit), F.lit(result))
    return out.otherwise(F.lit(default))


def congestion_status(index: Column) -> Column:
    return pick(index, CONGESTION_LEVELS, CONGESTION_LEVELS[-1][1])


def status_rank(status: Column) -> Column:
    """0 for the worst status."""
    ranks = F.lit(None).cast("int")
    for rank, (_, name) in enumerate(CONGESTION_LEVELS):
        ranks = F.when(status == F.lit(name), rank).otherwise(ranks)
    return ranks


def is_named_arterial(corridor: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Neither off-corridor nor unknown (the congestion and diversion meaning)."""
    return ~corridor.isin(city.off_corridor, city.unknown)


def congestion_weight(closure: Column, peak: Column, corridor: Column,
                      city: CityConfig = DEFAULT_CITY) -> Column:
    load = (F.lit(1.0) + F.lit(city.closure_weight) * closure.cast("double")
            + F.lit(city.peak_weight) * peak.cast("double"))
    return load * F.when(is_named_arterial(corridor, city),
                         F.lit(city.arterial_multiplier)).otherwise(F.lit(1.0))


def corridor_importance(corridor: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    return (F.when(corridor == city.off_corridor, F.lit(city.importance_off_corridor))
            .when(corridor == city.unknown, F.lit(city.importance_unknown))
            .otherwise(F.lit(city.importance_arterial)))


def duration_component(minutes: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Minutes on a log curve in 0..1."""
    return F.least(F.lit(1.0), F.log1p(F.greatest(minutes, F.lit(0.0)))
                   / F.lit(math.log1p(city.saturation_minutes)))


def impact_score(minutes: Column, closure_p: Column, major_p: Column, corridor: Column,
                 peak: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """0-100, rounded to one decimal before any rule reads it."""
    blend = (F.lit(city.duration_share) * duration_component(minutes, city)
             + F.lit(city.closure_share) * closure_p + F.lit(city.major_share) * major_p)
    scaled = (blend * F.lit(100.0) * corridor_importance(corridor, city)
              * F.when(peak == 1, F.lit(city.peak_multiplier)).otherwise(F.lit(1.0)))
    return F.bround(F.least(F.lit(100.0), scaled), 1)


def severity_band(score: Column) -> Column:
    return pick(score, [(low, name) for low, name, _ in SEVERITY_BANDS], SEVERITY_BANDS[-1][1])


def wide_uncertainty(p50: Column, p90: Column) -> Column:
    return (p90 > F.greatest(p50, F.lit(1.0)) * 2.5) & (p90 > 180)


def _extra(condition: Column, amount: int) -> Column:
    return F.when(condition, amount).otherwise(0)


def manpower(score: Column, closure_p: Column, peak: Column, p50: Column, p90: Column) -> Column:
    crew = pick(score, [(low, n) for low, _, n in SEVERITY_BANDS], SEVERITY_BANDS[-1][2])
    return (crew + _extra(closure_p > 0.5, 3) + _extra(peak == 1, 2)
            + _extra(wide_uncertainty(p50, p90), 2))


def needs_diversion(score: Column, closure_p: Column, p50: Column, threshold: Column) -> Column:
    return (closure_p >= threshold) | ((score >= 65) & (p50 > 90))


def needs_barricades(score: Column, closure_p: Column, threshold: Column) -> Column:
    return (closure_p >= threshold) | (score >= 60)


def barricade_count(needed: Column, score: Column, closure_p: Column, diversion: Column) -> Column:
    units = (F.lit(4) + _extra(closure_p > 0.6, 4) + _extra(diversion, 4) + _extra(score >= 75, 4))
    return F.when(needed, units).otherwise(0)


def diversion_text(diversion: Column, corridor: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Guidance by need and road class; worded for this engine."""
    return (F.when(~diversion, F.lit("Keep traffic on its route; officers and signs on site suffice."))
            .when(is_named_arterial(corridor, city), F.concat(
                F.lit("Sign a detour away from "), corridor,
                F.lit(": staff the two junctions upstream, send through traffic to parallel "
                      "service roads, warn the neighbouring corridor and announce it early.")))
            .otherwise(F.lit("Lead traffic around the blocked stretch by the closest cross "
                             "streets, warn drivers 200 m ahead both ways and post a flagger.")))


def drivers(p50: Column, p90: Column, closure_p: Column, major_p: Column, corridor: Column,
            peak: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Ordered reasons behind a score; the uncertainty note always comes last."""
    arterial = corridor_importance(corridor, city) >= city.importance_arterial
    reasons = F.array_compact(F.array(
        F.when(duration_component(p50, city) > 0.6, F.lit(DRIVER_DURATION)),
        F.when(closure_p > 0.4, F.lit(DRIVER_CLOSURE)),
        F.when(major_p > 0.6, F.lit(DRIVER_MAJOR)),
        F.when(arterial, F.format_string(DRIVER_ARTERIAL, corridor)),
        F.when(peak == 1, F.lit(DRIVER_PEAK)),
    ))
    note = F.when(wide_uncertainty(p50, p90), F.array(F.lit(DRIVER_UNCERTAIN)))
    return F.concat(
        F.when(F.size(reasons) == 0, F.array(F.lit(DRIVER_ROUTINE))).otherwise(reasons),
        F.coalesce(note, F.array().cast("array<string>")))


def readable_minutes(minutes: Column) -> Column:
    return (F.when(minutes < 90, F.concat(F.bround(minutes, 0).cast("bigint").cast("string"), F.lit(" min")))
            .otherwise(F.concat(F.format_string("%.1f", F.bround(minutes / 60, 1)), F.lit(" h"))))


def summary_text(band: Column, score: Column, p50: Column, p90: Column, crew: Column,
                 barricades: Column, barricading: Column, diversion: Column) -> Column:
    return F.concat(
        band, F.lit(" impact (score "), score.cast("string"), F.lit("). Expected ~"),
        readable_minutes(p50), F.lit(" (worst-case ~"), readable_minutes(p90), F.lit("). Deploy "),
        crew.cast("string"), F.lit(" officer(s), "),
        F.when(barricading, barricades.cast("string")).otherwise(F.lit("no")), F.lit(" barricades; "),
        F.when(diversion, F.lit("set up a diversion.")).otherwise(F.lit("no diversion needed.")))
