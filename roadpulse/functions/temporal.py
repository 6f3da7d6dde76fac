"""Time expressions: parsing, local clock, cycles, holidays, ticks."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F, types as T

from roadpulse.config import CityConfig, DEFAULT_CITY

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_DAY = 1440 * MICROS_PER_MINUTE


def minutes_interval(minutes: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def parse_utc(column: Column, data_type: T.DataType) -> Column:
    """UTC timestamp; unreadable text becomes null, zone-less values are UTC."""
    if isinstance(data_type, T.StringType):
        # text with a zone of its own does not parse with another one behind it
        return F.coalesce(F.try_to_timestamp(F.concat(column, F.lit("Z"))),
                          F.try_to_timestamp(F.concat(F.trim(column), F.lit("T00:00:00Z"))), F.try_to_timestamp(column))
    if isinstance(data_type, T.TimestampNTZType):
        return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column))
    return column.cast("timestamp")


def to_local(column: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    return column + minutes_interval(city.utc_offset_minutes)


def to_utc(column: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    return column - minutes_interval(city.utc_offset_minutes)


def local_micros(instant: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Microseconds on the local wall clock since its 1970; no session setting matters."""
    return F.unix_micros(instant) + F.lit(city.utc_offset_minutes * MICROS_PER_MINUTE)


def local_date(instant: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    micros = local_micros(instant, city)
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(MICROS_PER_DAY))) / F.lit(MICROS_PER_DAY)).cast("int"))


def local_hour(instant: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    return F.floor(F.pmod(local_micros(instant, city), F.lit(MICROS_PER_DAY)) / F.lit(60 * MICROS_PER_MINUTE)).cast("int")


def local_text(instant: Column, gap: str = " ", city: CityConfig = DEFAULT_CITY) -> Column:
    """Local date and time, with six decimals only where there is a fraction."""
    micros = F.pmod(local_micros(instant, city), F.lit(MICROS_PER_DAY))
    part = lambda unit, size, width: F.lpad(
        F.pmod((micros - F.pmod(micros, F.lit(unit))) / F.lit(unit), F.lit(size)).cast("bigint").cast("string"), width, "0")
    whole = F.concat(local_date(instant, city).cast("string"), F.lit(gap), part(60 * MICROS_PER_MINUTE, 24, 2), F.lit(":"),
                     part(MICROS_PER_MINUTE, 60, 2), F.lit(":"), part(1_000_000, 60, 2))
    fraction = part(1, 1_000_000, 6)
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(60e6)


def add_minutes(start: Column, minutes: Column) -> Column:
    """Timestamp plus a fractional number of minutes, to the microsecond."""
    return F.timestamp_micros(
        F.unix_micros(start) + F.round(minutes * F.lit(float(MICROS_PER_MINUTE))).cast("bigint"))


def impact_minutes(start: Column, resolved: Column, closed: Column, end: Column,
                   city: CityConfig = DEFAULT_CITY) -> Column:
    """Impact length; the first recorded end decides, implausible values are null."""
    minutes = minutes_between(start, F.coalesce(resolved, closed, end))
    return F.when(minutes.between(*city.duration_range), minutes)


def clock_columns(start: Column, city: CityConfig = DEFAULT_CITY) -> dict[str, Column]:
    """Local hour, Monday-based weekday, month and their weekend / peak flags."""
    day = local_date(start, city)
    hour, dow = local_hour(start, city), F.weekday(day)
    peak = F.lit(False)
    for first, last in city.peak_hours:
        peak = peak | hour.between(first, last)
    return {
        "hour": F.coalesce(hour, F.lit(12)),
        "dow": F.coalesce(dow, F.lit(0)),
        "month": F.coalesce(F.month(day), F.lit(1)),
        "is_weekend": F.when(dow >= 5, 1).otherwise(0),
        "is_peak": F.when(peak, 1).otherwise(0),
    }


def cycle_columns() -> dict[str, Column]:
    """Sine / cosine of hour, weekday and month (columns must exist)."""
    out = {}
    for name, period in (("hour", 24.0), ("dow", 7.0), ("month", 12.0)):
        angle = F.lit(2 * math.pi) * F.col(name) / F.lit(period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def holiday_gap(start: Column, city: CityConfig = DEFAULT_CITY) -> Column:
    """Whole days between the local date and the closest holiday, capped."""
    day = local_date(start, city)
    calendar = F.expr("array(" + ", ".join(f"DATE'{d}'" for d in city.holidays) + ")")
    gap = F.array_min(F.transform(calendar, lambda h: F.abs(F.datediff(day, h))))
    cap = F.lit(city.holiday_cap_days)
    return F.least(F.coalesce(gap, cap), cap)


def shift_start(local_date: Column, hour: int = 7, city: CityConfig = DEFAULT_CITY) -> Column:
    """UTC instant of ``hour``:00 local time on a date."""
    minutes = F.unix_date(local_date).cast("bigint") * F.lit(1440) + F.lit(60 * hour - city.utc_offset_minutes)
    return F.timestamp_micros(minutes * F.lit(MICROS_PER_MINUTE))


def tick_after(column: Column, tick_minutes: int) -> Column:
    """Index of the first tick at or after an instant: tick t owns (t-1, t]."""
    width = F.lit(tick_minutes * MICROS_PER_MINUTE)
    shifted = F.unix_micros(column) + width - F.lit(1)
    return ((shifted - F.pmod(shifted, width)) / width).cast("bigint")


def last_tick_before(column: Column, tick_minutes: int) -> Column:
    """Index of the last tick strictly before an instant."""
    return tick_after(column, tick_minutes) - F.lit(1)


def tick_instant(tick: Column, tick_minutes: int) -> Column:
    return F.timestamp_micros(tick * F.lit(tick_minutes * MICROS_PER_MINUTE))
