"""Raw incidents to engineered incidents: one narrow chain, no shuffle.

The only learned part, the two coordinate medians, is fitted state
(:class:`CoordinateMedians`), so the same chain runs on a table, on one request
and on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from roadpulse.config import (
    CLOSURE_FLAG, CityConfig, DEFAULT_CITY, MODEL_HIGH_CARD, MODEL_LOW_CARD, MODEL_NUMERIC,
    TEXT_COLUMN,
)
from roadpulse.functions import geo, numeric, temporal, text
from roadpulse.operators.medians import medians_by
from roadpulse.schema import TIMESTAMP_COLUMNS


@dataclass(frozen=True)
class CoordinateMedians:
    """Stand-in location of reports with missing or out-of-city coordinates."""

    latitude: float | None
    longitude: float | None

    @classmethod
    def fit(cls, raw: DataFrame, city: CityConfig = DEFAULT_CITY, **options) -> "CoordinateMedians":
        valid = raw.select("latitude", "longitude").where(
            geo.in_city(F.col("latitude"), F.col("longitude"), city))
        row = medians_by(valid, [], {"latitude": "latitude",
                                     "longitude": "longitude"}, **options).first()
        return cls(row["latitude"], row["longitude"]) if row else cls(None, None)


def parse_timestamps(df: DataFrame) -> DataFrame:
    """UTC timestamps in all four columns; an absent column counts as all null."""
    out = {}
    for name in TIMESTAMP_COLUMNS:
        if name in df.columns:
            out[name] = temporal.parse_utc(F.col(name), df.schema[name].dataType)
        else:
            out[name] = F.lit(None).cast("timestamp")
    return df.withColumns(out)


def add_duration(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    return df.withColumn("duration_min", temporal.impact_minutes(
        F.col("start_datetime"), F.col("resolved_datetime"), F.col("closed_datetime"),
        F.col("end_datetime"), city))


def clean_categories(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Defaults and case; only the cause is also stripped of blanks."""
    out = {}
    for name, default in city.category_defaults.items():
        value = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        value = F.coalesce(value, F.lit(default))
        if name == "event_cause":
            value = text.strip_blanks(value)
        if name in ("event_type", "event_cause", "veh_type"):
            value = F.lower(value)
        out[name] = value
    return df.withColumns(out)


def add_category_flags(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Text flags '0'/'1' for corridor and long-lived causes, 0/1 for closure and priority."""
    out = {
        "is_corridor": F.when(F.col("corridor") != city.off_corridor, "1").otherwise("0"),
        "long_lived_cause": F.when(
            F.col("event_cause").isin(*city.long_lived_causes), "1").otherwise("0"),
        CLOSURE_FLAG: F.lit(0),
    }
    if CLOSURE_FLAG in df.columns:
        said = F.lower(F.col(CLOSURE_FLAG).cast("string"))
        out[CLOSURE_FLAG] = F.when(said.isin(*city.closure_words), 1).otherwise(0)
    if "priority" in df.columns:
        out["is_high_priority"] = F.when(F.col("priority") == "High", 1).otherwise(0)
    return df.withColumns(out)


def clean_coordinates(df: DataFrame, medians: CoordinateMedians,
                      city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """A coordinate outside the city voids the pair; the medians stand in."""
    inside = geo.in_city(F.col("latitude"), F.col("longitude"), city)
    return df.withColumns({
        axis: F.when(inside, F.col(axis)).otherwise(F.lit(getattr(medians, axis)).cast("double"))
        for axis in ("latitude", "longitude")})


def add_clock(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    start = F.col("start_datetime")
    gap = temporal.holiday_gap(start, city)
    return df.withColumns({**temporal.clock_columns(start, city), "_gap": gap}).withColumns({
        **temporal.cycle_columns(),
        "days_to_holiday": F.col("_gap").cast("double"),
        "is_holiday": F.when(F.col("_gap") == 0, 1).otherwise(0),
    }).drop("_gap")


def add_text(df: DataFrame, city: CityConfig = DEFAULT_CITY, source: str = "description") -> DataFrame:
    body = F.col(source).cast("string") if source in df.columns else F.lit(None).cast("string")
    df = df.withColumn(TEXT_COLUMN, F.coalesce(body, F.lit("")))
    df = df.withColumns({
        "desc_length": F.length(TEXT_COLUMN),
        "desc_word_count": text.word_count(F.col(TEXT_COLUMN)),
        "_low": F.lower(TEXT_COLUMN),
    })
    df = df.withColumns({flag: text.mentions("_low", parts)
                         for flag, parts in city.keywords.items()}).drop("_low")
    return df.withColumn("kw_total", F.expr(" + ".join(f"`{flag}`" for flag in city.keywords)))


def add_derived(df: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    return df.withColumns({
        "dist_to_center": geo.centre_distance_km(F.col("latitude"), F.col("longitude"), city),
        "peak_corridor": F.col("is_peak") * F.col("is_corridor").cast("int"),
        "weekend_peak": F.col("is_weekend") * F.col("is_peak"),
    })


def engineer(raw: DataFrame, medians: CoordinateMedians | None = None,
             city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """All row-wise features. Without ``medians`` they are fitted on ``raw``."""
    if medians is None:
        medians = CoordinateMedians.fit(raw, city)
    return (raw.transform(parse_timestamps)
            .transform(add_duration, city)
            .transform(clean_categories, city)
            .transform(add_category_flags, city)
            .transform(clean_coordinates, medians, city)
            .transform(add_clock, city)
            .transform(add_text, city)
            .transform(add_derived, city))


def model_columns(city: CityConfig = DEFAULT_CITY) -> list[str]:
    return [*MODEL_LOW_CARD, *MODEL_HIGH_CARD, *city.keywords, *MODEL_NUMERIC, CLOSURE_FLAG, TEXT_COLUMN]


def model_frame(df: DataFrame, *keep: str, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """The models' input: fixed columns, order and types (``keep`` go in front)."""
    texts = [F.col(c).cast("string").alias(c) for c in (*MODEL_LOW_CARD, *MODEL_HIGH_CARD)]
    numbers = [numeric.number_or_zero(c).alias(c)
               for c in (*city.keywords, *MODEL_NUMERIC, CLOSURE_FLAG)]
    return df.select(*keep, *texts, *numbers,
                     F.coalesce(F.col(TEXT_COLUMN).cast("string"), F.lit("")).alias(TEXT_COLUMN))


def add_major_label(df: DataFrame, city: CityConfig = DEFAULT_CITY, name: str = "major_actual") -> DataFrame:
    """Long or closing incidents; unknown where the duration is."""
    major = (F.col("duration_min") >= city.major_minutes) | (F.col(CLOSURE_FLAG) == 1)
    return df.withColumn(name, F.when(F.col("duration_min").isNotNull(), major.cast("int")))
