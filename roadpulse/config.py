"""Settings of one city, with the default city's values.

Everything the transformations treat as data (bounding box, calendar, keyword
dictionary, weights, limits) lives in :class:`CityConfig`, so another city is a
different instance and no code change.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values: result columns depend on these literally -----------------

HOLIDAYS = (
    "2023-11-12", "2023-11-13", "2023-11-14", "2023-11-27", "2023-12-25",
    "2024-01-01", "2024-01-15", "2024-01-26", "2024-03-08", "2024-03-25",
    "2024-03-29", "2024-04-09", "2024-04-11", "2024-04-14", "2024-04-17",
    "2024-08-15", "2024-10-02", "2024-10-31", "2024-11-01", "2024-12-25",
    "2025-01-01", "2025-01-26", "2025-08-15", "2025-10-02", "2025-12-25",
)

LONG_LIVED_CAUSES = (
    "construction", "water_logging", "pot_holes", "road_conditions", "tree_fall",
)

# Flag column -> literal substrings looked for in the lower-cased description.
KEYWORDS = {
    "kw_accident": ("accident", "collision", "ಅಪಘಾತ"),
    "kw_block": ("block", "blocked", "jam", "stuck", "ಬ್ಲಾಕ್", "ಜಾಮ್", "ನಿಂತಿ"),
    "kw_divert": ("divert", "diversion", "ಡೈವರ್", "ತಿರುಗಿ"),
    "kw_lane": ("lane", "ಲೇನ್"),
    "kw_bothside": ("both", "two side", "ಎರಡೂ", "ಎರಡು ಕಡೆ"),
    "kw_bus": ("bus", "bmtc", "ksrtc", "ಬಸ್"),
    "kw_tree": ("tree", "branch", "ಮರ", "ಗಿಡ"),
    "kw_water": ("water", "logging", "flood", "rain", "ನೀರು", "ಮಳೆ"),
    "kw_work": ("work", "construction", "dig", "pipe", "cement", "ಕಾಮಗಾರಿ", "ವರ್ಕ್", "ಅಗೆ"),
    "kw_vip": ("vip", "minister", "convoy", "ವಿಐಪಿ", "ಸಚಿವ"),
    "kw_rally": ("rally", "protest", "procession", "dharna", "ಪ್ರತಿಭಟನೆ", "ಮೆರವಣಿಗೆ", "ಧರಣಿ"),
    "kw_signal": ("signal", "ಸಿಗ್ನಲ್"),
    "kw_heavy": ("heavy", "lorry", "truck", "container", "ಲಾರಿ", "ಟ್ರಕ್"),
    "kw_breakdown": ("breakdown", "break down", "problem", "puncture", "engine", "gear",
                     "ಸಮಸ್ಯೆ", "ಕೆಟ್ಟು", "ಪಂಚರ್", "ಬ್ರೇಕ್"),
    "kw_fire": ("fire", "ಬೆಂಕಿ"),
    "kw_metro": ("metro", "ಮೆಟ್ರೋ"),
    "kw_flyover": ("flyover", "overpass", "ಫ್ಲೈಓವರ್"),
    "kw_school": ("school", "college", "ಶಾಲೆ", "ಕಾಲೇಜು"),
    "kw_hospital": ("hospital", "ambulance", "ಆಸ್ಪತ್ರೆ", "ಆಂಬ್ಯುಲೆನ್ಸ್"),
    "kw_overturn": ("overturn", "topple", "ಪಲ್ಟಿ"),
    "kw_pothole": ("pothole", "ಗುಂಡಿ"),
}

# Column -> value used when the report leaves it empty.
CATEGORY_DEFAULTS = {
    "event_type": "unplanned",
    "event_cause": "others",
    "veh_type": "none",
    "corridor": "Unknown",
    "zone": "Unknown",
    "police_station": "Unknown",
    "junction": "Unknown",
}

# Defaults of a forecast request (they differ from the table's defaults).
REQUEST_DEFAULTS = {
    "event_type": "unplanned",
    "event_cause": "vehicle_breakdown",
    "veh_type": "none",
    "corridor": "Non-corridor",
    "zone": "Unknown",
    "police_station": "Unknown",
    "junction": "Unknown",
    "latitude": 12.9716,
    "longitude": 77.5946,
    "description": "",
    "requires_road_closure": 0,
}

# Lowest index of each congestion status, worst first.
CONGESTION_LEVELS = ((6.0, "Severe"), (3.5, "Heavy"), (1.5, "Moderate"), (0.0, "Light"))

# Lowest score of each severity band with its base crew, worst first.
SEVERITY_BANDS = ((75.0, "Severe", 11), (50.0, "High", 7), (25.0, "Moderate", 4), (0.0, "Low", 2))

# How many values each drop-down list of the request form offers.
CHOICE_SIZES = {
    "event_cause": 30, "veh_type": 15, "corridor": 30, "zone": 15, "police_station": 60,
}

MODEL_LOW_CARD = (
    "event_type", "event_cause", "veh_type", "zone", "is_corridor", "long_lived_cause",
)
MODEL_HIGH_CARD = ("corridor", "police_station", "junction", "cluster_id")
MODEL_NUMERIC = (
    "latitude", "longitude", "hour", "dow", "month", "is_weekend", "is_peak",
    "is_holiday", "days_to_holiday",
    "corridor_density", "junction_density", "cluster_density", "zone_density",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "peak_corridor", "weekend_peak", "dist_to_center",
    "desc_length", "desc_word_count", "kw_total",
)
CLOSURE_FLAG = "requires_road_closure"
TEXT_COLUMN = "description_text"


@dataclass(frozen=True)
class CityConfig:
    """One city's parameters."""

    utc_offset_minutes: int = 330
    centre_lat: float = 12.9716
    centre_lon: float = 77.5946
    km_per_degree: float = 111.0
    lat_range: tuple[float, float] = (12.6, 13.3)
    lon_range: tuple[float, float] = (77.3, 77.9)
    earth_radius_km: float = 6371.0

    # shortest and longest believable impact, minutes
    duration_range: tuple[float, float] = (0.5, 4320.0)
    # shortest and longest time an event stays on the live feed, minutes
    lifetime_range: tuple[float, float] = (5.0, 720.0)
    default_lifetime: float = 60.0
    major_minutes: float = 180.0
    forecast_range: tuple[float, float] = (1.0, 4320.0)

    peak_hours: tuple[tuple[int, int], ...] = ((8, 11), (17, 21))
    holidays: tuple[str, ...] = HOLIDAYS
    holiday_cap_days: int = 30
    long_lived_causes: tuple[str, ...] = LONG_LIVED_CAUSES
    keywords: dict = field(default_factory=lambda: dict(KEYWORDS))
    category_defaults: dict = field(default_factory=lambda: dict(CATEGORY_DEFAULTS))

    off_corridor: str = "Non-corridor"
    unknown: str = "Unknown"
    closure_words: tuple[str, ...] = ("true", "1", "yes")

    # congestion weights
    closure_weight: float = 1.5
    peak_weight: float = 0.5
    arterial_multiplier: float = 1.25

    # impact score weights
    importance_off_corridor: float = 0.8
    importance_unknown: float = 1.0
    importance_arterial: float = 1.25
    duration_share: float = 0.45
    closure_share: float = 0.30
    major_share: float = 0.25
    peak_multiplier: float = 1.15
    saturation_minutes: float = 1440.0

    min_station_events: int = 5
    tick_minutes: int = 30
    max_forecasts_per_tick: int = 15
    default_threshold: float = 0.5
    n_clusters: int = 40
    seed: int = 42


DEFAULT_CITY = CityConfig()
