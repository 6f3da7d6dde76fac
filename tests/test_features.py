"""Edge rows of cleaning and feature engineering."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roadpulse.functions import temporal, text
from roadpulse.operators import features
from roadpulse.operators.features import CoordinateMedians
from roadpulse.schema import RAW_TEXT_SCHEMA
from roadpulse.sources import incidents as source

PLACE = CoordinateMedians(12.95, 77.6)


def raw(spark, *rows):
    names = RAW_TEXT_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_TEXT_SCHEMA)


def engineer(spark, *rows):
    return [r.asDict() for r in features.engineer(raw(spark, *rows), PLACE).orderBy("id").collect()]


def test_first_recorded_end_decides_even_if_invalid(spark):
    rows = engineer(
        spark,
        dict(id="a", start_datetime="2024-01-01 10:00:00", resolved_datetime="2024-01-01 09:00:00",
             closed_datetime="2024-01-01 11:00:00"),
        dict(id="b", start_datetime="2024-01-01 10:00:00", closed_datetime="2024-01-01 10:00:30"),
        dict(id="c", start_datetime="2024-01-01 10:00:00", end_datetime="2024-01-04 10:00:00"),
        dict(id="d", start_datetime="2024-01-01 10:00:00", end_datetime="2024-01-04 10:00:01"),
        dict(id="e", start_datetime="2024-01-01 10:00:00", closed_datetime="2024-01-01 10:00:29"),
        dict(id="f", start_datetime="garbage", closed_datetime="2024-01-01 10:00:29+00:00"))
    assert [r["duration_min"] for r in rows] == [None, 0.5, 4320.0, None, None, None]


@pytest.mark.parametrize("utc, hour, peak", [
    ("2024-01-01 02:29:59", 7, 0), ("2024-01-01 02:30:00", 8, 1), ("2024-01-01 06:29:00", 11, 1),
    ("2024-01-01 06:30:00", 12, 0), ("2024-01-01 11:30:00", 17, 1), ("2024-01-01 16:29:00", 21, 1),
    ("2024-01-01 16:30:00", 22, 0), (None, 12, 0)])
def test_local_hours(spark, utc, hour, peak):
    row = engineer(spark, dict(id="a", start_datetime=utc))[0]
    assert (row["hour"], row["is_peak"]) == (hour, peak)


def test_missing_start_defaults(spark):
    row = engineer(spark, dict(id="a"))[0]
    assert (row["dow"], row["month"], row["is_weekend"], row["days_to_holiday"], row["is_holiday"]) == (0, 1, 0, 30.0, 0)


@pytest.mark.parametrize("utc, gap, holiday", [
    ("2024-08-15 05:00:00", 0.0, 1), ("2024-08-14 18:29:00", 1.0, 0), ("2024-08-14 18:31:00", 0.0, 1),
    ("2024-08-30 05:00:00", 15.0, 0), ("2024-07-01 05:00:00", 30.0, 0)])
def test_holidays_use_the_local_date(spark, utc, gap, holiday):
    row = engineer(spark, dict(id="a", start_datetime=utc))[0]
    assert (row["days_to_holiday"], row["is_holiday"]) == (gap, holiday)


def test_texts(spark):
    samples = [None, "", "   ", "a b\tc\nd", "ಅಪಘಾತ", "BUS", "business training"]
    rows = engineer(spark, *[dict(id=str(i), description=s) for i, s in enumerate(samples)])
    for row, s in zip(rows, samples):
        assert row["desc_length"] == len(s or "")
        assert row["desc_word_count"] == len((s or "").split())
    assert rows[4]["kw_accident"] == 1 and rows[5]["kw_bus"] == 1
    assert rows[6]["kw_bus"] == 1 and rows[6]["kw_water"] == 1  # substrings, not words
    assert rows[6]["kw_total"] == 2 and rows[0]["kw_total"] == 0


def test_closure_words_and_flags(spark):
    values = ["TRUE", "yes", "1", "1.0", " true", None, "false"]
    rows = engineer(spark, *[dict(id=str(i), requires_road_closure=v, corridor=c) for i, (v, c) in enumerate(
        zip(values, ["Non-corridor", None, "X", "X", "X", "X", "X"]))])
    assert [r["requires_road_closure"] for r in rows] == [1, 1, 1, 0, 0, 0, 0]
    assert [r["is_corridor"] for r in rows][:3] == ["0", "1", "1"]


def test_only_cause_is_stripped(spark):
    row = engineer(spark, dict(id="a", event_cause="  Tree_Fall\t", veh_type=" LCV ", corridor=" X "))[0]
    assert (row["event_cause"], row["veh_type"], row["corridor"], row["long_lived_cause"]) == (
        "tree_fall", " lcv ", " X ", "1")


def test_bad_coordinate_voids_the_pair(spark):
    rows = engineer(spark, dict(id="a", latitude=12.9, longitude=78.5), dict(id="b", latitude=13.3, longitude=77.3),
                    dict(id="c", latitude=None, longitude=77.5))
    assert [(r["latitude"], r["longitude"]) for r in rows] == [(12.95, 77.6), (13.3, 77.3), (12.95, 77.6)]


def test_absent_columns(spark):
    df = spark.createDataFrame([("a", "x", "2024-01-01 10:00:00", 12.9, 77.6)],
                               "id string, event_cause string, start_datetime string, latitude double, longitude double")
    row = features.engineer(df).first()
    assert row["junction"] == "Unknown" and row["requires_road_closure"] == 0 and row["description_text"] == ""
    assert "is_high_priority" not in row.asDict()


def test_model_frame_has_58_columns(spark):
    df = features.engineer(raw(spark, dict(id="a")), PLACE).withColumns({
        "cluster_id": F.lit("3"), **{f"{k}_density": F.lit(1) for k in ("corridor", "junction", "zone", "cluster")}})
    frame = features.model_frame(df)
    assert len(frame.columns) == 58 and frame.columns == features.model_columns()
    assert not [c for c in features.model_columns() if frame.schema[c].dataType.simpleString() not in ("string", "double")]


def test_requests(spark):
    asked = source.requests(spark, [
        dict(id="r1", start_datetime="2024-09-10 18:30", corridor="Hosur Road", requires_road_closure=1), dict(id="r2")])
    rows = {r["id"]: r for r in source.requests_to_raw(asked).collect()}
    assert rows["r1"]["start_datetime"] == dt.datetime(2024, 9, 10, 13, 0)
    assert rows["r1"]["requires_road_closure"] == "true" and rows["r2"]["event_cause"] == "vehicle_breakdown"
    assert rows["r2"]["corridor"] == "Non-corridor" and rows["r2"]["latitude"] == 12.9716
    assert abs((rows["r2"]["start_datetime"] - dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 120


def python_grams(text_value, sizes=(3, 4)):
    out = []
    for word in text_value.lower().split():
        padded = f" {word} "
        for n in sizes:
            out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return sorted(out)


def test_word_char_grams(spark):
    samples = ["", "a", "ab", "Hello  big\nworld", "ಅಪಘಾತ near", "x😀y z", "😀", "ends here\t"]
    df = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    for row in df.select("i", text.word_char_grams(F.col("t")).alias("g")).collect():
        assert sorted(row["g"]) == python_grams(samples[row["i"]]), samples[row["i"]]


def test_tick_is_left_open_right_closed(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-01 10:00:00.000001",), ("2024-01-01 10:30:00",)], "t string")
    ticks = [r[0] for r in df.select(temporal.tick_after(F.col("t").cast("timestamp"), 30)).collect()]
    assert ticks[1] == ticks[0] + 1 == ticks[2]
