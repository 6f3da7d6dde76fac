"""Streams give what the batch operators give."""

from __future__ import annotations

from pyspark.sql import functions as F

import pytest

from roadpulse.operators import congestion, features
from roadpulse.session import settle
from roadpulse.sources import fixture
from roadpulse.streaming import jobs, refresh

SCHEMA = "id string, start_datetime timestamp, sim_end timestamp, corridor string, requires_road_closure int, is_peak int"


def land(spark, path, rows):
    spark.createDataFrame(rows, "id string, s string, e string, corridor string, requires_road_closure int, is_peak int").select(
        "id", F.col("s").cast("timestamp").alias("start_datetime"), F.col("e").cast("timestamp").alias("sim_end"),
        "corridor", "requires_road_closure", "is_peak").coalesce(1).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


DELIVERIES = [
    [("a", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "A", 1, 0), ("a", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "A", 1, 0)],
    [("b", "2024-01-01 10:10:00", "2024-01-01 11:00:00", "A", 0, 1), ("c", "2024-01-01 14:00:00", "2024-01-01 15:00:00", "B", 0, 0)],
    [("a", "2024-01-01 13:30:00", "2024-01-01 13:40:00", "A", 0, 0), ("late", "2024-01-01 09:00:00", "2024-01-01 09:40:00", "A", 0, 0)],
]


def test_duplicates_and_late_rows(spark, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in DELIVERIES:
        land(spark, path, rows)
    query = jobs.arrivals(source(spark, path)).select("id").writeStream.format("parquet").option(
        "checkpointLocation", cp).trigger(availableNow=True).start(out)
    query.awaitTermination()
    ids = sorted(r["id"] for r in spark.read.parquet(out).collect())
    # "late" is hours older than the watermark; the second "a" repeats a remembered id
    # or arrives after it was forgotten, never both within one watermark span
    assert "late" not in ids and ids.count("b") == 1 and ids.count("c") == 1 and ids.count("a") in (1, 2)


def test_one_order_per_event_and_a_cap_per_tick_over_all_batches(spark, tmp_path, monkeypatch):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    event = lambda name, at: (name, f"2024-01-01 {at}", "2024-01-01 23:59:00", "A", 0, 0)
    for rows in ([event("a", "10:05:00"), event("b", "10:10:00")],
                 [event("c", "10:11:00"), event("d", "10:12:00")],        # the same tick, next batch
                 [event("e", "18:00:00")], [event("f", "18:05:00")],       # the watermark passes the first tick
                 [event("a", "20:00:00"), event("g", "20:01:00")]):        # "a" again, long forgotten by the stream
        land(spark, path, rows)
        monkeypatch.setattr(jobs, "orders_stream", lambda rows, *_: rows.select(F.col("id").alias("event_id"), "tick_no"))
        jobs.start_orders(jobs.arrivals(source(spark, path)), None, lambda: (None, 1), out, cp, per_tick=3).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "d", "e", "f", "g"]


def test_orders_need_no_log_of_earlier_batches(spark, tmp_path, monkeypatch):
    """The ids seen live in the stream's state: a restart whose log was moved away repeats no order."""
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    monkeypatch.setattr(jobs, "orders_stream", lambda rows, *_: rows.select(F.col("id").alias("event_id"), "tick_no"))
    event = lambda name, at: (name, f"2024-01-01 {at}", "2024-01-01 23:59:00", "A", 0, 0)
    deliveries = [[event("a", "10:05:00"), event("a", "10:05:00"), event(None, "10:06:00"), event(None, "10:06:00")],
                  [event("a", "12:05:00"), event("b", "12:06:00"), event(None, "10:06:00")],
                  [event("b", "12:06:00"), event("a", "10:05:00"), event("c", "12:07:00")]]
    issued = []
    for rows in deliveries:
        land(spark, path, rows)
        jobs.start_orders(jobs.arrival_ticks(source(spark, path)), None, lambda: (None, 1), out, cp).awaitTermination()
        batches = sorted((tmp_path / "out").glob("batch_id=*"), key=lambda p: int(p.name.split("=")[1]))
        issued += [r["event_id"] for p in batches for r in spark.read.parquet(str(p)).collect()]
        for i, folder in enumerate(batches):
            folder.rename(tmp_path / f"gone-{len(issued)}-{i}")
    assert sorted(map(str, issued)) == ["None", "None", "None", "a", "b", "c"]


def test_late_ticks_get_no_order_beyond_the_cap(spark, tmp_path, monkeypatch):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    monkeypatch.setattr(jobs, "orders_stream", lambda rows, *_: rows.select(F.col("id").alias("event_id"), "tick_no"))
    event = lambda name, at: (name, f"2024-01-01 {at}", "2024-01-01 23:59:00", "A", 0, 0)
    for rows in ([event("a", "10:05:00")], [event("b", "10:06:00"), event("c", "10:40:00")], [event("d", "10:07:00")],
                 [event("e", "18:00:00")], [event("f", "10:08:00")]):
        land(spark, path, rows)
        jobs.start_orders(jobs.arrival_ticks(source(spark, path)), None, lambda: (None, 1), out, cp, per_tick=2).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "e"]
    assert spark.read.parquet(f"{out}/_open_ticks/batch_id=4").count() == 1   # only open ticks are carried on


def test_arrivals_keep_rows_without_an_id(spark, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    row = lambda name, at: (name, f"2024-01-01 {at}", "2024-01-01 23:59:00", "A", 0, 0)
    for rows in ([row(None, "10:01:00"), row(None, "10:07:00"), row("a", "10:07:00")], [row("a", "10:08:00"), row(None, "10:01:00")],
                 [row("b", "15:00:00")], [row("late", "09:00:00")]):
        land(spark, path, rows)
    jobs.arrivals(source(spark, path)).select("id").writeStream.format("parquet").option(
        "checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(str(r["id"]) for r in spark.read.parquet(out).collect()) == ["None"] * 3 + ["a", "b"]


class Model:
    """Stands for a forecaster: writes its number, reads it back."""

    loads = []

    def __init__(self, number):
        self.number = number

    def save(self, spark, path):
        spark.range(self.number, self.number + 1).write.parquet(path)

    @classmethod
    def load(cls, spark, path, city):
        cls.loads.append(path)
        return cls(spark.read.parquet(path).first()["id"])


def test_a_version_is_taken_whole_and_its_models_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "Forecaster", Model)
    Model.loads.clear()
    store = refresh.PriorStore(spark, str(tmp_path / "store"))
    raw = settle(fixture.incidents(spark, "/root/testdata/sf0.001"), "raw")
    spots = features.CoordinateMedians(13.0, 77.5)
    early = features.engineer(raw.where(F.dayofmonth("start_datetime") <= 10), spots)
    store.publish(early, spots, forecaster=Model(1))
    first = store.version()
    before = sorted(map(tuple, first.table("cause_priors").collect()))
    assert first.forecaster().number == first.forecaster().number == 1 and len(Model.loads) == 1
    store.publish(features.engineer(raw, spots), features.CoordinateMedians(12.9, 77.6))
    second = store.version()
    assert second.name != first.name and second.known_until > first.known_until
    assert (second.medians().latitude, first.medians().latitude) == (12.9, 13.0)
    # the version taken before stays what it was
    assert sorted(map(tuple, first.table("cause_priors").collect())) == before
    assert sorted(map(tuple, second.table("cause_priors").collect())) != before
    with pytest.raises(ValueError):
        second.forecaster()


def test_late_counts(spark, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in DELIVERIES:
        land(spark, path, rows)
    jobs.start_late_counts(source(spark, path), out, cp).awaitTermination()
    got = [(r["rows"], r["late_rows"]) for r in spark.read.parquet(out).orderBy("batch_id").collect()]
    assert got == [(2, 0), (2, 0), (2, 1)]


def test_congestion_equals_batch_and_survives_restart(spark, tmp_path):
    path, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in DELIVERIES[:2]:
        land(spark, path, rows)
        # a new query object continues from the checkpoint
        jobs.start_upserts(jobs.congestion_stream(source(spark, path)), out, cp).awaitTermination()
    streamed = jobs.latest_rows(spark.read.parquet(out), "tick", "corridor")
    batch = congestion.congestion_per_tick(spark.read.schema(SCHEMA).parquet(path))
    columns = ["tick", "corridor", "congestion_index", "status", "active_events", "closures"]
    assert sorted(streamed.select(columns).collect()) == sorted(batch.select(columns).collect())
