"""The live path as Structured Streaming jobs.

Each function takes and returns a (streaming or static) DataFrame, so the batch
operators are reused unchanged; ``start_*`` functions attach a sink.

Ticks carry the event time: an arrival belongs to the tick in whose window
(t-1, t] it was reported, and the watermark is set on that tick. Active ticks lie
up to one maximal lifetime ahead of the report, so their watermark waits that much
longer before a tick's state is final.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from roadpulse.config import CLOSURE_FLAG, CityConfig, DEFAULT_CITY
from roadpulse.operators import congestion, dispatch, feed, features
from roadpulse.operators.features import CoordinateMedians
from roadpulse.streaming.refresh import PriorStore

LATENESS_MINUTES = 60
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def engineered_stream(raw: DataFrame, medians: CoordinateMedians, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Row-wise features on an unbounded feed; the medians come from history."""
    return feed.started(features.engineer(raw, medians, city))


def arrivals(rows: DataFrame, lateness_minutes: int = LATENESS_MINUTES,
             city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Each reported id once, tagged with its arrival tick.

    Identifiers are remembered only as long as the watermark allows repeats. A report without
    an id repeats nothing, so every such row is kept.
    """
    ticked = arrival_ticks(rows, city)
    named = ticked.where(F.col("id").isNotNull()).withWatermark("tick", f"{lateness_minutes} minutes")
    return named.dropDuplicatesWithinWatermark(["id"]).unionByName(ticked.where(F.col("id").isNull()))


def arrival_ticks(rows: DataFrame, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    return feed.with_tick_instant(feed.with_arrival_tick(rows, city), city)


def once_per_id(rows: DataFrame) -> DataFrame:
    """The first row of every id over the stream's whole life; rows without an id are all kept.

    The ids seen are the stream's keyed state, one flag each: a batch looks up only the ids it
    brings, however many came before, and a restart resumes from the checkpointed state.
    """
    named = rows.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    return named.unionByName(rows.where(F.col("id").isNull()))


def arrival_counts(rows: DataFrame, lateness_minutes: int = LATENESS_MINUTES,
                   city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Reports per tick window (left-open, right-closed)."""
    ticked = arrival_ticks(rows, city)
    if ticked.isStreaming:
        ticked = ticked.withWatermark("tick", f"{lateness_minutes} minutes")
    return ticked.groupBy("tick").agg(F.count(F.lit(1)).alias("new_events"))


def congestion_stream(rows: DataFrame, lateness_minutes: int = LATENESS_MINUTES,
                      city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Congestion per tick and corridor over rows that carry ``sim_end``."""
    narrow = rows.select("start_datetime", "sim_end", "corridor", CLOSURE_FLAG, "is_peak")
    ticks = feed.with_tick_instant(feed.active_ticks(narrow, city), city)
    if ticks.isStreaming:
        wait = int(city.lifetime_range[1]) + lateness_minutes
        ticks = ticks.withWatermark("tick", f"{wait} minutes")
    return congestion.corridor_congestion(ticks, "tick", city=city)


def orders_stream(rows: DataFrame, forecast: Callable[[DataFrame], DataFrame], cells: DataFrame,
                  per_axis: int, city: CityConfig = DEFAULT_CITY) -> DataFrame:
    """Forecast every new event and address its order to the nearest station."""
    carry = tuple(c for c in ("tick_no",) if c in rows.columns)
    return dispatch.dispatch_orders(forecast(rows), cells, per_axis, city=city, carry=carry)


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def start_upserts(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch's changed rows under its own id.

    A replayed batch overwrites its own folder, so restarts never duplicate rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(path, batch_id))

    return (stream.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def latest_rows(changes: DataFrame, *keys: str) -> DataFrame:
    """Current state of an upsert log: the last batch's row of every key."""
    values = [c for c in changes.columns if c not in (*keys, "batch_id")]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, "_v.*")


@contextmanager
def _disk_state(spark: SparkSession):
    """Queries started inside keep their state on disk (RocksDB), so it may outgrow the executors' memory."""
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_PROVIDER)
        else:
            spark.conf.set(STATE_PROVIDER, before)


def start_orders(arrived: DataFrame, forecast: Callable[[DataFrame], DataFrame],
                 directory: Callable[[], tuple[DataFrame, int]], path: str, checkpoint: str,
                 per_tick: int | None = None, city: CityConfig = DEFAULT_CITY,
                 lateness_minutes: int = LATENESS_MINUTES, **trigger) -> StreamingQuery:
    """Cap, forecast, route and log the events of each batch.

    ``directory`` is asked anew for every batch, so refreshed priors take effect
    without a restart. An id gets one order over the stream's life (``once_per_id``); the
    log is written and never read. ``per_tick`` limits the orders of a tick over all
    batches (``None`` dispatches every event); within a batch the newest come first.
    """
    def orders(chosen: DataFrame) -> DataFrame:
        cells, per_axis = directory()
        return orders_stream(chosen, forecast, cells, per_axis, city)

    return _start_order_log(arrived, orders, path, checkpoint, per_tick, city, lateness_minutes, trigger)


def start_refreshed_orders(reported: DataFrame, store: PriorStore, path: str, checkpoint: str,
                           forecast: Callable[[DataFrame], DataFrame] | None = None, known: Column | None = None,
                           per_tick: int | None = None, city: CityConfig = DEFAULT_CITY,
                           lateness_minutes: int = LATENESS_MINUTES, **trigger) -> StreamingQuery:
    """Orders from raw reports with everything learned taken from the newest published version.

    A batch asks the store once and takes all of that version: coordinate medians, cause
    priors, station cells and, unless ``forecast`` is given, the forecaster. A version
    published while the stream runs is in force from the next batch on, with no restart, and
    no batch mixes two versions. Each order says which one it came from (``version``, and
    ``known_until``, the newest start in its history) and how long the event will stay on the
    feed: ``known`` (the forecast median where not given), else the version's cause median.
    A replayed batch overwrites its orders, possibly from a newer version than before.
    """
    def orders(chosen: DataFrame) -> DataFrame:
        version = store.version()
        cells, per_axis = version.cells()
        rows = features.engineer(chosen, version.medians(), city)
        planned = (forecast or version.forecaster(city).forecast)(rows)
        live = feed.add_lifetime(planned, version.table("cause_priors"), city, F.col("p50") if known is None else known)
        routed = dispatch.dispatch_orders(live, cells, per_axis, city=city, carry=("tick_no", "sim_duration_min", "sim_end"))
        return routed.withColumns({"version": F.lit(version.name), "known_until": F.lit(version.known_until).cast("timestamp")})

    arrived = arrival_ticks(feed.started(features.parse_timestamps(reported)), city)
    return _start_order_log(arrived, orders, path, checkpoint, per_tick, city, lateness_minutes, trigger)


def _start_order_log(arrived: DataFrame, orders_of: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                     per_tick: int | None, city: CityConfig, lateness_minutes: int, trigger: dict) -> StreamingQuery:
    """Log ``orders_of`` the chosen rows of each batch.

    Beside the log, each batch leaves the orders given to every tick that is still open and
    the newest tick so far, and reads those of the batch before. Ticks older than the
    lateness are closed: they leave that table, and a capped stream orders nothing for them.
    So a batch costs the same however long the stream has run. A replayed batch overwrites
    what it wrote.
    """
    spark = arrived.sparkSession
    ticks = f"{path}/_open_ticks"    # readers of the log skip names with an underscore
    schema = "tick_no bigint, orders bigint, newest bigint"
    open_span = -(-lateness_minutes // city.tick_minutes)

    def write(batch: DataFrame, batch_id: int) -> None:
        given = spark.read.schema(schema).parquet(_batch_path(ticks, batch_id - 1)) if batch_id > 0 else spark.createDataFrame([], schema)
        if per_tick is not None:
            closed = given.agg(F.max("newest").alias("newest")).first()["newest"]  # one row a tick of the open span
            if closed is not None:
                batch = batch.where(F.col("tick_no") > closed - open_span)
        chosen = feed.newest_per_tick(batch, per_tick, given)
        orders_of(chosen).write.mode("overwrite").parquet(_batch_path(path, batch_id))
        issued = spark.read.schema("tick_no bigint").parquet(_batch_path(path, batch_id))
        counts = issued.groupBy("tick_no").agg(F.count(F.lit(1)).alias("orders")).withColumn("newest", F.col("tick_no"))
        counts = given.unionByName(counts).groupBy("tick_no").agg(F.sum("orders").alias("orders"), F.max("newest").alias("newest"))
        newest = counts.agg(F.max("newest").alias("newest")).first()["newest"]
        counts.where(F.col("tick_no") > (newest or 0) - open_span).withColumn("newest", F.lit(newest).cast("bigint")).coalesce(1).write.mode("overwrite").parquet(_batch_path(ticks, batch_id))

    with _disk_state(spark):
        return (once_per_id(arrived).writeStream.outputMode("append").foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def start_late_counts(rows: DataFrame, path: str, checkpoint: str,
                      lateness_minutes: int = LATENESS_MINUTES, city: CityConfig = DEFAULT_CITY,
                      **trigger) -> StreamingQuery:
    """Side table of rows that came too late for the watermark, per batch.

    ``max_tick`` is the newest tick of this and all earlier batches. It is read back from
    the row of the batch before, so a batch costs the same however long the stream has
    run, and the count is right after a restart as well.
    """
    spark = rows.sparkSession
    ticked = arrival_ticks(rows, city)
    schema = "rows bigint, late_rows bigint, max_tick timestamp"

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id > 0:
            newest = spark.read.schema(schema).parquet(_batch_path(path, batch_id - 1)).first()["max_tick"]
        seen = F.lit(newest).cast("timestamp")
        limit = seen - F.make_dt_interval(mins=F.lit(lateness_minutes))
        batch.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(F.col("tick") <= limit).alias("late_rows"),
                  F.greatest(F.max("tick"), seen).alias("max_tick")).write.mode("overwrite").parquet(_batch_path(path, batch_id))

    return (ticked.writeStream.outputMode("append").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
