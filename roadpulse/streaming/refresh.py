"""Scheduled recomputation of priors and models, published as versions a running stream picks up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from roadpulse.config import CityConfig, DEFAULT_CITY
from roadpulse.learning.forecaster import Forecaster
from roadpulse.operators import dispatch, feed, lookups
from roadpulse.operators.features import CoordinateMedians
from roadpulse.session import concurrently

_INDEX = ("version string, per_axis int, latitude double, longitude double, published_at timestamp, "
          "known_until timestamp, with_models boolean")


class PriorVersion:
    """All that was learned and published together. Its tables never change."""

    def __init__(self, store: "PriorStore", row: Row):
        self._store, self._row = store, row
        self.name, self.known_until = row["version"], row["known_until"]
        self._base = f"{store.path}/versions/{self.name}"

    def table(self, name: str) -> DataFrame:
        return self._store.spark.read.parquet(f"{self._base}/{name}")

    def cells(self) -> tuple[DataFrame, int]:
        return self.table("cells"), self._row["per_axis"]

    def medians(self) -> CoordinateMedians:
        return CoordinateMedians(self._row["latitude"], self._row["longitude"])

    def forecaster(self, city: CityConfig = DEFAULT_CITY) -> Forecaster:
        """The models of this version, read once however many batches ask for them."""
        if not self._row["with_models"]:
            raise ValueError(f"version {self.name} was published without a forecaster")
        held = self._store.held_models
        if held is None or held[:2] != (self.name, city):
            held = (self.name, city, Forecaster.load(self._store.spark, f"{self._base}/forecaster", city))
            self._store.held_models = held
        return held[2]


class PriorStore:
    """Versioned folder of fitted state: medians, priors, reference tables, station cells, models.

    A version becomes visible only by the row appended to the index after all of
    its tables are written; readers never see a half-written version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self.held_models: tuple | None = None   # of the version last asked for

    def publish(self, engineered: DataFrame, medians: CoordinateMedians,
                city: CityConfig = DEFAULT_CITY, forecaster: Forecaster | None = None) -> str:
        version = uuid.uuid4().hex
        base = f"{self.path}/versions/{version}"

        def stations() -> int:
            cells, per_axis = dispatch.station_cells(dispatch.station_directory(engineered, city), city)
            cells.write.parquet(f"{base}/cells")
            return per_axis

        per_axis, *_ = concurrently(
            self.spark, stations,
            lambda: feed.cause_priors(engineered).write.parquet(f"{base}/cause_priors"),
            lambda: lookups.reference_tables(engineered, city).write.parquet(f"{base}/reference"),
            lambda: lookups.density_counts(engineered).write.parquet(f"{base}/densities"))
        if forecaster is not None:
            forecaster.save(self.spark, f"{base}/forecaster")
        engineered.agg(F.max("start_datetime").alias("known_until")).select(
            F.lit(version).alias("version"), F.lit(per_axis).cast("int").alias("per_axis"),
            F.lit(medians.latitude).cast("double").alias("latitude"),
            F.lit(medians.longitude).cast("double").alias("longitude"),
            F.current_timestamp().alias("published_at"), "known_until",
            F.lit(forecaster is not None).alias("with_models")).write.mode("append").parquet(f"{self.path}/index")
        return version

    def version(self) -> PriorVersion:
        """The newest version. Take everything a batch needs from this one object."""
        index = self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")
        row = index.orderBy(F.desc("published_at"), "version").first()
        if row is None:
            raise ValueError(f"nothing published in {self.path}")
        return PriorVersion(self, row)

    def table(self, name: str) -> DataFrame:
        return self.version().table(name)

    def cells(self) -> tuple[DataFrame, int]:
        return self.version().cells()

    def medians(self) -> CoordinateMedians:
        return self.version().medians()
