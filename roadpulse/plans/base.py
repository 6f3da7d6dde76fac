"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from roadpulse.operators import dispatch, feed, features
from roadpulse.operators.recommend import recommend
from roadpulse.session import prepare
from roadpulse.sources import fixture


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.incidents(prepare(spark), sf_dir)


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.engineer(raw_incidents(spark, sf_dir))


def unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineered rows for queries that read no place: coordinates outside the city stay empty, no medians are fitted."""
    return features.engineer(raw_incidents(spark, sf_dir), features.CoordinateMedians(None, None))


def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engineered(spark, sf_dir)
    return feed.add_lifetime(rows, feed.cause_priors(rows))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engineered rows with stand-in forecasts and their deployment plan."""
    return recommend(fixture.pseudo_forecasts(engineered(spark, sf_dir)))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planned(spark, sf_dir)
    cells, per_axis = dispatch.station_cells(dispatch.station_directory(rows))
    return dispatch.dispatch_orders(rows, cells, per_axis)


def six(column) -> Column:
    """Six decimals, so that engines with different math libraries agree."""
    return F.round(column, 6)


def stamp(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
