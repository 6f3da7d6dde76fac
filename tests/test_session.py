"""Session settings must not change results, nor may scratch data land on one machine."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

from roadpulse.functions import temporal
from roadpulse.session import check_one_machine, settle, spread


@pytest.mark.parametrize("zone", ["America/New_York", "Pacific/Auckland"])
def test_local_clock_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = spark.createDataFrame([("2024-01-10 13:30:00",), ("2024-03-10T02:15:00.25Z",), ("2024-03-10 07:45:00+05:30",), ("2024-06-01",), ("no",)], "s string")
        at = texts.select(temporal.parse_utc(F.col("s"), T.StringType()).alias("t"))
        rows = at.select(F.unix_micros("t"), temporal.local_text(F.col("t")), *[c.alias(n) for n, c in temporal.clock_columns(F.col("t")).items()],
                         temporal.local_date(F.col("t")).cast("string"), temporal.holiday_gap(F.col("t")) >= 0,
                         F.unix_micros(temporal.shift_start(temporal.local_date(F.col("t"))))).collect()
        assert [r[0] for r in rows] == [1704893400000000, 1710036900250000, 1710036900000000, 1717200000000000, None]
        assert [r[1] for r in rows] == ["2024-01-10 19:00:00", "2024-03-10 07:45:00.250000", "2024-03-10 07:45:00", "2024-06-01 05:30:00", None]
        assert [(r["hour"], r["dow"], r["month"], r["is_peak"]) for r in rows[:2]] == [(19, 2, 1, 1), (7, 6, 3, rows[1]["is_peak"])]
        assert rows[0][7] == "2024-01-10" and rows[0][9] == 1704850200000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            check_one_machine(master)
    check_one_machine("local")
    check_one_machine("local[8]")


def test_many_small_rows_are_spread_over_tasks(spark):
    few, many = (settle(spark.range(0, n, 1, 1), "ids") for n in (100, 120_000))
    assert spread(few) is few
    wide = spread(many)
    assert wide.rdd.getNumPartitions() >= 3
    assert wide.agg(F.count("id"), F.sum("id"), F.count_distinct("id")).first() == many.agg(
        F.count("id"), F.sum("id"), F.count_distinct("id")).first()
