"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every transformation relies on."""
    for key, value in SESSION_DEFAULTS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (``local`` masters) may go
    without that setting; it gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    check_one_machine(spark.sparkContext.master)
    local = spark.conf.get("roadpulse.scratch", None)
    if not local:
        local = tempfile.mkdtemp(prefix="roadpulse-")
        spark.conf.set("roadpulse.scratch", local)
    return local


def check_one_machine(master: str) -> None:
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path in the shared folder."""
    return f"{shared_dir(spark)}/roadpulse/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and gives the
    optimizer the true size of the result: it is then broadcast exactly when it
    is below ``spark.sql.autoBroadcastJoinThreshold``, and sort-merge joined
    (with adaptive skew splitting) when it is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(settled: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """The settled table in files enough for its rows.

    Compressed rows are far smaller than what it costs to learn from them, and one file is
    one task: a table of millions of rows in a few megabytes would leave most cores idle.
    """
    wanted = -(-settled.count() // rows_per_task)
    if wanted <= max(settled.rdd.getNumPartitions(), 1):
        return settled
    return settle(settled.repartition(wanted), "spread")


def concurrently(spark: SparkSession, *tasks: Callable[[], object]) -> list:
    """Run independent jobs at the same time, results in order.

    Model fits are chains of short jobs; overlapping them keeps the executors busy.
    """
    with ThreadPoolExecutor(max_workers=max(len(tasks), 1)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
        return [r.result() for r in running]
