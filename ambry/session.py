"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK_DIRS: dict[str, str] = {}


def local_session(app: str = "ambry", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("AMBRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A cluster names it in ``spark.checkpoint.dir``; one that does not is an
    error. Where all runs in one process (tests, a laptop) we make one of our own.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = _FALLBACK_DIRS.get(sc.applicationId)
        if base is None:
            if not (sc.getCheckpointDir() or sc.master.startswith("local") and "cluster" not in sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
            base = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="ambry-")
            _FALLBACK_DIRS[sc.applicationId] = base
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables written by a job."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and forget how it was made.

    The rows go to the shared folder, so losing an executor costs nothing and
    iterative jobs keep a short lineage.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
