"""SparkSession helper.

ANSI mode stays on (Spark 4 default); operators use ``try_divide`` / ``nullif``
where a zero denominator is legal input.  Time zone is pinned to UTC so that
datetime features are identical on every executor.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "tabloom") -> SparkSession:
    """Local/test session.  On a cluster, use the session the platform gives you."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    parts = shuffle_partitions or int(os.environ.get("TABLOOM_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.locality.wait", os.environ.get("TABLOOM_LOCALITY_WAIT", "0s"))
        .config("spark.driver.memory", os.environ.get("TABLOOM_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; without it we refuse to run.  Only a
    local session (one machine, as in tests) gets a scratch folder of its own.
    """
    current = spark.conf.get(_CKPT_KEY, None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{_CKPT_KEY} is not set: intermediates need a folder that the driver and all "
                               "executors share")
        current = tempfile.mkdtemp(prefix="tabloom-ckpt-", dir="/tmp")
        spark.conf.set(_CKPT_KEY, current)
    try:  # classic sessions: also register it for RDD checkpoints; Connect sessions have no context
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001
        pass
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def materialize(df, name: str, file_rows: int = 0):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (recovery reads the files instead of
    recomputing upstream joins) but computes the plan only once, and the re-read
    table carries file statistics for the optimizer.  ``file_rows`` bounds the rows of a
    file (0: no bound), so that few writers leave work for many readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings every query relies on, applied to a session we did not create.

    Timestamps in the data are zone-less; converting them to epochs or comparing
    them with literals must not depend on the caller's zone, so the session zone
    is pinned to UTC.  The shared checkpoint folder is taken from the session
    (set only when absent).
    """
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark
