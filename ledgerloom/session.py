"""Session defaults and the few session-level helpers jobs need."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # N:1 attach joins feed straight into projections; let AQE split a hot key
    # even when that costs one more exchange further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # checkpoints go when nothing reads them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and runs on one machine; a cluster without the
    setting is refused, as executors cannot see each other's local folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _OWN_FOLDER
    if _OWN_FOLDER is None:
        _OWN_FOLDER = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
    return _OWN_FOLDER


_OWN_FOLDER: str | None = None


def split_shuffles(spark: SparkSession, tasks: int) -> None:
    """Shuffles start with ``tasks`` partitions at least; adaptive execution joins small ones again."""
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if tasks > now:
        spark.conf.set(first, str(tasks))


def drop_finished(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that nothing can read any more: it notices them when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with no lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
