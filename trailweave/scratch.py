"""The folder that driver and executors share, and tables that a run leaves in it."""

from __future__ import annotations

import atexit
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()
_SWEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """What the session names in ``spark.checkpoint.dir``.

    Where nothing is set, a folder of this machine serves a local master, whose executors are on it too;
    on a cluster each executor would write to a disk of its own, so there it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's tables below the shared one; it goes when Python ends."""
    base, app = shared_dir(spark), spark.sparkContext.applicationId
    path = f"{base}/trailweave/{app}"
    with _LOCK:
        if path not in _SWEPT:
            _SWEPT.add(path)
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            atexit.register(_delete, fs, at)
    return path


def _delete(fs, at) -> None:
    try:
        fs.delete(at, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone before Python is; then the folder stays
        return


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder of checkpoints that all executors share: this cuts the lineage."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
