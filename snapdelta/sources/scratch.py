"""Files that a run writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else (in local mode, as in tests) a new local folder."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        # with its scheme, as readers outside Spark don't know the cluster's default file system
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
        whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = "file://" + tempfile.mkdtemp(prefix="snapdelta-")
    return _local_root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends (if nothing has deleted it before)."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_quietly(spark: SparkSession, path: str) -> None:
    """At the driver's end its JVM may be gone already; then the folder stays for the cluster's own cleaning."""
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001
        pass
