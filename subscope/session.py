"""Spark session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "subscope", extra: dict | None = None) -> SparkSession:
    """Session for tests, bench and local runs.

    On a cluster, pass the cluster's master and let ``spark.sql.shuffle.partitions``
    follow the data (AQE coalesces small partitions and splits skewed ones).
    """
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("SUBSCOPE_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_LOCAL_CKPT: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster sets it, or else the folder a program has
    given to ``setCheckpointDir``. Only on a local master (tests, a laptop) is a local folder
    created instead, once per SparkContext; on a cluster the executors would each write to
    their own disk, so there it is an error.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    path = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_CKPT.get(key) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="subscope-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path
