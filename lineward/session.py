"""Session set-up shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "lineward", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for.

    Partition counts are left to adaptive execution: a generous initial number of shuffle
    partitions is coalesced at run time, so the same code fits a laptop and a large cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors; Python functions of a plan are found there by module name."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="run-"), "lineward"), "zip", root, "lineward")
    spark.sparkContext.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, taken from the session.

    ``spark.checkpoint.dir`` wins. Only a local session without that setting gets a scratch
    folder; on a cluster the folder has to be shared, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()
