"""Keyed state as versioned Parquet directories, and the sinks of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineward.session import ensure_checkpoint_dir

_PREFIX = "version="


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    """Versions of a state, oldest first; complete ones carry Spark's success mark."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return []
    jvm, found = spark.sparkContext._jvm, []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        mark = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith(_PREFIX) and (not complete or fs.exists(mark)):
            found.append(int(name[len(_PREFIX):]))
    return sorted(found)


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/{_PREFIX}{version:012d}"


def load_state(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Latest readable complete version; an empty frame when there is none.

    ``before`` restricts to older versions, for a batch that runs again after a failure.
    """
    for version in reversed(versions(spark, path)):
        if before is not None and version >= before:
            continue
        try:
            spark.read.parquet(version_path(path, version)).schema
        except Exception:  # damaged: an older version, or none, takes its place
            continue
        return spark.read.schema(schema).parquet(version_path(path, version))
    return spark.createDataFrame([], schema)


def save_state(df: DataFrame, path: str, version: int | None = None) -> tuple[bool, str]:
    """Write the next version beside those being read. A failure is returned, not raised."""
    spark = df.sparkSession
    try:
        if version is None:
            version = max(versions(spark, path, complete=False), default=0) + 1
        df.write.mode("overwrite").parquet(version_path(path, version))
        return True, version_path(path, version)
    except Exception as e:  # the run's results are still good without the state
        return False, f"{type(e).__name__}: {e}"


def write_findings(findings: DataFrame, path: str, run_id: str) -> None:
    """Append a run's findings, partitioned by module and run; writing a run again replaces it.

    Partitions of very different size are balanced by adaptive execution before the write.
    """
    (
        findings.withColumn("run_id", F.lit(run_id)).hint("rebalance", "module")
        .write.partitionBy("module", "run_id").mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").parquet(path))


def write_markdown(report: DataFrame, path: str) -> None:
    """Write report lines in order, as text files whose names sort in reading order.

    Lines are placed by ranges of section and number; they are never gathered in one task.
    """
    report.repartitionByRange("section", "seq").sortWithinPartitions("section", "seq").select("line").write.mode(
        "overwrite").text(path)
