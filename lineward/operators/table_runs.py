"""Scan of many tables of which some may fail while they are read: the others come out whole."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.operators import tables as T
from lineward.session import ensure_checkpoint_dir

DONE, FAILED = "done", "failed"


@dataclass
class TableRun:
    """status: source_id, table, status, error, a row for each table. findings and stats of the tables that are done."""

    status: DataFrame
    findings: DataFrame
    stats: DataFrame

    def totals(self) -> DataFrame:
        """Counters over all tables that could be read; a database counts if one of its tables did."""
        done = self.status.where(F.col("status") == DONE)
        reached = done.agg(F.count_distinct("source_id").alias("total_databases"))
        lost = self.status.agg(F.count_if(F.col("status") == FAILED).alias("failed_tables"))
        # One row each.
        return T.totals(self.stats).join(reached, F.lit(True)).join(lost, F.lit(True))


def _scan(spec: T.TableSpec, keywords: list[str], folder: str, how: dict) -> str | None:
    """Write findings and statistics of a table; the error if it fails, in which case neither counts."""
    context = spec.df.sparkSession.sparkContext
    group = f"{folder}/{spec.name}"
    context.setJobGroup(group, f"scan of {spec.source_id} {spec.name}", interruptOnCancel=False)
    try:
        T.database_findings([spec], keywords, **how).write.mode("overwrite").parquet(f"{folder}/findings")
        T.database_stats([spec], keywords, **how).write.mode("overwrite").parquet(f"{folder}/stats")
        return None
    except Exception as e:  # what failed is reported, and the others go on
        context.cancelJobGroup(group)
        return _told(e)


def _told(e: Exception) -> str:
    """Type and first line of an error, of the one in the JVM where there is one."""
    inner = getattr(e, "java_exception", None)
    text = inner.toString() if inner is not None else f"{type(e).__name__}: {e}"
    return text.strip().split("\n")[0][:500]


def scan_each(spark: SparkSession, specs: list[T.TableSpec], keywords: list[str], at_once: int = 4, **how) -> TableRun:
    """Scan every table as jobs of its own group, ``at_once`` tables side by side.

    A plan over all tables would end with the first that can't be read. Here a table's results are written when it is
    done, and united from the tables that are.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    folders = [f"{root}/{i}" for i in range(len(specs))]
    # One wrapper for each table: the session's properties, the job group among them, are copied when it is made.
    scans = [inheritable_thread_target(spark)(_scan) for _ in specs]
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        errors = list(pool.map(lambda x: x[0](x[1], keywords, x[2], how), zip(scans, specs, folders)))
    status = spark.createDataFrame(
        [(s.source_id, s.name, FAILED if e else DONE, e) for s, e in zip(specs, errors)], "source_id string, table string, status string, error string")
    done = [f for f, e in zip(folders, errors) if not e]

    def united(kind: str, empty: DataFrame) -> DataFrame:
        return spark.read.parquet(*[f"{f}/{kind}" for f in done]) if done else empty.where(F.lit(False))

    return TableRun(status, united("findings", T.database_findings(specs, keywords, **how)), united("stats", T.database_stats(specs, keywords, **how)))
