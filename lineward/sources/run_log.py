"""Runs of several modules that can be taken up again where they ended.

A module's results are written first and its record last, in one move; a record means that its results are whole.
When all modules are done the records go, so that the next run starts anew, in a folder of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p = make(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, make


def completed(spark: SparkSession, path: str) -> dict[str, str]:
    """Modules of the unfinished run with the folders of their results."""
    fs, p, _ = _fs(spark, f"{path.rstrip('/')}/log")
    out = {}
    for status in fs.listStatus(p) if fs.exists(p) else []:
        name = status.getPath().getName()
        if not name.startswith("_"):
            stream = fs.open(status.getPath())
            out[name] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return out


def _record(spark: SparkSession, path: str, module: str, folder: str) -> None:
    fs, target, make = _fs(spark, f"{path.rstrip('/')}/log/{module}")
    part = make(f"{path.rstrip('/')}/log/_{module}")
    out = fs.create(part, True)
    out.write(bytearray(folder.encode()))
    out.close()
    fs.rename(part, target)


def run_modules(spark: SparkSession, path: str, modules: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """The results of all modules; those that an earlier, unfinished run completed are read and not worked out again.

    An error of a module ends the run; what was done before stays. Names of modules are names of files.
    """
    done = completed(spark, path)
    for name, work in modules.items():
        if name not in done:
            folder = f"{path.rstrip('/')}/results/{uuid.uuid4().hex}"
            work().write.parquet(folder)
            _record(spark, path, name, folder)
            done[name] = folder
    results = {name: spark.read.parquet(done[name]) for name in modules}
    clear(spark, path)
    return results


def clear(spark: SparkSession, path: str) -> None:
    """Forget what was completed; results stay where they are."""
    fs, p, _ = _fs(spark, f"{path.rstrip('/')}/log")
    if fs.exists(p):
        fs.delete(p, True)
