"""Keyed state as a base and changes: a visit writes what it changed and nothing else.

    <path>/manifest/000000000007      which folders make up version 7, as one line of JSON
    <path>/base-000000000004/_bucket=3/...    rows of a bucket, as of the version in the name
    <path>/change-000000000007/_bucket=3/...  rows that version 7 put or removed

A row's bucket is a hash of its key. A version is there when its manifest is, and a manifest is written once,
after its data. Reading takes the last change of each key and the base rows of all other keys. Compaction merges
changes into the base of the buckets they touch; folders that no kept version names are removed afterwards.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_BUCKET, _GONE, _VERSION = "_bucket", "_gone", "_version"


@dataclass
class Manifest:
    """One version: for each bucket the version of its base, and for each change the buckets that it touches."""

    version: int
    key: str
    buckets: int
    base: dict[str, int] = field(default_factory=dict)
    changes: dict[str, list[int]] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def _root(path: str) -> str:
    return path.rstrip("/")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions, oldest first."""
    fs, p, _ = _fs(spark, f"{_root(path)}/manifest")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def read_manifest(spark: SparkSession, path: str, version: int) -> Manifest:
    fs, p, _ = _fs(spark, f"{_root(path)}/manifest/{version:012d}")
    stream = fs.open(p)
    try:
        return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Write a manifest beside its place and move it there: it is whole or not there at all."""
    name = f"{_root(path)}/manifest/{manifest.version:012d}"
    fs, target, to_path = _fs(spark, name)
    part = to_path(f"{_root(path)}/manifest/_{manifest.version:012d}")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    if not fs.rename(part, target):
        raise FileExistsError(f"version {manifest.version} is there already")


def _with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, folder: str) -> None:
    """A folder for each bucket; a bucket's rows are in one task and so in few files."""
    df.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)


def _latest(spark: SparkSession, path: str, before: int | None) -> Manifest | None:
    known = [v for v in versions(spark, path) if before is None or v < before]
    return read_manifest(spark, path, known[-1]) if known else None


def save_changes(changed: DataFrame, path: str, key: str = "url", removed: DataFrame | None = None, version: int | None = None,
                 buckets: int = BUCKETS) -> int:
    """Put the rows of ``changed`` and remove the keys of ``removed``, as the next version; returns its number.

    Only buckets with a changed key are written. One row for each key; a key in both is put. A version that is
    complete already stays as it is, so work that is done again changes nothing; one that was left incomplete is written anew.
    """
    spark = changed.sparkSession
    if version is not None and version in versions(spark, path):
        return version
    last = _latest(spark, path, version)
    version = version if version is not None else (last.version + 1 if last else 1)
    now = Manifest(version, key, last.buckets if last else buckets, dict(last.base) if last else {}, dict(last.changes) if last else {})
    rows = changed.withColumn(_GONE, F.lit(False))
    if removed is not None:
        gone = removed.select(key).distinct().join(changed.select(key), key, "left_anti")
        rows = rows.unionByName(gone.withColumn(_GONE, F.lit(True)), allowMissingColumns=True)
    folder = f"{_root(path)}/change-{version:012d}"
    _write(_with_bucket(rows, key, now.buckets), folder)
    touched = _buckets_in(spark, folder)
    if touched:
        now.changes[str(version)] = touched
    _commit(spark, path, now)
    return version


def _buckets_in(spark: SparkSession, folder: str) -> list[int]:
    fs, p, _ = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}="))


def _read(spark: SparkSession, path: str, schema: T.StructType, folders: dict[str, list[int]]) -> list[DataFrame]:
    """A frame for each folder with the given buckets only."""
    return [spark.read.schema(schema).option("basePath", f"{_root(path)}/{name}").parquet(*[f"{_root(path)}/{name}/{_BUCKET}={b}" for b in own])
            for name, own in sorted(folders.items()) if own]


def _rows(spark: SparkSession, path: str, schema: T.StructType, manifest: Manifest, wanted: set[int] | None = None) -> DataFrame:
    """Rows of a version, with their bucket; of the ``wanted`` buckets only, if given."""
    base: dict[str, list[int]] = {}
    for bucket, version in manifest.base.items():
        if wanted is None or int(bucket) in wanted:
            base.setdefault(f"base-{version:012d}", []).append(int(bucket))
    full = T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])
    changed = T.StructType([*schema.fields, T.StructField(_GONE, T.BooleanType()), T.StructField(_BUCKET, T.IntegerType())])
    rows = spark.createDataFrame([], full)
    for more in _read(spark, path, full, base):
        rows = rows.unionByName(more)
    changes = None
    for version, own in manifest.changes.items():
        own = [b for b in own if wanted is None or b in wanted]
        for more in _read(spark, path, changed, {f"change-{int(version):012d}": own}):
            more = more.withColumn(_VERSION, F.lit(int(version)))
            changes = more if changes is None else changes.unionByName(more)
    if changes is None:
        return rows
    others = [c for c in changes.columns if c not in (_VERSION, manifest.key)]
    last = changes.groupBy(manifest.key).agg(F.max_by(F.struct(*others), _VERSION).alias("_row")).select(manifest.key, "_row.*")
    untouched = rows.join(changes.select(manifest.key).distinct(), manifest.key, "left_anti")
    return untouched.unionByName(last.where(~F.col(_GONE)).drop(_GONE))


def load_state(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The rows of the newest version (older than ``before``); an empty frame when there is none.

    With ``keys`` only the buckets that these keys are in are read; the result holds at least their rows.
    """
    manifest = _latest(spark, path, before)
    if manifest is None:
        return spark.createDataFrame([], schema)
    wanted = None
    if keys is not None:  # at most as many rows as there are buckets
        wanted = {r[0] for r in _with_bucket(keys.select(manifest.key), manifest.key, manifest.buckets).select(_BUCKET).distinct().collect()}
    return _rows(spark, path, schema, manifest, wanted).select(schema.names)


def compact(spark: SparkSession, path: str, schema: T.StructType) -> int | None:
    """Merge the changes into the base, as a version of its own with equal rows; buckets without changes stay as they are."""
    last = _latest(spark, path, None)
    if last is None or not last.changes:
        return last.version if last else None
    touched = {b for own in last.changes.values() for b in own}
    version = last.version + 1
    _write(_rows(spark, path, schema, last, touched), f"{_root(path)}/base-{version:012d}")
    there = set(_buckets_in(spark, f"{_root(path)}/base-{version:012d}"))  # a bucket may have lost all its rows
    base = {b: v for b, v in last.base.items() if int(b) not in touched} | {str(b): version for b in sorted(there)}
    _commit(spark, path, Manifest(version, last.key, last.buckets, base, {}))
    return version


def remove_old(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the newest ``keep`` versions, and folders that none of those needs; returns their names.

    Folders newer than the last version belong to one that is being written and stay. Manifests go first: what is
    cut off leaves folders that the next removal takes.
    """
    every = versions(spark, path)
    kept = [read_manifest(spark, path, v) for v in every[-keep:]]
    fs, p, to_path = _fs(spark, path)
    if not kept:
        return []
    for v in every[:-keep]:
        fs.delete(to_path(f"{_root(path)}/manifest/{v:012d}"), False)
    needed = {f"base-{v:012d}" for m in kept for v in m.base.values()} | {f"change-{int(v):012d}" for m in kept for v in m.changes}
    gone = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        kind, _, number = name.partition("-")
        if kind in ("base", "change") and name not in needed and int(number) <= every[-1]:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)
