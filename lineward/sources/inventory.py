"""Directory trees: a listing job that sees every file, and the reading of file contents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.functions import files as P
from lineward.session import ensure_checkpoint_dir

_COLUMNS = ["root", "path", "is_dir", "size", "error"]
_ENTRY = "root string, path string, is_dir boolean, size long, error string"
_ROWS = 5000


def parse_roots(roots: str | list[str]) -> list[str]:
    """Roots as a list; a string holds several separated by semicolons."""
    parts = roots.split(";") if isinstance(roots, str) else roots
    return [p.strip() for p in parts if p.strip()]


def _local(path: str) -> str | None:
    """Path on a mounted file system, or None for an address of another store."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return unquote(url.path) if url.scheme else path
    return None


def _entries(folder: str) -> Iterator[tuple[str, bool, int | None, str | None]]:
    """Path, whether it is a folder, size, and why the entry can't be read, of everything in a folder."""
    local = _local(folder)
    if local is not None:
        with os.scandir(local) as found:
            for e in found:
                try:
                    is_dir = e.is_dir(follow_symlinks=False)
                    yield e.path, is_dir, 0 if is_dir else e.stat().st_size, None
                except OSError as error:  # a link to nothing, for example: the others still count
                    yield e.path, False, None, f"{type(error).__name__}: {error.strerror}"
        return
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(base)] if folder.endswith(base) else ""
    for info in store.get_file_info(fs.FileSelector(base)):
        yield prefix + info.path, info.type == fs.FileType.Directory, info.size or 0, None


def _exists(folder: str) -> bool:
    local = _local(folder)
    if local is not None:
        return os.path.isdir(local)
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    return store.get_file_info(base).type == fs.FileType.Directory


def _list_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for root, folder in zip(pdf["root"], pdf["path"]):
            try:
                for entry in _entries(folder):
                    rows.append((root, *entry))
                    if len(rows) == _ROWS:
                        yield _frame(rows)
                        rows = []
            except OSError as error:  # a folder that vanished or is closed to us
                rows.append((root, folder, False, None, f"{type(error).__name__}: {error.strerror}"))
        if rows:
            yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype({"size": "Int64"})


def file_inventory(spark: SparkSession, roots: str | list[str],
                   exts: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Files under the roots, and the roots that do not exist.

    One job per directory level, in which the folders are listed in parallel. Supported types are
    kept, and hidden files whatever their type. What can't be read, a folder or an entry, is a row with its
    ``error`` and no size. Each level is checkpointed, so a folder is listed once.
    """
    ensure_checkpoint_dir(spark)
    wanted = exts or P.DOCUMENT_EXTS + P.ARCHIVE_EXTS
    listed = parse_roots(roots)
    missing = [r for r in listed if not _exists(r)]
    present = [(r, r) for r in listed if r not in missing]
    folders = spark.createDataFrame(present, "root string, path string")
    levels = []
    while present:
        entries = folders.repartition(spark.sparkContext.defaultParallelism).mapInPandas(
            _list_all, _ENTRY).checkpoint()
        levels.append(entries.where("not is_dir").select("root", "path", "size", "error"))
        folders = entries.where("is_dir").select("root", "path")
        if folders.isEmpty():
            break
    if not levels:
        levels = [spark.createDataFrame([], "root string, path string, size long, error string")]
    files = reduce(DataFrame.unionByName, levels).withColumn("ext", P.ext(F.col("path")))
    typed = files.withColumns({
        "is_hidden": P.is_hidden(F.col("path")), "is_archive": F.col("ext").isin(P.ARCHIVE_EXTS),
        "route": P.route(F.col("ext"))})
    return typed.where(F.col("ext").isin(wanted) | F.col("is_hidden") | F.col("error").isNotNull()), missing


def _any_case(ext: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def read_binary(spark: SparkSession, roots: str | list[str], exts: list[str]) -> DataFrame:
    """``path, size, content`` of the files with the given extensions under the roots.

    The source leaves out names that start with a dot or an underscore; ``read_listed`` reads
    these from an inventory.
    """
    pattern = "*{" + ",".join(map(_any_case, exts)) + "}"
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(parse_roots(roots)))
    return found.select(
        F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), "content")


def _read_all(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for row in pdf.itertuples(index=False):
            local = _local(row.path)
            try:
                if local is not None:
                    with open(local, "rb") as f:
                        data = f.read()
                else:
                    from pyarrow import fs

                    store, base = fs.FileSystem.from_uri(row.path)
                    with store.open_input_stream(base) as f:
                        data = f.read()
            except OSError:  # reported as a file without content
                data = None
            yield pd.DataFrame({"path": [row.path], "size": [row.size], "content": [data]})


def read_listed(inventory: DataFrame) -> DataFrame:
    """``path, size, content`` of inventoried files whatever their name, one file at a time."""
    return inventory.select("path", "size").mapInPandas(
        _read_all, "path string, size long, content binary")


def read_files(spark: SparkSession, roots: str | list[str], inventory: DataFrame,
               exts: list[str]) -> DataFrame:
    """Contents of all inventoried files of the given types, hidden names included.

    The inventory decides what is read, so files reached again through links are left out.
    """
    skipped = F.col("path").rlike(r"/[._][^/]*(/|\z)")
    wanted = inventory.where(F.col("ext").isin(exts)).select("path", "size")
    plain = read_binary(spark, roots, exts).join(wanted.where(~skipped).select("path"), "path", "left_semi")
    return plain.unionByName(read_listed(wanted.where(skipped)))
