"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lineward.session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Characters that are handled together in numpy; bounds the memory of a task, not what it reads.
CHUNK_CHARS = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at once.
BATCH_BYTES = 1 << 22
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, its lineage cut."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, a null text as empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def bounded_sample(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` rows, by a hash of their key; all rows if there are no more.

    The share to keep comes from a count, so that about as many rows as are wanted leave the tasks, however
    many tasks there are.
    """
    share = most / max(1, df.count())
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(20_240_607), key), 11) / float(1 << 53)
    chosen = df if share >= 1 else df.where(unit < 0.95 * share)
    return chosen.orderBy(F.xxhash64(key), *df.columns).limit(most)


def chunks(sizes: list[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to ``limit`` at most; a single larger one stands alone."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def in_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` in batches of about BATCH_BYTES, which the task's JVM and its worker each hold.

    The setting stays in the session, as Spark reads it when the result is computed. One that the session has already
    is kept. A row that is larger comes in a batch of its own.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_texts(df: DataFrame, fn: Callable[[pa.Array, list[str]], dict], schema: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """Apply ``fn(doc_ids, texts) -> columns`` to the rows of ``texts_of``, ``limit`` characters at a time."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks([len(t) for t in texts], limit):
                yield pa.RecordBatch.from_pydict(fn(ids.slice(a, b - a), texts[a:b]))

    return in_batches(df.select("doc_id", "text"), run, schema)


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable, for every node of an edge.

    Alternates two steps on a table of edges until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller ones. A node's neighbours are never gathered:
    its minimum comes from an aggregate that combines before the shuffle, and is joined to its edges.
    The number of rounds grows with the logarithm of the longest path. Null ends are left out.
    """
    edges = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
             .where("u <> v").distinct())
    edges = written(edges, "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    last = None
    while True:
        # Large star: both directions, larger neighbours go to the smallest of the closed neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # Small star: smaller neighbours and the node itself go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return nodes.join(edges, nodes["node"] == edges["u"], "left").select(
        "node", F.coalesce("v", "node").alias("component"))


#: Groups that hold at least one row in this many are sent to all tasks; there are no more of them than this.
HOT_SHARE = 1000


def joined_to_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``groups``, which has one row for each key with its number ``n`` of rows.

    ``total`` is the number of ``rows``. A group that holds a thousandth of them or more is joined where its rows
    are: there can be HOT_SHARE such groups at most, whatever the input. The others meet by a shuffle, where
    none of them is more than a thousandth. Keys without a null.
    """
    hot = F.broadcast(groups.where(F.col(n) * HOT_SHARE >= total))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(groups.where(F.col(n) * HOT_SHARE < total), keys, "left"))


#: Bits of the filter by which rows are told to have no partner; 64 of them are a row, all rows go to all tasks.
FILTER_BITS = 1 << 24


def with_partner(rows: DataFrame, partners: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows that may have one of ``partners``; with ``left_anti`` those that have none for certain.

    One bit a key, by its hash, so that long rows without a partner needn't be shuffled to learn that. The filter has
    FILTER_BITS at any size: with more keys fewer rows are told, and the join that has to follow decides on all others.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    place, mask = F.shiftright(bit, 6), F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    words = partners.select(bit.alias("_bit")).select(F.shiftright("_bit", 6).alias("_word"), mask.alias("_mask")).groupBy(
        "_word").agg(F.bit_or("_mask").alias("_bits"))
    marked = rows.withColumn("_bit", bit).withColumns({"_place": place, "_mask": mask})
    same = (F.col("_place") == F.col("_word")) & (F.col("_bits").bitwiseAND(F.col("_mask")) != 0)
    return marked.join(F.broadcast(words), same, how).drop("_bit", "_place", "_mask")


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    store, path = pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://"))
    return store, path.rstrip("/")
