"""A skip index over Parquet files: which files can't hold a fuzzy match need not be read.

A keyword matches only if each of its characters is followed by the next one within three places. The index holds
for each file the set of such pairs that occur in it, letter case ignored, as bitmaps of hashed pairs. It is built in
one pass over arrays of characters, a task keeps one bitmap at a time, stored beside the data, and consulted before the scan.
"""

from __future__ import annotations

import zlib
from functools import lru_cache, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.functions import keywords as K
from lineward.operators.keyword_scan import line_findings

#: Bits of a file's set, a power of two; a bitmap of Spark holds 32,768 of them.
BITS = 1 << 20
_BUCKET = 1 << 15
#: Characters whose pairs are looked at together.
_CHUNK = 1 << 18
#: Names the way pairs are hashed too: an index of another way is not found.
_FOLDER = "_skip_index_2"


def _folded(c: str) -> str:
    """One character for the variants of a letter. Only makes sets smaller: both sides of every test go through it."""
    return c.upper().lower()


@lru_cache(maxsize=1)
def _hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every code point, folded: as the first of a pair, as the second, and alone."""
    code = np.arange(0x110000, dtype=np.uint64)
    for i in range(0x20000):  # no letter behind has case
        if not 0xD800 <= i < 0xE000 and (f := _folded(chr(i))) != chr(i):
            code[i] = ord(f) if len(f) == 1 else 0x200000 + zlib.crc32(f.encode())

    def mixed(seed: int) -> np.ndarray:
        x = code + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)

    return mixed(0x9E3779B97F4A7C15), mixed(0x3C6EF372FE94F82A), mixed(0xDAA66D2C7DDF743F)


def _places(hashed: np.ndarray) -> np.ndarray:
    return hashed >> np.uint32(33 - BITS.bit_length())


def _bit(a: str, b: str) -> int:
    """Place of a pair of characters, or of a single one if ``b`` is empty."""
    first, second, alone = _hashes()
    hashed = first[[ord(a)]] + second[[ord(b)]] if b else alone[[ord(a)]]
    return int(_places(hashed)[0])


def _mark(seen: np.ndarray, texts: list[str]) -> None:
    """Set the flags of the characters of the texts and of their pairs at most MAX_GAP others apart."""
    first, second, alone = _hashes()
    # Line feeds keep lines too far apart for pairs.
    apart = "\n" * (K.MAX_GAP + 1)
    whole = apart.join(texts).replace("\n", apart)
    for at in range(0, len(whole), _CHUNK):
        points = np.frombuffer(whole[at:at + _CHUNK + K.MAX_GAP + 1].encode("utf-32-le"), "<u4")
        seen[_places(alone[np.flatnonzero(np.bincount(points))])] = True
        a, b = first[points], second[points]
        for d in range(1, K.MAX_GAP + 2):
            seen[_places(a[:-d] + b[d:])] = True


def _bitmaps(batches):
    """Rows of (file, size, changed, text) to (file, size, changed, bucket, bits): the bitmaps that hold anything, one at least."""
    key, seen = None, np.zeros(BITS, bool)

    def rows():
        bits = np.packbits(seen, bitorder="little").reshape(-1, _BUCKET // 8)
        some = np.flatnonzero(bits.any(axis=1))
        some = some if len(some) else np.zeros(1, np.int64)
        columns = [*(pa.repeat(k, len(some)) for k in key), pa.array(some, pa.int64()), pa.array([bits[i].tobytes() for i in some], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["file", "size", "changed", "bucket", "bits"])

    for batch in batches:
        number = batch.column(0).dictionary_encode().indices.to_numpy()
        new = np.flatnonzero(np.append(True, number[1:] != number[:-1])[:len(number)]).tolist()
        for low, high in zip(new, [*new[1:], len(number)]):
            own = [batch.column(i)[low] for i in range(3)]
            if own != key:
                if key is not None:
                    yield rows()
                key = own
                seen[:] = False
            held, size = [], 0
            for t in batch.column(3)[low:high]:
                held.append((t.as_py() or b"").decode("utf-8", "replace"))
                size += len(held[-1])
                if size > _CHUNK:
                    _mark(seen, held)
                    held, size = [], 0
            _mark(seen, held)
    if key is not None:
        yield rows()


def build_index(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """Index the Parquet files below ``path`` and store the index there; returns it.

    A row for each file and bitmap: file, size and time of change, bucket, bits. A task hands on the bitmaps of a file's
    part that it has read, and these are united.
    """
    rows = spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("changed"), F.col(text).cast("string").cast("binary").alias("_text"))
    parts = rows.mapInArrow(_bitmaps, "file string, size bigint, changed timestamp, bucket bigint, bits binary")
    index = parts.groupBy("file", "size", "changed", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    index.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_FOLDER}")
    return spark.read.parquet(f"{path.rstrip('/')}/{_FOLDER}")


def _needs(keyword: str) -> list[list[tuple[str, str]]]:
    """For each step of a keyword the pairs of which one has to occur, for all variants of its characters."""
    if len(keyword) == 1:
        return [[(v, "") for v in K.case_variants(keyword)]]
    return [[(a, b) for a in K.case_variants(x) for b in K.case_variants(y)] for x, y in zip(keyword, keyword[1:])]


def possible_files(index: DataFrame, keywords: list[str]) -> DataFrame:
    """(file, size, changed) of the indexed files that may hold a match of some keyword."""
    wanted = {pair: i for i, pair in enumerate(sorted({p for k in keywords if k for step in _needs(k) for p in step}))}
    columns = ["file", "size", "changed"]
    if not wanted:
        return index.select(columns).where(F.lit(False))
    # A row for each different pair of the keywords.
    bits = [_bit(a, b) for a, b in wanted]
    place = index.sparkSession.createDataFrame(pa.table({
        "id": pa.array(wanted.values(), pa.int32()), "bucket": pa.array([b // _BUCKET for b in bits], pa.int64()), "at": pa.array([b % _BUCKET for b in bits], pa.int64())}))
    byte = F.conv(F.hex(F.substr("bits", F.expr("cast(at div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    there = index.join(F.broadcast(place), "bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0)
    have = there.groupBy(columns).agg(F.collect_set("id").alias("have"))

    def step_holds(step: list[tuple[str, str]]) -> Column:
        return F.arrays_overlap("have", F.array(*[F.lit(wanted[p]) for p in step]))

    tests = [reduce(and_, map(step_holds, _needs(k))) for k in keywords if k]
    return have.where(reduce(or_, tests)).select(columns)


def pruned_read(spark: SparkSession, path: str, keywords: list[str]) -> DataFrame:
    """The rows of the files below ``path`` that may hold a match.

    A file that the index doesn't know, or knows with another size or time of change, is read. Names of files are what the
    driver has to know for any scan.
    """
    whole = spark.read.parquet(path)
    index = spark.read.parquet(f"{path.rstrip('/')}/{_FOLDER}")
    now = whole.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
                       F.col("_metadata.file_modification_time").alias("changed")).distinct()
    known = index.select("file", "size", "changed").distinct()
    keep = now.join(known, ["file", "size", "changed"], "left_anti").unionByName(now.join(possible_files(index, keywords), ["file", "size", "changed"], "left_semi"))
    files = sorted(r["file"] for r in keep.select("file").toLocalIterator())
    return spark.read.schema(whole.schema).parquet(*files) if files else whole.where(F.lit(False))


def indexed_findings(spark: SparkSession, path: str, columns: list[str], keywords: list[str], text: str = "text") -> DataFrame:
    """Line findings of the indexed files, only those read that may hold one."""
    return line_findings(pruned_read(spark, path, keywords).select(*columns, text), keywords, text)
