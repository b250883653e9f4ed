"""Streaming forms of the scan: stateless findings, change detection, removal of copies."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lineward.operators import web as W
from lineward.operators.keyword_scan import line_findings
from lineward.schemas import PAGE_STATE
from lineward.session import ensure_checkpoint_dir
from lineward.sources import delta_state as D


def scan_stream(stream: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """Findings of arriving documents; row-wise, so it runs in append mode without state."""
    return line_findings(stream, keywords, text)


_STATE = "content_hash string, etag string, last_modified string, seen long"
_CHANGE = "url string, at long, content_hash string, status string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Versions of one page that are held and handed on together.
_HELD = 20_000


def _in_order(versions: Iterable[tuple]) -> Iterator[tuple]:
    """(at, arrival, content_hash, etag, last_modified) of the versions of a page by time and arrival; more than
    _HELD of them are sorted by parts, which wait in the task's own temporary file."""
    held, runs = [], []
    with tempfile.TemporaryFile() as file:
        for arrival, (at, *version) in enumerate(versions):
            held.append((at, arrival, *version))
            if len(held) == _HELD:
                runs.append(file.tell())
                for row in sorted(held, key=_place):
                    pickle.dump(row, file)
                held = []
        ends = [*runs[1:], file.tell()]
        yield from heapq.merge(sorted(held, key=_place), *(_read(file, a, b) for a, b in zip(runs, ends)), key=_place)


def _place(row: tuple) -> tuple:
    return row[:2]


def _read(file, at: int, end: int) -> Iterator[tuple]:
    while at < end:
        file.seek(at)
        row = pickle.load(file)
        at = file.tell()
        yield row


class _Tracker:
    """Follows the versions of one page in fetch order, one at a time."""

    most: int | None = None

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        versions = (v for pdf in frames for v in zip(pdf["at"].tolist(), pdf["content_hash"], pdf["etag"], pdf["last_modified"]))
        last, out = tuple(state.get) if state.exists else None, []
        for at, _, *version in _in_order(versions):
            status, last = self._judge(at, version, last)
            out.append((key[0], at, version[0], status))
            if len(out) == _HELD:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)
        if last is not None:
            state.update(last)

    def _judge(self, at: int, version: list, last: tuple | None) -> tuple[str, tuple | None]:
        content_hash, etag, modified = version
        if last is not None and self.most is not None and at - last[3] > self.most:
            last = None  # not seen for so long that it is new again
        if last is not None:
            seen = max(at, last[3])
            if (etag and etag == last[1]) or (modified and modified == last[2]) or content_hash == last[0]:
                return W.NOT_MODIFIED, (*last[:3], seen)
        if not content_hash:  # a failed fetch is never stored
            return W.NEW, last
        if last is None:
            return W.NEW, (content_hash, etag, modified, at)
        return W.CHANGED, (content_hash, etag or last[1], modified or last[2], seen)


_COLUMNS = ["url", "at", "content_hash", "status"]


class _ExpiringTracker(_Tracker, StatefulProcessor):
    """The same with a state that goes some time after it was written, which only this kind of state can do without end of a
    run. Its values are read and written by calls, once for a page and trigger."""

    def __init__(self, expire_after: timedelta):
        self.most = expire_after // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE, max(1, self.most // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last = self.last.get() if self.last.exists() else None
        for at, _, *version in _in_order((r.at, r.content_hash, r.etag, r.last_modified) for r in rows):
            status, last = self._judge(at, version, last)
            yield Row(url=key[0], at=at, content_hash=version[0], status=status)
        if last is not None:
            self.last.update(last)

    def close(self) -> None:
        pass


def detect_changes(stream: DataFrame, expire_after: timedelta | None = None) -> DataFrame:
    """``url, fetched_at, content_hash, status`` for every fetched page version.

    The state per url is its last hash, validators and time. Only these short columns are shuffled and kept, never the
    bodies. With ``expire_after`` a url that no version was seen of for longer is new again, by the fetch times of its
    versions; its state goes when that time has passed since it was last written, so the state is bounded by what is alive.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # the store that keeps states out of the heap
    rows = stream.select(
        "url", F.coalesce(F.unix_micros("fetched_at"), F.lit(0).cast("long")).alias("at"), W.content_hash(F.col("html")).alias("content_hash"),
        F.coalesce("etag", F.lit("")).alias("etag"), F.coalesce("last_modified", F.lit("")).alias("last_modified"))
    pages = rows.groupBy("url")
    if expire_after:
        found = pages.transformWithState(_ExpiringTracker(expire_after), _CHANGE, "append", "ProcessingTime")
    else:  # states travel with the rows in Arrow batches
        found = pages.applyInPandasWithState(_Tracker(), _CHANGE, _STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select("url", F.timestamp_micros("at").alias("fetched_at"), "content_hash", "status")


def latest_versions(pages: DataFrame) -> DataFrame:
    """Last fetched version per url, merged before rows are shuffled."""
    others = [c for c in pages.columns if c not in ("url", "fetched_at")]
    best = F.max_by(F.struct("fetched_at", *others), F.col("fetched_at"))
    return pages.groupBy("url").agg(best.alias("_v")).select("url", "_v.*")


def incremental_scan_stream(stream: DataFrame, keywords: list[str], state_path: str,
                            findings_path: str, compact_every: int = 16) -> DataStreamWriter:
    """Incremental page scan per trigger over a state of changes.

    Each batch reads the newest state older than its own version, of which only the buckets that its pages are in,
    and writes the pages it rescanned and its findings under the batch number; a batch that runs again after a
    failure gives the same. Changes are merged into the base after every ``compact_every`` batches, whose versions leave
    room for that. A trigger stands for one visit of the site: of several versions of a page in it the last one
    is scanned; ``detect_changes`` reports every version.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        version = 2 * batch_id + 2
        pages = latest_versions(W.scan_pages(batch, keywords)).checkpoint()
        state = D.load_state(spark, state_path, PAGE_STATE, before=version, keys=pages.select("url"))
        scanned = W.rescan(W.classify(pages, state), keywords).checkpoint()
        W.incremental_findings(scanned).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(findings_path)
        D.save_changes(W.state_changes(scanned), state_path, version=version)
        if (batch_id + 1) % compact_every == 0 and D.versions(spark, state_path)[-1] == version:
            D.compact(spark, state_path, PAGE_STATE)
            D.remove_old(spark, state_path)

    return stream.writeStream.foreachBatch(run)


def first_of_each(df: DataFrame, order: str, key: str = "md5") -> DataFrame:
    """One row per distinct content, the least by ``order``; copies merge before the shuffle."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def dedupe_stream(stream: DataFrame, key: str = "md5", time: str | None = None,
                  delay: str = "1 day") -> DataFrame:
    """Drop contents seen before; with a time column only as far back as the watermark."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def read_pages(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Page snapshots arriving in a landing directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
