import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lineward.operators import web as W
from lineward.operators.keyword_scan import line_findings
from lineward.schemas import PAGE, PAGE_STATE
from lineward.sources.delta_state import load_state
from lineward.streaming import jobs as J

KW = ["token", "thing", "nicht"]
PAGES = "/root/testdata/sf0.001/pages.parquet"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Every partition of a stateful stream has workers of its own; small inputs need few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def visits(spark):
    """Two visits: all pages, then two thirds of them, half of these changed."""
    pages, pid = spark.read.parquet(PAGES), F.col("page_id")

    def visit(df, html, day):
        return df.select("url", html.alias("html"), F.lit("").alias("etag"), F.lit("").alias("last_modified"),
                         F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("fetched_at"))

    html = F.col("html")
    changed = F.when(pid % 3 == 1, F.concat(html, F.lit("<p>a token</p>"))).otherwise(html)
    return visit(pages, html, 1), visit(pages.where(pid % 3 != 2), changed, 2)


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_scan_equals_batch(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(scratch + "/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in")
    drain(J.scan_stream(stream, KW).writeStream.format("parquet").option("checkpointLocation", scratch + "/cp")
          .trigger(availableNow=True).start(scratch + "/out"))
    got = spark.read.parquet(scratch + "/out")
    want = line_findings(docs, KW)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()


def test_changes(spark, scratch, visits):
    def run():
        stream = J.detect_changes(J.read_pages(spark, scratch + "/in", PAGE))
        drain(stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch + "/cp")
              .trigger(availableNow=True).start(scratch + "/out"))
        return {(r.status, r.day): r["count"] for r in spark.read.parquet(scratch + "/out").groupBy(
            "status", F.dayofmonth("fetched_at").alias("day")).count().collect()}

    first, second = visits
    first.write.parquet(scratch + "/in")
    assert run() == {("new", 1): 50}
    second.write.mode("append").parquet(scratch + "/in")
    assert run() == {("new", 1): 50, ("changed", 2): 17, ("not_modified", 2): 17}


def test_versions_within_one_trigger(spark, scratch):
    rows = [("u", "a", "", "", 1), ("u", "a", "", "", 2), ("u", "b", "e1", "", 3), ("u", None, None, None, 4), ("u", "c", "e1", "", 5),
            ("v", None, None, None, 1), ("v", "x", "", "", 2)]
    pages = spark.createDataFrame(rows, "url string, html string, etag string, last_modified string, t int").select(
        "url", "html", "etag", "last_modified", F.timestamp_seconds("t").alias("fetched_at"))
    pages.write.parquet(scratch + "/in")
    stream = J.detect_changes(J.read_pages(spark, scratch + "/in", PAGE))
    drain(stream.writeStream.format("parquet").option("checkpointLocation", scratch + "/cp").trigger(availableNow=True)
          .start(scratch + "/out"))
    got = [(r.url, r.status) for r in spark.read.parquet(scratch + "/out").orderBy("url", "fetched_at").collect()]
    assert got == [("u", "new"), ("u", "not_modified"), ("u", "changed"), ("u", "new"), ("u", "not_modified"), ("v", "new"), ("v", "new")]


def test_expired_urls_are_new_again(spark, scratch):
    """By fetch times, within a trigger and across triggers; what is seen in time is kept alive."""
    schema = "url string, html string, etag string, last_modified string, t long"

    def visit(rows):
        pages = spark.createDataFrame([(u, h, "", "", t) for u, h, t in rows], schema)
        pages.select("url", "html", "etag", "last_modified", F.timestamp_seconds("t").alias("fetched_at")).write.mode("append").parquet(scratch + "/in")
        stream = J.detect_changes(J.read_pages(spark, scratch + "/in", PAGE), timedelta(days=10))
        drain(stream.writeStream.format("parquet").option("checkpointLocation", scratch + "/cp").trigger(availableNow=True).start(scratch + "/out"))
        return {(r.url, r.t): r.status for r in spark.read.parquet(scratch + "/out").select("url", F.unix_seconds("fetched_at").alias("t"), "status").collect()}

    day = 86_400
    first = visit([("a", "x", 0), ("a", "x", 9 * day), ("a", "x", 18 * day), ("b", "x", 0), ("b", "x", 11 * day), ("c", "x", day)])
    assert first == {("a", 0): "new", ("a", 9 * day): "not_modified", ("a", 18 * day): "not_modified", ("b", 0): "new", ("b", 11 * day): "new", ("c", day): "new"}
    second = visit([("a", "y", 27 * day), ("b", "x", 30 * day), ("c", "x", 11 * day), ("c", "z", 40 * day)])
    assert {k: v for k, v in second.items() if k not in first} == {
        ("a", 27 * day): "changed", ("b", 30 * day): "new", ("c", 11 * day): "not_modified", ("c", 40 * day): "new"}


def test_many_pages_in_time(spark, scratch):
    """State is handed over with the rows of many pages; value by value a few hundred pages took minutes."""
    spark.range(600).select(F.col("id").cast("string").alias("url"), F.lit("x").alias("html"), F.lit("").alias("etag"), F.lit("").alias("last_modified"),
                            F.timestamp_seconds(F.lit(1)).alias("fetched_at")).write.parquet(scratch + "/in")
    begun = time.time()
    stream = J.detect_changes(J.read_pages(spark, scratch + "/in", PAGE))
    drain(stream.writeStream.format("parquet").option("checkpointLocation", scratch + "/cp").trigger(availableNow=True).start(scratch + "/out"))
    assert spark.read.parquet(scratch + "/out").where("status = 'new'").count() == 600 and time.time() - begun < 40


def test_versions_in_order(monkeypatch):
    """More versions than are held, out of order and with equal times."""
    monkeypatch.setattr(J, "_HELD", 7)
    times = [(i * 37) % 20 for i in range(60)]
    got = list(J._in_order((t, f"h{t}", "", None) for t in times))
    assert [r[:2] for r in got] == sorted((t, i) for i, t in enumerate(times)) and all(r[2] == f"h{r[0]}" for r in got)
    assert list(J._in_order([])) == []


def test_state_goes_after_its_time(spark, scratch):
    def visit():
        page = spark.createDataFrame([("a", "x", "", "")], "url string, html string, etag string, last_modified string")
        page.withColumn("fetched_at", F.timestamp_seconds(F.lit(0))).write.mode("append").parquet(scratch + "/in")
        stream = J.detect_changes(J.read_pages(spark, scratch + "/in", PAGE), timedelta(seconds=4))
        drain(stream.writeStream.format("parquet").option("checkpointLocation", scratch + "/cp").trigger(availableNow=True).start(scratch + "/out"))
        return sorted(r.status for r in spark.read.parquet(scratch + "/out").collect())

    assert visit() == ["new"]
    time.sleep(6)
    assert visit() == ["new", "new"]


def test_incremental_scan_equals_batch(spark, scratch, visits):
    state = spark.createDataFrame([], PAGE_STATE)
    for number, visit in enumerate(visits):
        visit.write.mode("append").parquet(scratch + "/in")
        stream = J.read_pages(spark, scratch + "/in", PAGE)
        drain(J.incremental_scan_stream(stream, KW, scratch + "/state", scratch + "/found")
              .option("checkpointLocation", scratch + "/cp").trigger(availableNow=True).start())
        scanned = W.rescan(W.classify(visit, state), KW).checkpoint()
        want = W.incremental_findings(scanned)
        got = spark.read.parquet(scratch + "/found").where(F.col("batch") == number).select(want.columns)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()
        state = W.upsert_state(state, scanned).checkpoint()
        stored = load_state(spark, scratch + "/state", PAGE_STATE)
        assert stored.select(state.columns).exceptAll(state).isEmpty() and stored.count() == 50


def test_copies(spark, scratch):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 3)], "id int, md5 string, t int")
    assert {(r.md5, r.id) for r in J.first_of_each(df, "id").collect()} == {("a", 1), ("b", 3)}
    for i in (0, 1):
        df.withColumn("time", F.timestamp_seconds("t")).write.mode("append").parquet(scratch + "/in")
    schema = "id int, md5 string, t int, time timestamp"
    for time, name in ((None, "plain"), ("time", "timed")):
        stream = J.dedupe_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(scratch + "/in"), time=time)
        drain(stream.writeStream.format("parquet").option("checkpointLocation", f"{scratch}/cp-{name}").trigger(availableNow=True)
              .start(f"{scratch}/{name}"))
        assert sorted(r.md5 for r in spark.read.parquet(f"{scratch}/{name}").collect()) == ["a", "b"]
