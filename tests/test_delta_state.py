"""State as a base and changes: visits, replays, compaction, removal."""

import os
import random

from lineward.sources import delta_state as D
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("n", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def frame(spark, rows):
    return spark.createDataFrame([(u, n, [str(n)]) for u, n in rows], SCHEMA)


def content(spark, path, **how):
    return {r["url"]: r["n"] for r in D.load_state(spark, path, SCHEMA, **how).collect()}


def folders(path):
    return sorted(n for n in os.listdir(path) if n != "manifest")


def files_of(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_random_visits(spark, scratch):
    path, rng, expected, history = f"{scratch}/s", random.Random(6), {}, {}
    assert content(spark, path) == {} and D.versions(spark, path) == []
    for step in range(9):
        put = {f"u{rng.randrange(60)}": step * 1000 + i for i in range(rng.randint(0, 12))}
        gone = {f"u{rng.randrange(60)}" for _ in range(4)}
        version = D.save_changes(frame(spark, put.items()), path, removed=frame(spark, [(u, 0) for u in gone]), buckets=8)
        expected = {**{u: n for u, n in expected.items() if u not in gone}, **put}
        history[version] = dict(expected)
        assert content(spark, path) == expected
        if step % 3 == 2:
            history[D.compact(spark, path, SCHEMA)] = dict(expected)
            assert content(spark, path) == expected
    for version, rows in history.items():  # older versions read as they were
        assert content(spark, path, before=version + 1) == rows
    D.remove_old(spark, path)
    assert content(spark, path) == expected and len(D.versions(spark, path)) == 2


def test_a_visit_writes_touched_buckets_only(spark, scratch):
    path = f"{scratch}/s"
    D.save_changes(frame(spark, [(f"u{i}", i) for i in range(500)]), path, buckets=16)
    D.compact(spark, path, SCHEMA)
    before = files_of(path)
    version = D.save_changes(frame(spark, [("u7", -1)]), path)
    assert len(D._buckets_in(spark, f"{path}/change-{version:012d}")) == 1
    compacted = D.compact(spark, path, SCHEMA)
    assert len(D._buckets_in(spark, f"{path}/base-{compacted:012d}")) == 1
    after = files_of(path)
    assert all(after[f] == t for f, t in before.items()) and content(spark, path)["u7"] == -1 and len(content(spark, path)) == 500
    manifest = D.read_manifest(spark, path, compacted)
    assert len(manifest.base) == 16 and sorted(set(manifest.base.values())) == [2, compacted]
    # Only the bucket of the key is read.
    assert len(content(spark, path, keys=frame(spark, [("u7", 0)]))) < 100 and content(spark, path, keys=frame(spark, [("u7", 0)]))["u7"] == -1
    assert D.remove_old(spark, path, keep=1) == ["change-000000000001", "change-000000000003"]
    assert len(content(spark, path)) == 500


def test_replay(spark, scratch):
    path = f"{scratch}/s"
    D.save_changes(frame(spark, [("a", 1), ("b", 1)]), path, version=10)
    D.save_changes(frame(spark, [("a", 2)]), path, version=12)
    # The same batch again: complete versions stay, whatever comes in.
    assert D.save_changes(frame(spark, [("a", 99)]), path, version=12) == 12 and content(spark, path) == {"a": 2, "b": 1}
    # A batch that ended before its manifest: its data are written anew and count once.
    os.remove(f"{path}/manifest/{12:012d}")
    assert content(spark, path) == {"a": 1, "b": 1}
    D.save_changes(frame(spark, [("a", 3)]), path, version=12)
    assert content(spark, path) == {"a": 3, "b": 1} and content(spark, path, before=12) == {"a": 1, "b": 1}


def test_all_rows_of_a_bucket_removed(spark, scratch):
    path = f"{scratch}/s"
    D.save_changes(frame(spark, [("a", 1)]), path)
    D.save_changes(frame(spark, []), path, removed=frame(spark, [("a", 0), ("never", 0)]))
    assert content(spark, path) == {}
    D.compact(spark, path, SCHEMA)
    assert content(spark, path) == {} and D.compact(spark, path, SCHEMA) == 3
    D.remove_old(spark, path, keep=1)
    assert folders(path) == [] and content(spark, path) == {}
