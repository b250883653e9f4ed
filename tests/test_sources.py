import os

import pandas as pd
import pytest

from lineward.operators import files as L
from lineward.schemas import OCR_CACHE, PAGE_STATE
from lineward.sources import inventory as N
from lineward.sources import jdbc as J
from lineward.sources import state as St


def tree(root):
    for path, data in {"a.txt": b"token", "sub/b.TXT": b"x", "sub/deep/c.zip": b"z", "sub/deep/.h.txt": b"token hid",
                       ".hidden/d.txt": b"token", "skip.bin": b"b", ".dot": b"h", "_under.txt": b"token", "sub/e f.txt": b"y"}.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)
    os.symlink(root, os.path.join(root, "sub", "loop"))


def test_inventory(spark, scratch):
    tree(scratch)
    files, missing = N.file_inventory(spark, f"{scratch}; /no/such/folder ;")
    rows = {r.path[len(scratch) + 1:]: r for r in files.collect()}
    assert missing == ["/no/such/folder"]
    assert set(rows) == {"a.txt", "sub/b.TXT", "sub/deep/c.zip", "sub/deep/.h.txt", ".hidden/d.txt", ".dot", "_under.txt", "sub/e f.txt"}
    assert {p for p, r in rows.items() if r.is_hidden} == {"sub/deep/.h.txt", ".dot"}
    assert rows["sub/deep/c.zip"].is_archive and rows["a.txt"].size == 5 and rows["sub/b.TXT"].ext == ".txt"
    assert N.file_inventory(spark, ["/no/such"])[0].count() == 0


def test_entries_that_cannot_be_read_lose_no_others(spark, scratch):
    tree(scratch)
    os.symlink("/no/such/file.txt", os.path.join(scratch, "link.txt"))
    files, _ = N.file_inventory(spark, scratch)
    rows = {r.path[len(scratch) + 1:]: r for r in files.collect()}
    assert {"a.txt", "_under.txt", ".dot", "sub/b.TXT", "link.txt"} <= set(rows)
    assert rows["link.txt"].error.startswith("FileNotFoundError") and rows["link.txt"].size is None and rows["a.txt"].error is None
    gone = pd.DataFrame({"root": [scratch], "path": [scratch + "/gone"]})
    assert [len(f) for f in N._list_all(iter([gone]))] == [1]


def test_contents(spark, scratch):
    tree(scratch)
    plain = {r.path[len(scratch) + 1:]: bytes(r.content) for r in N.read_binary(spark, scratch, [".txt"]).collect()}
    plain = {p: c for p, c in plain.items() if "loop" not in p}
    assert plain == {"a.txt": b"token", "sub/b.TXT": b"x", "sub/e f.txt": b"y"}
    files, _ = N.file_inventory(spark, scratch)
    every = N.read_files(spark, scratch, files, [".txt"])
    assert every.count() == 6
    found = L.findings(L.with_status(L.extract(L.with_types(every))), ["token"])
    assert sorted(r.path[len(scratch) + 1:] for r in found.collect()) == [".hidden/d.txt", "_under.txt", "a.txt", "sub/deep/.h.txt"]


def test_state_versions(spark, scratch):
    path = scratch + "/state"
    assert St.load_state(spark, path, OCR_CACHE).count() == 0
    one = spark.createDataFrame([("m1", [("t", 0.9, "top")])], OCR_CACHE)
    assert St.save_state(one, path)[0]
    again = St.load_state(spark, path, OCR_CACHE)
    ok, where = St.save_state(again.unionByName(spark.createDataFrame([("m2", [])], OCR_CACHE)), path)
    assert ok and St.load_state(spark, path, OCR_CACHE).count() == 2 and St.versions(spark, path) == [1, 2]
    assert St.load_state(spark, path, OCR_CACHE, before=2).count() == 1
    os.remove(where + "/_SUCCESS")
    assert St.load_state(spark, path, OCR_CACHE).count() == 1
    open(where + "/_SUCCESS", "w").close()
    for name in os.listdir(where):
        if name.endswith(".parquet"):
            with open(f"{where}/{name}", "wb") as f:
                f.write(b"not parquet")
    assert St.load_state(spark, path, OCR_CACHE).count() == 1


def test_state_that_cannot_be_saved(spark):
    ok, message = St.save_state(spark.createDataFrame([], PAGE_STATE), "/proc/no/such/place")
    assert not ok and message


def test_connections():
    got = J.connection("mysql", "shop", "db:3306", user="u")
    assert got["url"] == "jdbc:mysql://db:3306/shop" and got["user"] == "u" and "mysql" in got["driver"]
    with pytest.raises(ValueError, match="unknown database kind"):
        J.connection("oracle", "x")


def test_system_databases_are_left_out(spark):
    names = spark.createDataFrame([("MySQL",), ("shop",), ("sys",)], "name string")
    assert [r.name for r in J.list_databases(names, "mysql").collect()] == ["shop"]
    assert J.list_databases(names, "sqlite").count() == 3
    assert "default" in J.catalog_databases(spark) and J.catalog_databases(spark, ["DEFAULT"]) == []
