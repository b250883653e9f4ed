"""Runs that are taken up again, tables that can't be read, files in one pass, copies in a stream."""

import uuid
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from lineward.operators import file_check as C
from lineward.operators import table_runs as TR
from lineward.operators import tables as T
from lineward.plans import source_queries as SQ
from lineward.plans.registry import Tables
from lineward.sources import run_log as RL


def test_run_log(spark, scratch):
    ran, away = [], [True]

    def module(name):
        def work():
            ran.append(name)
            if name == "b" and away:
                raise ConnectionError("away")
            return spark.range(len(ran)).withColumn("name", F.lit(name))
        return work

    modules = {n: module(n) for n in "abc"}
    with pytest.raises(ConnectionError):
        RL.run_modules(spark, scratch, modules)
    assert ran == ["a", "b"] and list(RL.completed(spark, scratch)) == ["a"]
    away.clear()
    results = RL.run_modules(spark, scratch, modules)
    assert ran == ["a", "b", "b", "c"] and {n: df.count() for n, df in results.items()} == {"a": 1, "b": 3, "c": 4}
    assert RL.completed(spark, scratch) == {}
    assert RL.run_modules(spark, scratch, {"a": module("a")})["a"].count() == 5  # a complete run is not taken up


def test_tables_that_fail_lose_no_others(spark):
    good = spark.createDataFrame([(1, "red bolt"), (2, "none")], "id int, name string")
    bad = good.withColumn("name", F.when(F.col("id") == 2, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("name")))
    specs = [T.TableSpec(f"t{i}", bad if i % 3 == 1 else good, ("id",), True, f"db{i % 2}") for i in range(7)]
    run = TR.scan_each(spark, specs, ["bolt"])
    status = {r["table"]: (r["status"], r["error"]) for r in run.status.collect()}
    assert {n for n, (s, _) in status.items() if s == "failed"} == {"t1", "t4"} and "lost" in status["t4"][1] and status["t0"] == ("done", None)
    assert sorted(r["table"] for r in run.findings.collect()) == ["t0", "t2", "t3", "t5", "t6"]
    totals = run.totals().first()
    assert (totals["total_tables"], totals["total_databases"], totals["failed_tables"], totals["matched_tables"]) == (5, 2, 2, 5)
    none = TR.scan_each(spark, specs[1:2], ["bolt"])
    assert none.findings.count() == 0 and none.totals().first()["total_databases"] == 0


def workbook(text):
    """A workbook with a picture, its strings in the cells and so without the part for shared ones."""
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>{text}</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/media/image1.png", bytes(range(256)) * 48)
    return out.getvalue()


def test_files_in_one_pass(spark):
    inner = BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "a token")
        z.writestr("b.txt", "none")
    files = {"/f/low.xlsx": workbook("token"), "/f/plain.txt": b"one\ntoken", "/f/.hid.txt": b"x", "/f/z.zip": inner.getvalue(), "/f/bad.docx": b"no zip", "/f/x.bin": b"token"}
    frame = spark.createDataFrame([(n, bytearray(c), len(c)) for n, c in files.items()], "path string, content binary, size long")
    check = C.check_files(frame, ["token"], expand=True)
    rows = {r["path"]: (r["status"], r["reason"]) for r in check.files.collect()}
    assert rows["/f/low.xlsx"] == ("damaged", "low_text") and rows["/f/bad.docx"][0] == "damaged" and rows["/f/z.zip"][0] == "ok"
    assert sorted((r["path"], r["line_no"]) for r in check.findings().collect()) == [("/f/low.xlsx", 1), ("/f/plain.txt", 2), ("/f/z.zip", 1)]
    again = check.summary().first().asDict()
    assert again == {"supported_files": 4, "matched_files": 3, "encrypted_files": 0, "damaged_files": 2, "hidden_files": 1, "archives_scanned": 1,
                     "encrypted_archives": 0, "findings": 3}


def test_memory_of_copies_is_bounded(spark, scratch):
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = SQ.dedupe_visits(t).checkpoint()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        kept = {v: p["stateOperators"][0]["numRowsTotal"] for v, p in SQ.dedupe_run(t, f"{scratch}/{uuid.uuid4().hex}", rows)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = rows.where("visit = 1").select("md5").distinct().count()
    halves = rows.where("visit = 4").select("md5").distinct().count()
    assert kept[1] == kept[2] == texts and kept[3] == 0 and kept[4] == halves < texts
