import os
import unicodedata

from pyspark.sql import functions as F

from lineward.functions import display as D
from lineward.operators import report as R
from lineward.sources.state import write_findings, write_markdown


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.v for r in df.select("i", expr(F.col("s")).alias("v")).orderBy("i").collect()]


def width(s):
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def test_texts(spark):
    assert column(spark, ["a\r\nb|c", "x" * 39 + "||", None], D.sanitize) == ["a b\\|c", "x" * 39 + "\\|", None]
    assert column(spark, ["a, b", "a,b,c,d,e", "a, b,c, ,d,e,f", ""], D.trim_keywords) == [
        "a, b", "a,b,c,d,e", "a, b, c, d, e and more, 6 in all", ""]
    samples = ["abc", "机密", "（ﾊ）", "😀x", "é", ""]
    assert column(spark, samples, D.visual_width) == [width(s) for s in samples]


def by_hand(path, limit=40):
    """Path shortening as described, one character at a time."""
    def head(s, room):
        out = ""
        for c in s:
            if width(out + c) > room:
                break
            out += c
        return out

    if width(path) <= limit:
        return path
    name, prefix = path.rsplit("/", 1)[-1], head(path, 14)
    budget = limit - width(prefix) - 4
    if width(name) > budget:
        dot = name.rfind(".")
        if dot > 0:
            name = head(name[:dot], max(budget - width(name[dot:]), 2) - 1) + "~" + name[dot:]
        else:
            name = name[:max(budget - 1, 2)] + "~"
    return f"{prefix}/.../{name}"


def test_paths(spark):
    samples = ["/short/a.txt", "/a" * 20, "/a" * 20 + "b", "/dir/" * 9 + "name.docx", "/d/" + "n" * 50 + ".docx", "/d/" + "n" * 50,
               "/文件夹/很长的目录名称/再来一个目录/文件名很长很长很长很长很长.docx", "/d/" * 20 + "." + "h" * 40, "/d/x." + "e" * 60,
               "noslash" * 10, "/机" * 30 + "密.txt"]
    assert column(spark, samples, D.truncate_path) == [by_hand(s) for s in samples]


def test_encrypted_list(spark):
    reg = spark.createDataFrame([("/b", ".docx", "decrypted", 0), ("/a", ".zip", "failed", None), ("/c", ".pdf", "decrypted", 2),
                                 ("/d", ".pdf", "skipped", None), ("/e", ".pdf", "encrypted", None)], "path string, ext string, status string, matched long")
    got = [tuple(r) for r in R.encrypted_list(reg).orderBy("seq").collect()]
    assert got == [(1, "/a", "ZIP", "not decrypted", "-"), (2, "/b", "DOCX", "decrypted", "0 findings"),
                   (3, "/c", "PDF", "decrypted", "2 findings"), (4, "/d", "PDF", "skipped", "-"), (5, "/e", "PDF", "not handled", "-")]


def test_absent_modules_show_zero(spark):
    counts = spark.createDataFrame([("web", "total", 5), ("web", "matched_pages", 2), ("web", "cached_matched", 1),
                                    ("web", "skipped", 0), ("web", "new_pages", 4)], "module string, counter string, n long")
    got = {r.module: (r.checked, r.matched, r.note) for r in R.summary(counts, "engine").collect()}
    assert got == {"web": (5, 3, "4 new or changed"), "db": (0, 0, "-"), "file": (0, 0, "-"), "image": (0, 0, "OCR: engine")}
    assert R.grand_total(R.summary(counts)).first().matched == 3


def test_document_is_written_in_order(spark, scratch):
    counts = spark.createDataFrame([("file", "supported_files", 2), ("file", "matched_files", 1)], "module string, counter string, n long")
    found = spark.createDataFrame([(f"/d/{i:04d}.txt", 1, "a|b", "token", ".txt") for i in range(300)],
                                  "path string, line_no int, content string, keyword string, file_type string")
    hidden = spark.createDataFrame([("/d/.h",)], "path string")
    doc = R.document(["token"], "2024-01-01 00:00:00", R.summary(counts), file=found, hidden=hidden)
    write_markdown(doc, scratch + "/out")
    parts = sorted(p for p in os.listdir(scratch + "/out") if p.startswith("part"))
    lines = "".join(open(f"{scratch}/out/{p}", encoding="utf-8").read() for p in parts).split("\n")
    assert lines[0] == "# Keyword scan" and "300 findings" in lines
    numbers = [int(x.split("|")[1]) for x in lines if x.startswith("| ") and x.split("|")[1].strip().isdigit()]
    assert numbers == list(range(1, 301))
    heads = [x for x in lines if x.startswith("## ")]
    assert [h[3] for h in heads] == ["1", "2", "3", "4", "5"]
    assert "1. `/d/.h`" in lines and "No damaged files." in lines and "Matches over all modules: 1" in lines
    assert "| 1 | /d/0000.txt | 1 | .txt | token | a\\|b |" in lines


def test_findings_sink_replaces_a_run(spark, scratch):
    docs = spark.createDataFrame([("p", 1, "c", "k")], "path string, line_no int, content string, keyword string")
    frame = R.as_findings(docs, "file", "path")
    for run in ("r1", "r2", "r2"):
        write_findings(frame, scratch + "/f", run)
    back = spark.read.parquet(scratch + "/f")
    assert sorted(r.run_id for r in back.collect()) == ["r1", "r2"] and back.first().container == "p"
