import io
import struct
import zipfile

from pyspark.sql import functions as F

from lineward.functions import files as P
from lineward.operators import extract as E
from lineward.operators import file_check as C
from lineward.operators import files as L

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def pack(entries, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def lock(data):
    """Set the encryption flag of the first entry in the directory."""
    at = data.rindex(b"PK\x01\x02") + 8
    return data[:at] + struct.pack("<H", struct.unpack("<H", data[at:at + 2])[0] | 1) + data[at + 2:]


def docx(text):
    body = f"<w:document {W}><w:body><w:p><w:r><w:t>{text}</w:t><w:tab/><w:t>end</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p>" \
           "<w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>last</w:t></w:r></w:p></w:body></w:document>"
    return pack({"[Content_Types].xml": "<x/>", "word/document.xml": body})


def xlsx():
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    sheet = f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row>' \
            '<row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    return pack({"xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="a" r:id="r1"/></sheets></workbook>',
                 "xl/_rels/workbook.xml.rels": rel, "xl/worksheets/sheet1.xml": sheet,
                 "xl/sharedStrings.xml": f"<sst {S}><si><t>tok</t><r><t>en</t></r></si></sst>"})


def pptx():
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    p = "http://schemas.openxmlformats.org/presentationml/2006/main"
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>'
    slide = f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>one</a:t></a:r></a:p>' \
            "<a:p><a:r><a:t>two</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    return pack({"ppt/presentation.xml": f'<p:presentation xmlns:p="{p}" {R}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst></p:presentation>',
                 "ppt/_rels/presentation.xml.rels": rel, "ppt/slides/slide1.xml": slide})


def frame(spark, files):
    return spark.createDataFrame([(n, bytearray(c), len(c)) for n, c in files.items()], "path string, content binary, size long")


def test_extensions(spark):
    names = {"a.txt": ".txt", ".bashrc": "", "..a": "", "a..b": ".b", "a.": ".", "x.tar.GZ": ".gz", "noext": "", ".h.txt": ".txt",
             "d.ir/noext": "", "d.ir/.h": ""}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r.p: r.e for r in df.select("p", P.ext(F.col("p")).alias("e")).collect()} == names


def test_types_by_content(spark):
    files = {
        "/d/a.txt": docx("x"), "/d/b.zip": docx("x"), "/d/c.doc": xlsx(), "/d/d.docx": pptx(), "/d/e.pptx": b"%PDF-1.4",
        "/d/f.xls": bytes.fromhex(P.OLE_HEAD), "/d/g.txt": pack({"other": "x"}), "/d/h.txt": b"PK\x03\x04xl/ broken",
        "/d/i.docx": b"text", "/d/j.txt": pack({"xl/a": "x"}, comment=b"c" * 3000)}
    got = {r.path[3]: r.detected_ext for r in L.with_types(frame(spark, files)).collect()}
    assert got == {"a": ".docx", "b": ".zip", "c": ".xlsx", "d": ".pptx", "e": ".pdf", "f": ".xls", "g": ".docx",
                   "h": ".docx", "i": ".docx", "j": ".xlsx"}


def test_status_and_findings(spark):
    files = {
        "/d/ok.docx": docx("my token"), "/d/ok.xlsx": xlsx(), "/d/ok.pptx": pptx(), "/d/gbk.txt": "涉密 token".encode("gbk"),
        "/d/mac.txt": b"a\rtoken\r\nb", "/d/locked.docx": lock(docx("x")), "/d/nocore.docx": pack({"word/other.xml": "x"}),
        "/d/package.docx": pack({"EncryptedPackage": "x"}), "/d/notzip.docx": b"junk", "/d/a.pdf": b"%PDF-1.4 ...",
        "/d/lock.pdf": b"%PDF-1.4 /Encrypt 5 0 R", "/d/old.doc": bytes.fromhex(P.OLE_HEAD) + b"\x00\x01token here\x02",
        "/d/locked.xls": bytes.fromhex(P.OLE_HEAD) + "EncryptionInfo".encode("utf-16-le"),
        "/d/a.xls": bytes.fromhex(P.OLE_HEAD), "/d/big.txt": b" " * 10241, "/d/notbig.txt": b" " * 10240,
        "/d/nine.txt": b"123456789" + b" " * 11000, "/d/ten.txt": b"1234567890" + b" " * 11000}
    checked = L.with_status(L.extract(L.with_types(frame(spark, files))))
    got = {r.path[3:]: r.status for r in checked.collect()}
    assert got == {
        "ok.docx": "ok", "ok.xlsx": "ok", "ok.pptx": "ok", "gbk.txt": "ok", "mac.txt": "ok", "locked.docx": "encrypted",
        "nocore.docx": "encrypted", "package.docx": "encrypted", "notzip.docx": "damaged", "a.pdf": "damaged",
        "lock.pdf": "encrypted", "old.doc": "ok", "locked.xls": "encrypted", "a.xls": "damaged", "big.txt": "damaged",
        "notbig.txt": "ok", "nine.txt": "damaged", "ten.txt": "ok"}
    found = {(r.path[3:], r.line_no, r.content) for r in L.findings(checked, ["token"]).collect()}
    assert found == {("ok.docx", 1, "my token\tend"), ("ok.xlsx", 1, "token\t\t5"), ("gbk.txt", 1, "涉密 token"),
                     ("mac.txt", 2, "token"), ("old.doc", 1, "token here")}


def test_documents():
    assert E.docx_text(docx("a")) == "a\tend\nlast\ncell"
    assert E.xlsx_text(xlsx()) == "token\t\t5\n\t\t\n\tin\t"
    assert E.pptx_text(pptx()) == "one\ntwo"
    assert E.run_extractors([lambda b: 1 / 0, lambda b: None, lambda b: "x"], b"") == ("x", "ok")
    assert E.run_extractors(None, b"") == (None, "missing_reader")


def test_decoding_and_carving(spark):
    data = {"u": "Grüße\r\nx", "g": "机密"}
    df = spark.createDataFrame([("u", bytearray(data["u"].encode())), ("g", bytearray(data["g"].encode("gbk"))),
                                ("l", bytearray(b"caf\xe9 \xff"))], "k string, content binary")
    got = {r.k: r.t for r in df.select("k", L.decode_text(F.col("content")).alias("t")).collect()}
    assert got == {"u": "Grüße\nx", "g": "机密", "l": "café ÿ"}
    blob = b"\x00abc\x01abcd\x02" + "机密".encode("gbk") + b"\x03" + "机".encode("gbk") + b"\x00\xff"
    df = spark.createDataFrame([(bytearray(blob),), (bytearray(b"\x00ab\x00"),), (bytearray(b"\x01word\x02more!"),)], "c binary")
    assert [r.t for r in df.select(L.carve_strings(F.col("c")).alias("t")).collect()] == ["abcd\n机密", None, "word\nmore!"]


def nest(depth, inner):
    data = pack(inner)
    for i in range(depth):
        data = pack({f"n{i}.zip": data}, zipfile.ZIP_STORED if i % 2 else zipfile.ZIP_DEFLATED)
    return data


def test_archives(spark):
    plain = {"x/a.txt": "a token", "b.docx": docx("token too"), "skip.bin": "token", "机.txt": "秘密"}
    files = {"/z/plain.zip": pack(plain), "/z/deep3.zip": nest(3, {"t.txt": "token"}), "/z/deep4.zip": nest(4, {"t.txt": "token"}),
             "/z/locked.zip": lock(pack({"t.txt": "token"})), "/z/cut.zip": pack(plain)[:-30], "/z/notzip.zip": b"zzz",
             "/z/inner.zip": pack({"lock.zip": lock(pack({"t.txt": "token"})), "r.rar": "Rar!"}), "/z/a.7z": b"7z", "/z/doc.txt": b"token"}
    members, statuses = L.expand_archives(frame(spark, files))
    got = {(r.path[3:], r.member_path): r.status for r in statuses.collect()}
    assert got[("plain.zip", "")] == "ok" and got[("locked.zip", "")] == "encrypted" and got[("cut.zip", "")] == "damaged"
    assert got[("notzip.zip", "")] == "damaged" and got[("inner.zip", "lock.zip")] == "encrypted"
    assert got[("inner.zip", "r.rar")] == "missing_reader" and got[("a.7z", "")] == "missing_reader"
    assert len([k for k in got if k[0] == "deep4.zip"]) == 5 and len([k for k in got if k[0] == "deep3.zip"]) == 4
    found = {(r.path[3:], r.member_path, r.file_type) for r in L.member_findings(members, ["token", "秘密"]).collect()}
    assert found == {("plain.zip", "x/a.txt", "[in archive .txt]"), ("plain.zip", "b.docx", "[in archive .docx]"),
                     ("plain.zip", "机.txt", "[in archive .txt]"), ("deep3.zip", "n2.zip!n1.zip!n0.zip!t.txt", "[in archive .txt]"),
                     ("deep4.zip", "n3.zip!n2.zip!n1.zip!n0.zip!t.txt", "[in archive .txt]")}
    _, limited = L.expand_archives(frame(spark, {"/z/deep4.zip": files["/z/deep4.zip"]}), max_depth=2)
    assert {r.depth: r.status for r in limited.collect()} == {0: "ok", 1: "ok", 2: "ok", 3: "too_deep"}


def test_readable_archives_of_other_shapes(spark):
    plain = pack({"a.txt": "token"})
    with_comment = plain[:-2] + (6).to_bytes(2, "little") + b"PK\x05\x06xy"
    empty = b"PK\x05\x06" + b"\0" * 18
    files = {"/z/prefix.zip": b"#!/bin/sh\n" + plain, "/z/comment.zip": with_comment, "/z/empty.zip": empty, "/z/none.zip": b""}
    members, statuses = L.expand_archives(frame(spark, files))
    assert {r.path: r.status for r in statuses.collect()} == {
        "/z/prefix.zip": "ok", "/z/comment.zip": "ok", "/z/empty.zip": "ok", "/z/none.zip": "damaged"}
    assert {r.path for r in L.member_findings(members, ["token"]).collect()} == {"/z/prefix.zip", "/z/comment.zip"}


def test_damaged_member(spark):
    data = pack({"a.txt": "token " * 50, "b.txt": "token"})
    at = data.index(b"a.txt") + 5
    members, _ = L.expand_archives(frame(spark, {"/z/a.zip": data[:at] + b"\xff" * 8 + data[at + 8:]}))
    assert {r.member_path: r.status for r in members.collect()} == {"a.txt": "damaged", "b.txt": "ok"}


def test_unlock_rounds(spark):
    reg = spark.createDataFrame([("a", ".docx", "file", "encrypted", None), ("b", ".zip", "archive", "encrypted", None),
                                 ("c", ".pdf", "file", "encrypted", None)], "path string, ext string, kind string, status string, matched long")
    outcomes = spark.createDataFrame([("a", True), ("b", False)], "path string, ok boolean")
    found = spark.createDataFrame([("a", "k")] * 3, "path string, keyword string")
    after = {r.path: (r.status, r.matched) for r in L.apply_attempt(reg, outcomes, found).collect()}
    assert after == {"a": ("decrypted", 3), "b": ("failed", None), "c": ("encrypted", None)}
    assert [r.path for r in L.retry_set(L.apply_attempt(reg, outcomes, found)).collect()] == ["b"]


def test_little_text_is_diagnosed_and_scanned(spark):
    """Encrypted by its structure when nothing in it could give a text, and its text is scanned all the same; a workbook with a sheet is low_text."""
    sheet = pack({"xl/workbook.xml": "x", "xl/worksheets/sheet1.xml": "x"})
    rows = [("/d/a.xlsx", bytearray(pack({"xl/workbook.xml": "x"})), 20000, " token ", "ok"), ("/d/b.xlsx", bytearray(sheet), 20000, "token", "ok"),
            ("/d/c.txt", bytearray(b"token"), 20000, "token", "ok"), ("/d/d.xlsx", bytearray(sheet), 20000, "token", "encrypted")]
    frame = spark.createDataFrame(rows, "path string, content binary, size long, text string, extract_status string")
    checked = L.with_status(L.with_types(frame))
    assert {r.path[3]: (r.status, r.reason) for r in checked.collect()} == {
        "a": ("encrypted", "encrypted"), "b": ("damaged", "low_text"), "c": ("damaged", "low_text"), "d": ("encrypted", "encrypted")}
    assert sorted(r.path[3] for r in L.findings(checked, ["token"]).collect()) == ["a", "b", "c"]


def test_locked_workbooks_of_little_text_are_registered(spark):
    """A sheet tells that the little text of a workbook may be all there is, but not of one that says it is locked."""
    sheet = {"xl/workbook.xml": "x", "xl/worksheets/sheet1.xml": "x"}
    contents = {"a": lock(pack(sheet)), "b": pack({**sheet, "EncryptedPackage": "x"}), "c": pack(sheet), "d": lock(pack({**sheet, "xl/sharedStrings.xml": "x"}))}
    frame = spark.createDataFrame([(f"/d/{n}.xlsx", bytearray(c), 20000, " token ", "ok") for n, c in contents.items()],
                                  "path string, content binary, size long, text string, extract_status string")
    check = C.check_files(frame, ["token"])
    assert sorted((r.path[3], r.kind) for r in check.registry().collect()) == [("a", "file"), ("b", "file"), ("d", "file")]
    assert check.summary().first().asDict() == {"supported_files": 4, "matched_files": 4, "encrypted_files": 3, "damaged_files": 1, "hidden_files": 0,
                                                "archives_scanned": 0, "encrypted_archives": 0, "findings": 4}
    assert {r.path[3]: r.reason for r in L.with_status(L.with_types(frame)).collect()} == {"a": "encrypted", "b": "encrypted", "c": "low_text", "d": "encrypted"}
