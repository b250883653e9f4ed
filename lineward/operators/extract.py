"""Text of single documents; small helpers the extraction job calls per row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Encodings tried in this order; the last accepts any bytes.
ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
_RUNS = re.compile(rb"(?:[\xb0-\xf7][\xa1-\xfe])+|[\x20-\x7e]+")


def decode_legacy(data: bytes) -> str | None:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def carve(data: bytes) -> str | None:
    """Printable runs of a binary file: two Chinese or four ASCII characters at least."""
    kept = []
    for run in _RUNS.findall(data):
        text = run.decode("gbk", errors="ignore")
        if len(text) >= (2 if run[0] >= 0xB0 else 4):
            kept.append(text)
    return "\n".join(kept) if kept else None


def plain_text(data: bytes) -> str | None:
    text = decode_legacy(data)
    return None if text is None else re.sub("\r\n?", "\n", text)


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _targets(z: zipfile.ZipFile, rels: str, folder: str) -> dict[str, str]:
    return {r.get("Id"): r.get("Target").lstrip("/") if r.get("Target").startswith("/") else folder + r.get("Target")
            for r in _part(z, rels)}


def _paragraph(p: ElementTree.Element) -> str:
    marks = {_W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n"}
    return "".join(e.text or "" if e.tag == _W + "t" else marks.get(e.tag, "")
                   for run in p.iter(_W + "r") for e in run)


def docx_text(data: bytes) -> str | None:
    """Paragraphs of the body, then the cells of its tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml").find(_W + "body")
    parts = [_paragraph(p) for p in body.findall(_W + "p")]
    for cell in (c for t in body.findall(_W + "tbl") for r in t.findall(_W + "tr") for c in r.findall(_W + "tc")):
        text = "\n".join(_paragraph(p) for p in cell.findall(_W + "p"))
        span = cell.find(f"{_W}tcPr/{_W}gridSpan")
        parts += [text] * (int(span.get(_W + "val")) if span is not None else 1)
    return "\n".join(parts)


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n


def xlsx_text(data: bytes) -> str | None:
    """Rows of all sheets with tab-separated cells; empty cells and rows keep their place."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in _part(z, "xl/sharedStrings.xml")]
        paths = _targets(z, "xl/_rels/workbook.xml.rels", "xl/")
        lines = []
        for sheet in _part(z, "xl/workbook.xml").iter(_S + "sheet"):
            rows, width = {}, 0
            for i, row in enumerate(_part(z, paths[sheet.get(_R + "id")]).iter(_S + "row"), 1):
                cells = {}
                for j, c in enumerate(row.findall(_S + "c"), 1):
                    at = _column(c.get("r")) if c.get("r") else j
                    cells[at] = _cell(c, shared)
                rows[int(row.get("r") or i)] = cells
                width = max([width, *cells])
            for n in range(1, max(rows, default=0) + 1):
                lines.append("\t".join(rows.get(n, {}).get(k, "") for k in range(1, width + 1)))
    return "\n".join(lines)


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind, value = c.get("t"), c.findtext(_S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_S + "t"))
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return str(value == "1")
    return value


def pptx_text(data: bytes) -> str | None:
    """Text frames of the shapes of all slides in order."""
    frames = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        paths = _targets(z, "ppt/_rels/presentation.xml.rels", "ppt/")
        for slide in _part(z, "ppt/presentation.xml").iter(_P + "sldId"):
            tree = _part(z, paths[slide.get(_R + "id")]).find(f"{_P}cSld/{_P}spTree")
            for body in (s.find(_P + "txBody") for s in tree.findall(_P + "sp")):
                if body is not None:
                    frames.append("\n".join(
                        "".join("\v" if e.tag == _A + "br" else e.findtext(_A + "t") or "" for e in p
                                if e.tag in (_A + "r", _A + "br", _A + "fld"))
                        for p in body.findall(_A + "p")))
    return "\n".join(frames)


# Types without an entry need a plug-in reader.
BUILT_IN: dict[str, list[Callable[[bytes], str | None]]] = {
    ".txt": [plain_text],
    ".doc": [carve],
    ".docx": [docx_text],
    ".xlsx": [xlsx_text],
    ".pptx": [pptx_text],
}
_LOCKED = "EncryptionInfo".encode("utf-16-le")


def run_extractors(chain: list[Callable] | None, data: bytes | None) -> tuple[str | None, str]:
    """Text of the first extractor that gives one, and how that went."""
    if data is None:
        return None, "damaged"
    if data[:4] == b"\xd0\xcf\x11\xe0" and _LOCKED in data:
        return None, "encrypted"
    if not chain:
        return None, "missing_reader"
    for reader in chain:
        try:
            text = reader(data)
        except Exception:  # a reader that fails leaves the file to the next one
            continue
        if text is not None:
            return text, "ok"
    return None, "damaged"
