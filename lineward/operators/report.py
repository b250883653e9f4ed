"""Report: common findings frame, summary, numbered lists and Markdown lines.

A report is a frame ``section, seq, line``; nothing of it passes through the driver.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.functions import display as D
from lineward.operators.numbering import number_rows
from lineward.schemas import FINDING

# Modules in report order with the counters that mean "checked" and "matched".
MODULES = ["web", "db", "file", "image"]
CHECKED = {"web": ["total"], "db": ["total_records"], "file": ["supported_files"], "image": ["total_images"]}
MATCHED = {"web": ["matched_pages", "cached_matched"], "db": ["matched_tables"],
           "file": ["matched_files"], "image": ["matched_images"]}
NOTES = {
    "web": [("skipped", "%s skipped"), ("new_pages", "%s new or changed")],
    "db": [("total_databases", "%s databases"), ("total_tables", "%s tables"),
           ("candidate_records", "%s candidates")],
    "file": [("archives_scanned", "%s archives"), ("encrypted", "%s encrypted"),
             ("decrypted", "%s decrypted"), ("damaged", "%s damaged"), ("hidden", "%s hidden")],
    "image": [],
}
TYPE_NAMES = {e: e[1:].upper() for e in (
    ".txt", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".pdf", ".zip", ".rar", ".7z",
    ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif")}
STATUS_NAMES = {"decrypted": "decrypted", "failed": "not decrypted", "skipped": "skipped",
                "encrypted": "not handled"}


def _lookup(names: dict[str, str], key: Column) -> Column:
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    return F.coalesce(F.try_element_at(table, key), key)


# --- one frame for all findings ------------------------------------------------------------------

def as_findings(found: DataFrame, module: str, container: Column | str, locator: Column | None = None,
                source_id: str = "", method: str = "regex") -> DataFrame:
    """A module's findings in the common columns."""
    have = set(found.columns)
    col = lambda name: F.col(name) if name in have else F.lit(None)
    values = {
        "module": F.lit(module), "source_id": F.lit(source_id),
        "container": F.col(container) if isinstance(container, str) else container,
        "locator": F.lit(None) if locator is None else locator,
        "line_no": col("line_no"), "content": col("content"), "keyword": col("keyword"),
        "from_cache": F.coalesce(col("from_cache"), F.lit(False)), "method": F.lit(method)}
    return found.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in FINDING.fields])


def union_findings(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- summary -------------------------------------------------------------------------------------

def counters(frame: DataFrame, module: str, names: dict[str, str] | None = None) -> DataFrame:
    """A one-row frame of counters as rows ``module, counter, n``; ``names`` renames counters."""
    names = names or {c: c for c in frame.columns}
    pairs = F.array(*[F.struct(F.lit(new).alias("counter"), F.col(old).cast("long").alias("n"))
                      for old, new in names.items()])
    return frame.select(F.lit(module).alias("module"), F.inline(pairs))


def _sum_of(names: list[str]) -> Column:
    return F.coalesce(F.sum(F.when(F.col("counter").isin(names), F.col("n"))), F.lit(0))


_COUNTERS = sorted({c for t in (CHECKED, MATCHED) for names in t.values() for c in names}
                   | {c for items in NOTES.values() for c, _ in items})


def _totals(counts: DataFrame, ocr_engine: str) -> DataFrame:
    """Checked, matched and note of the modules that have counters, from one aggregate."""
    def plus(names: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"_{n}") for n in names])

    def per_module(values: dict[str, Column], default: Column) -> Column:
        return reduce(lambda acc, m: F.when(F.col("module") == m, values[m]).otherwise(acc), MODULES, default)

    def note(module: str) -> Column:
        parts = [F.when(F.col(f"_{c}") > 0, F.format_string(label, F.col(f"_{c}").cast("string")))
                 for c, label in NOTES[module]]
        text = F.concat_ws(", ", *parts) if parts else F.lit(f"OCR: {ocr_engine}")
        return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))

    sums = counts.groupBy("module").agg(*[_sum_of([c]).alias(f"_{c}") for c in _COUNTERS])
    return sums.select(
        "module", per_module({m: plus(CHECKED[m]) for m in MODULES}, F.lit(0)).alias("checked"),
        per_module({m: plus(MATCHED[m]) for m in MODULES}, F.lit(0)).alias("matched"),
        per_module({m: note(m) for m in MODULES}, F.lit("-")).alias("note"))


def notes(counts: DataFrame, ocr_engine: str = "N/A") -> DataFrame:
    """Note per module from its counters that are not zero, ``-`` when there is none."""
    return _totals(counts, ocr_engine).select("module", "note")


def summary(counts: DataFrame, ocr_engine: str = "N/A") -> DataFrame:
    """Checked, matched and note for each of the four modules, absent ones with zeros."""
    modules = counts.sparkSession.createDataFrame(list(enumerate(MODULES)), "seq int, module string")
    default = F.when(F.col("module") == "image", f"OCR: {ocr_engine}").otherwise("-")
    return modules.join(_totals(counts, ocr_engine), "module", "left").select(
        "seq", "module", F.coalesce("checked", F.lit(0)).cast("long").alias("checked"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
        F.coalesce("note", default).alias("note"))


def grand_total(summary_rows: DataFrame) -> DataFrame:
    return summary_rows.agg(F.sum("matched").alias("matched"))


def encryption_note(registry: DataFrame) -> DataFrame:
    """Numbers of encrypted and of decrypted files."""
    return registry.agg(F.count("*").alias("encrypted"),
                        F.count_if(F.col("status") == "decrypted").alias("decrypted"))


# --- numbered lists ------------------------------------------------------------------------------

def numbered(findings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Findings with running numbers in a total order."""
    return number_rows(findings, order or ["container", "line_no", "keyword", "content"])


def web_sections(findings: DataFrame) -> DataFrame:
    """Fresh and carried-over findings, each numbered from one, in display form."""
    shown = number_rows(findings, ["url", "line_no", "content"], by=["from_cache"])
    return shown.select(
        "from_cache", "seq", D.ellipsis(F.col("url"), D.URL_CHARS).alias("url"), "line_no",
        D.trim_keywords(F.col("keyword")).alias("keyword"), D.sanitize(F.col("content")).alias("content"))


def table_stats(stats: DataFrame) -> DataFrame:
    return stats.select("table", "total_records", "matched_records", "n_text_columns", "n_columns")


def type_counts(counts: DataFrame, ext: str = "ext") -> DataFrame:
    """Display name and number per file type, in the order of the extensions."""
    return counts.select(F.col(ext).alias("ext"), _lookup(TYPE_NAMES, F.col(ext)).alias("name"), "n").orderBy("ext")


def encrypted_list(registry: DataFrame) -> DataFrame:
    """Numbered encrypted files with status and, once decrypted, the number of findings."""
    rows = number_rows(registry.select("path", "ext", "status", "matched"), ["path"])
    found = F.when((F.col("matched") > 0) | (F.col("status") == "decrypted"),
                   F.concat(F.coalesce("matched", F.lit(0)).cast("string"), F.lit(" findings"))).otherwise("-")
    return rows.select(
        "seq", D.truncate_path(F.col("path")).alias("path"),
        F.ltrim(F.upper("ext"), F.lit(".")).alias("type"),
        _lookup(STATUS_NAMES, F.col("status")).alias("status"), found.alias("found"))


def file_list(paths: DataFrame, empty: str) -> DataFrame:
    """Lines of a numbered list of paths under its size, or one line saying there is none."""
    lines = number_rows(paths.select("path"), ["path"]).select(
        "seq", F.concat(F.col("seq").cast("string"), F.lit(". `"), D.truncate_path(F.col("path")), F.lit("`")).alias("line"))
    size = paths.agg(F.count("*").alias("n")).select(
        F.lit(0).cast("long").alias("seq"),
        F.when(F.col("n") > 0, F.format_string("**%s** in all:", F.col("n").cast("string"))).otherwise(empty).alias("line"))
    return size.unionByName(lines)


# --- Markdown ------------------------------------------------------------------------------------

def table_lines(rows: DataFrame, headers: list[str], cells: list[Column | str], seq: str = "seq") -> DataFrame:
    """Lines of a Markdown table; ``seq`` orders the rows and starts above zero."""
    spark = rows.sparkSession
    head = [(-1, "| " + " | ".join(headers) + " |"), (0, "|" + "|".join(["-----"] * len(headers)) + "|")]
    columns = [F.col(c) if isinstance(c, str) else c for c in cells]
    return spark.createDataFrame(head, "seq long, line string").unionByName(
        rows.select(F.col(seq).cast("long").alias("seq"), D.table_row(columns).alias("line")))


def block(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Fixed lines, such as headings."""
    return spark.createDataFrame(list(enumerate(lines)), "seq long, line string")


def assemble(blocks: list[DataFrame]) -> DataFrame:
    """Blocks of lines (``seq, line``) one after the other as ``section, seq, line``."""
    return reduce(DataFrame.unionByName, [
        b.select(F.lit(i).alias("section"), F.col("seq").cast("long").alias("seq"), "line")
        for i, b in enumerate(blocks)])


def tally(rows: DataFrame, noun: str) -> DataFrame:
    """One line with the number of rows."""
    line = F.format_string(f"%d {noun}", F.count("*")).alias("line")
    return rows.agg(line).select(F.lit(0).alias("seq"), "line")


def document(keywords: list[str], checked_at: str, summary_rows: DataFrame, web: DataFrame | None = None,
             db_stats: DataFrame | None = None, db: DataFrame | None = None, file_types: DataFrame | None = None,
             encrypted: DataFrame | None = None, damaged: DataFrame | None = None, hidden: DataFrame | None = None,
             file: DataFrame | None = None, image_types: DataFrame | None = None, image: DataFrame | None = None,
             method: str = "fuzzy pattern") -> DataFrame:
    """The whole report in five sections; absent parts show as empty."""
    spark = summary_rows.sparkSession
    text = lambda *lines: block(spark, list(lines))
    nothing = "Nothing found."
    out = [
        text("# Keyword scan", "", f"Time: {checked_at}",
             f"Searched for: {', '.join(keywords)}", f"Searched with: {method}", "", "---", "", "## 1. Overview", ""),
        table_lines(summary_rows.withColumn("_n", F.col("seq") + 1), ["Module", "Checked", "Matched", "Note"],
                    ["module", "checked", "matched", "note"], "_n"),
        grand_total(summary_rows).select(F.posexplode(F.array(
            F.struct(F.lit("").alias("line")),
            F.struct(F.format_string("Matches over all modules: %s", F.col("matched").cast("string")).alias("line"))))
                                         ).select(F.col("pos").alias("seq"), "col.line"),
        text("", "---", "", "## 2. Web pages", ""),
    ]
    if web is None:
        out.append(text(nothing))
    else:
        shown = web_sections(web)
        for cached, title in ((False, "Pages read now"), (True, "Pages as stored")):
            part = shown.where(F.col("from_cache") == cached)
            out += [text("", f"### {title}", ""), tally(part, "findings"), text(""), table_lines(
                part, ["No.", "URL", "Line", "Keywords", "Text"],
                ["seq", "url", "line_no", "keyword", "content"])]
    out.append(text("", "---", "", "## 3. Databases", ""))
    if db_stats is not None:
        out += [text("### 3.1 Tables", ""), table_lines(
            number_rows(table_stats(db_stats), ["table"]), ["Table", "Records", "Matched", "Text columns", "Columns"],
            ["table", "total_records", "matched_records", "n_text_columns", "n_columns"])]
    out.append(text("", "### 3.2 Findings", ""))
    out += [] if db is None else [tally(db, "findings"), text("")]
    out.append(text(nothing) if db is None else table_lines(
        number_rows(db, ["table", "field", "record_id"]), ["No.", "Table", "Field", "Record", "Keywords"],
        ["seq", "table", "field", "record_id", D.trim_keywords(F.col("keyword"))]))
    out.append(text("", "---", "", "## 4. Files", ""))
    if file_types is not None:
        out += [text("### 4.1 File types", ""), table_lines(
            number_rows(type_counts(file_types), ["ext"]), ["Type", "Files"], ["name", "n"])]
    out.append(text("", "### 4.2 Encrypted files", ""))
    out += [] if encrypted is None else [tally(encrypted, "files"), text("")]
    out.append(text("No encrypted files.") if encrypted is None else table_lines(
        encrypted_list(encrypted), ["No.", "Path", "Type", "Status", "Result"],
        ["seq", "path", "type", "status", "found"]))
    for title, paths, empty in (("### 4.3 Damaged files", damaged, "No damaged files."),
                                ("### 4.4 Hidden files", hidden, "No hidden files.")):
        out += [text("", title, ""), text(empty) if paths is None else file_list(paths, empty)]
    out.append(text("", "### 4.5 Findings", ""))
    out += [] if file is None else [tally(file, "findings"), text("")]
    out.append(text(nothing) if file is None else table_lines(
        number_rows(file, ["path", "line_no", "content"]), ["No.", "Path", "Line", "Type", "Keywords", "Text"],
        ["seq", D.truncate_path(F.col("path")), "line_no", "file_type", D.trim_keywords(F.col("keyword")),
         D.sanitize(F.col("content"))]))
    out.append(text("", "---", "", "## 5. Images", ""))
    if image_types is not None:
        out += [text("### 5.1 Image types", ""), table_lines(
            number_rows(type_counts(image_types), ["ext"]), ["Type", "Images"], ["name", "n"])]
    out.append(text("", "### 5.2 Findings", ""))
    out += [] if image is None else [tally(image, "findings"), text("")]
    out.append(text(nothing) if image is None else table_lines(
        number_rows(image, ["image_path", "position", "ocr_text"]),
        ["No.", "Folder", "File", "Position", "Keywords", "Text"],
        ["seq", F.concat(F.lit("`"), D.ellipsis(F.col("directory"), D.DIRECTORY_CHARS), F.lit("`")), "filename",
         "position", D.trim_keywords(F.col("keyword")), D.sanitize(F.col("ocr_text"))]))
    out.append(text("", "---", ""))
    return assemble(out)
