"""Files: detected type, extraction, archives, status, findings and the register of locked files.

Frames carry ``path``, ``ext``, ``size`` and ``content``; extraction adds ``text`` and
``extract_status``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lineward.functions import files as P
from lineward.functions.binding import let
from lineward.operators import extract as E
from lineward.operators.keyword_scan import line_findings
from lineward.session import ensure_checkpoint_dir

OK, ENCRYPTED, DAMAGED, MISSING_READER = "ok", "encrypted", "damaged", "missing_reader"
LOW_TEXT, TOO_DEEP = "low_text", "too_deep"
_BATCH_BYTES = 32 << 20


def with_types(files: DataFrame) -> DataFrame:
    """Add extension, route and detected type; archives keep their extension."""
    # Bound once, the extension is not copied into every place that mentions it.
    def described(ext: Column) -> Column:
        return F.struct(ext.alias("ext"), P.route(ext).alias("route"))

    typed = files.withColumn("_kind", let(P.ext(F.col("path")), described))
    others = [c for c in files.columns]
    detected = F.when(F.col("_kind.route") == "document", P.detected_ext("_kind.ext", "content"))
    return typed.select(
        *others, "_kind.ext", "_kind.route", F.coalesce(detected, F.col("_kind.ext")).alias("detected_ext"),
        P.is_hidden(F.col("path")).alias("is_hidden"))


def type_mismatch(typed: DataFrame) -> DataFrame:
    return typed.where(F.col("detected_ext") != F.col("ext"))


@F.pandas_udf(T.StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else E.decode_legacy(b))


def decode_text(content: Column) -> Column:
    """Text of a plain file: UTF-8 in the JVM, the older encodings in Python workers.

    Line ends of all systems become line feeds.
    """
    raw = content.cast("string")
    utf8 = F.is_valid_utf8(raw)
    text = F.coalesce(F.when(utf8, raw), _decode_other(F.when(~utf8, content)))
    return F.regexp_replace(text, "\r\n?", "\n")


@F.pandas_udf(T.StringType())
def _carve_mixed(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else E.carve(b))


def carve_ascii(content: Column) -> Column:
    """Runs of at least four printable ASCII characters, one per line."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit("[\\x20-\\x7e]{4,}"), F.lit(0))
    return F.when(F.size(runs) > 0, F.array_join(runs, "\n"))


def carve_strings(content: Column) -> Column:
    """The same with runs of two-byte Chinese characters, which only Python can decode."""
    double = F.decode(content, "ISO-8859-1").rlike("[\\xb0-\\xf7][\\xa1-\\xfe]")
    return F.coalesce(_carve_mixed(F.when(double, content)), F.when(~double, carve_ascii(content)))


def extract(typed: DataFrame, extractors: dict[str, list[Callable[[bytes], str | None]]] | None = None) -> DataFrame:
    """Replace ``content`` by ``text``, ``extract_status`` and ``diagnosis``.

    Extractors of the detected type are tried in order until one returns text; an exception counts
    as none. ``E.BUILT_IN`` covers plain text, Office XML and the string fallback for old Word
    files; ``extractors`` adds to it or replaces entries. The bytes go to the Python workers once
    and do not come back: what a missing text means is worked out beforehand.
    """
    table = {**E.BUILT_IN, **(extractors or {})}
    judged = typed.withColumns({"diagnosis": P.diagnose("detected_ext", "content"),
                                "little_is_all": (F.col("detected_ext") != ".xlsx") | P.little_is_all("content")})
    keep = [f for f in judged.schema.fields if f.name not in ("content", "text", "extract_status")]
    schema = T.StructType(keep + [T.StructField("text", T.StringType()),
                                  T.StructField("extract_status", T.StringType())])

    at, names = judged.columns.index("content"), [f.name for f in keep]
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index("detected_ext"))
            others = batch.select(names)
            for a, b in _pieces(batch.column(at)):
                out = [E.run_extractors(table.get(kinds[i].as_py()), batch.column(at)[i].as_py()) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([*others.slice(a, b - a).columns, pa.array([o[0] for o in out], arrow.field("text").type),
                                                  pa.array([o[1] for o in out], arrow.field("extract_status").type)], [*names, "text", "extract_status"])

    return judged.mapInArrow(run, schema)


# --- archives ------------------------------------------------------------------------------------

def archive_status(ext: Column, content: str) -> Column:
    """ok, encrypted or damaged for ZIP files; missing_reader for the kinds without a reader."""
    return (
        F.when(ext != ".zip", MISSING_READER).when(~P.is_zip(content), DAMAGED)
        .when(P.zip_encrypted(content), ENCRYPTED).otherwise(OK))


def _pieces(content: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about _BATCH_BYTES of content; a batch is as many rows as Spark sends, of any size."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(content).to_pylist()):
        if i > start and held + (n or 0) > _BATCH_BYTES:
            yield start, i
            start = i
            held = 0
        held += n or 0
    if start < len(content):
        yield start, len(content)


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decompress raw members one at a time, yielding whenever enough bytes have come together."""
    def done(batch, start, datas, statuses):
        kept = batch.slice(start, len(datas)).select(["path", "member_path", "depth"]).columns
        return pa.RecordBatch.from_arrays([*kept, pa.array(datas, pa.binary()), pa.array(statuses, pa.string())], _MEMBER_COLUMNS)

    for batch in batches:
        methods, raws = batch.column(batch.schema.get_field_index("method")), batch.column(batch.schema.get_field_index("raw"))
        start, datas, statuses, size = 0, [], [], 0
        for i in range(len(batch)):
            method = methods[i].as_py()
            try:
                raw = raws[i].as_py()
                data = raw if method == 0 else zlib.decompress(raw, -zlib.MAX_WBITS)
                status = OK if method in (0, 8) else MISSING_READER
            except (zlib.error, TypeError):  # cut off or missing bytes
                data, status = None, DAMAGED
            datas.append(data if status == OK else None)
            statuses.append(status)
            size += len(datas[-1] or b"")
            if size > _BATCH_BYTES:
                yield done(batch, start, datas, statuses)
                start, datas, statuses, size = i + 1, [], [], 0
        if datas:
            yield done(batch, start, datas, statuses)


_MEMBER_COLUMNS = ["path", "member_path", "depth", "content", "status"]
_MEMBER_SCHEMA = "path string, member_path string, depth int, content binary, status string"


def open_archives(archives: DataFrame, exts: list[str]) -> DataFrame:
    """One row per member of the wanted types (``path, member_path, depth, content, status``).

    The archive is cut into its compressed members by its directory, in the JVM, and the members
    are dealt out to all tasks before anything is decompressed. So one archive that holds most of
    the members is worked on everywhere.
    """
    inner = F.when(F.col("member_path") == "", F.col("e.name")).otherwise(
        F.concat(F.col("member_path"), F.lit("!"), F.col("e.name")))
    raw = (
        archives.where(F.col("status") == OK)
        .select("path", "member_path", "depth", F.explode(P.zip_members("content")).alias("e"))
        .where(P.ext(F.col("e.name")).isin(exts))
        .select("path", inner.alias("member_path"), "depth", "e.method", "e.raw"))
    opened = raw.hint("rebalance").mapInArrow(_inflate, _MEMBER_SCHEMA)
    return opened.withColumn("ext", P.ext(F.col("member_path")))


def expand_archives(files: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Members of the archives among ``files``, nested archives followed to the last.

    Returns the members (documents only) and the status of every archive met. With ``max_depth``
    archives nested deeper aren't opened and have the status too_deep. Each round opens one level. Only nested archives are written to a
    checkpoint between rounds; documents are decompressed when the result is used.
    """
    spark = files.sparkSession
    ensure_checkpoint_dir(spark)
    level = files.where(P.ext(F.col("path")).isin(P.ARCHIVE_EXTS)).select(
        "path", F.lit("").alias("member_path"), F.lit(0).alias("depth"), "content")
    members = spark.createDataFrame([], _MEMBER_SCHEMA + ", ext string")
    statuses = spark.createDataFrame([], "path string, member_path string, depth int, status string")
    for depth in count():
        name = F.when(F.col("member_path") == "", F.col("path")).otherwise(F.col("member_path"))
        level = level.withColumn("status", archive_status(P.ext(name), "content") if max_depth is None or depth <= max_depth
                                 else F.lit(TOO_DEEP))
        statuses = statuses.unionByName(level.select("path", "member_path", "depth", "status"))
        members = members.unionByName(open_archives(level, P.DOCUMENT_EXTS))
        if max_depth is not None and depth > max_depth:
            break
        level = open_archives(level, P.ARCHIVE_EXTS).select(
            "path", "member_path", (F.col("depth") + 1).cast("int").alias("depth"), "content").checkpoint()
        if level.isEmpty():
            break
    return members, statuses


# --- status and results --------------------------------------------------------------------------

def with_status(extracted: DataFrame) -> DataFrame:
    """Add ``status`` and ``reason``.

    In order: no text, judged by the file's structure; what the extractor reported; a sizeable file with next to no
    text, which is encrypted if its structure says so and labelled low_text otherwise. A workbook without shared
    strings counts as encrypted for little text only if it has no sheet either or is locked. Everything unreadable for another reason
    than encryption is damaged. ``scanned`` tells whether a text came out, which is so for all files of little text.
    """
    low = P.low_text(F.col("size"), F.col("text"))
    why = (F.col("diagnosis") if "diagnosis" in extracted.columns
           else P.diagnose("detected_ext", "content"))
    text, told = F.col("text"), F.col("extract_status")

    def reason(diagnosis: Column) -> Column:
        return (
            F.when(text.isNull(), diagnosis).when(told.isin(ENCRYPTED, DAMAGED, MISSING_READER), told)
            .when(low, F.when(diagnosis == ENCRYPTED, ENCRYPTED).otherwise(LOW_TEXT)).otherwise(OK))

    def outcome(reason: Column) -> Column:
        status = F.when(reason.isin(OK, ENCRYPTED, MISSING_READER), reason).otherwise(DAMAGED)
        read = (reason == OK) | F.coalesce(low & ~told.isin(ENCRYPTED, DAMAGED, MISSING_READER), F.lit(False))
        return F.struct(reason.alias("reason"), status.alias("status"), read.alias("scanned"))

    # Only files without a text, or with next to none, need a diagnosis.
    needed = F.when(text.isNull() | (low & _undiagnosed(extracted)), why)
    checked = extracted.withColumn("_check", let(let(needed, reason), outcome))
    return checked.select(*[c for c in checked.columns if c != "_check"], "_check.*")


def _undiagnosed(extracted: DataFrame) -> Column:
    """Whether little text asks for a diagnosis; kinds other than workbooks always do."""
    if "little_is_all" in extracted.columns:
        return F.col("little_is_all")
    return (F.col("detected_ext") != ".xlsx") | P.little_is_all("content")


def findings(checked: DataFrame, keywords: list[str]) -> DataFrame:
    """Line findings of all files that gave a text: path, line, content, keyword and detected type."""
    texts = checked.where("scanned").select(
        "path", F.col("detected_ext").alias("file_type"), "text")
    return line_findings(texts, keywords)


def member_findings(members: DataFrame, keywords: list[str],
                    extractors: dict[str, list[Callable]] | None = None) -> DataFrame:
    """Findings inside archives, reported under the outer path with the member beside it."""
    texts = extract(members.where(F.col("status") == OK).withColumn("detected_ext", F.col("ext")), extractors)
    readable = texts.where(F.col("text").isNotNull() & (F.col("extract_status") == OK))
    return line_findings(readable.select(
        "path", "member_path", F.concat(F.lit("[in archive "), "ext", F.lit("]")).alias("file_type"), "text"),
        keywords)


def type_counts(checked: DataFrame) -> DataFrame:
    """Processed documents per detected type, unreadable ones included."""
    return checked.where(F.col("route") == "document").groupBy("detected_ext").agg(F.count("*").alias("n"))


def summary(checked: DataFrame, archives: DataFrame, found: DataFrame) -> DataFrame:
    """Counters of a file scan from the statuses of documents and archives and the findings.

    ``checked`` has every inventoried file with its route; ``archives`` the status per archive.
    """
    document = F.col("route") == "document"
    flags = checked.select(
        (document).alias("doc"), (document & (F.col("status") == ENCRYPTED)).alias("enc"),
        (document & (F.col("status") == DAMAGED)).alias("dam"), F.col("is_hidden").alias("hid"),
        F.lit(False).alias("arc"), F.lit(False).alias("arc_enc"), F.lit(None).cast("string").alias("hit"))
    no = F.lit(False)
    arch = archives.select(no, no, no, no, F.lit(True), F.col("status") == ENCRYPTED, F.lit(None).cast("string"))
    hits = found.select(no, no, no, no, no, no, "path")
    return flags.unionAll(arch).unionAll(hits).agg(
        F.count_if("doc").alias("supported_files"), F.countDistinct("hit").alias("matched_files"),
        F.count_if("enc").alias("encrypted_files"), F.count_if("dam").alias("damaged_files"),
        F.count_if("hid").alias("hidden_files"), F.count_if("arc").alias("archives_scanned"),
        F.count_if("arc_enc").alias("encrypted_archives"))


# --- register of encrypted files -----------------------------------------------------------------

def encryption_registry(checked: DataFrame, archives: DataFrame) -> DataFrame:
    """Encrypted documents and archives, all still locked."""
    docs = checked.where((F.col("route") == "document") & (F.col("status") == ENCRYPTED)).select(
        "path", F.col("detected_ext").alias("ext"), F.lit("file").alias("kind"))
    arch = archives.where(F.col("status") == ENCRYPTED).select(
        "path", P.ext(F.col("path")).alias("ext"), F.lit("archive").alias("kind"))
    return docs.unionByName(arch).withColumns(
        {"status": F.lit(ENCRYPTED), "matched": F.lit(None).cast("long")})


def apply_attempt(registry: DataFrame, outcomes: DataFrame, found: DataFrame) -> DataFrame:
    """Registry after an unlock attempt: decrypted with its number of findings, or failed.

    ``outcomes`` has ``path, ok``; files without outcome stay as they are.
    """
    counts = found.groupBy("path").agg(F.count("*").alias("_n"))
    joined = registry.join(outcomes.select("path", "ok"), "path", "left").join(counts, "path", "left")
    status = F.when(F.col("ok"), "decrypted").when(~F.col("ok"), "failed").otherwise(F.col("status"))
    matched = F.when(F.col("ok"), F.coalesce("_n", F.lit(0))).otherwise(F.col("matched"))
    return joined.select("path", "ext", "kind", status.alias("status"), matched.alias("matched"))


def apply_results(registry: DataFrame, results: DataFrame) -> DataFrame:
    """The same from ``results(path, ok, matched)``, which hold the number of findings: no finding and no text travels."""
    joined = registry.drop("matched").join(results.select("path", "ok", "matched"), "path", "left")
    status = F.when(F.col("ok"), "decrypted").when(~F.col("ok"), "failed").otherwise(F.col("status"))
    return joined.select("path", "ext", "kind", status.alias("status"), F.when(F.col("ok"), F.coalesce("matched", F.lit(0))).cast("long").alias("matched"))


def skip_all(registry: DataFrame) -> DataFrame:
    return registry.withColumn("status", F.lit("skipped"))


def retry_set(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("status") == "failed")


def merge_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings with those of an unlock attempt appended."""
    return before.unionByName(after)


# --- resumption ----------------------------------------------------------------------------------

def pending_modules(modules: DataFrame, log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Units of work without a completed entry in the run log."""
    keys = keys or ["module"]
    return modules.join(log.where(F.col("status") == "completed").select(*keys), keys, "left_anti")
