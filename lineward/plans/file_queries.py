"""File types, status, findings and the register of encrypted files, derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineward.functions import files as P
from lineward.operators import file_check as C
from lineward.operators import files as L
from lineward.operators import web as W
from lineward.plans import fixtures as X
from lineward.plans import sqltext as Q
from lineward.plans.keyword_queries import KW
from lineward.plans.registry import query


def checked(t):
    return L.with_status(L.with_types(X.files(t)))


def archives(t):
    zips = L.with_types(X.files(t)).where("route = 'archive'")
    return zips.select("doc_id", "path", L.archive_status(F.col("ext"), "content").alias("status"))


def findings(t):
    return L.findings(checked(t).where("route = 'document'"), KW)


FOUND = f"""(SELECT * FROM {Q.findings(
    f"(SELECT path, detected_ext AS file_type, text FROM {X.CHECKED_SQL} WHERE (status = 'ok' OR (low AND NOT locked)) AND route = 'document')",
    'path, file_type', KW)})"""


@query("file_ext", f"SELECT path, ext FROM {X.TYPED_SQL}")
def file_ext(t):
    return X.files(t).select("path", P.ext(F.col("path")).alias("ext"))


@query("file_route", f"SELECT path, route FROM {X.TYPED_SQL}")
def file_route(t):
    return L.with_types(X.files(t)).select("path", "route")


@query("file_hidden", f"SELECT path FROM {X.TYPED_SQL} WHERE is_hidden")
def file_hidden(t):
    return X.files(t).where(P.is_hidden(F.col("path"))).select("path")


@query("file_magic", f"SELECT path, detected_ext FROM {X.TYPED_SQL}")
def file_magic(t):
    return L.with_types(X.files(t)).select("path", "detected_ext")


@query("file_type_mismatch", f"SELECT path, ext, detected_ext FROM {X.TYPED_SQL} WHERE ext <> detected_ext")
def file_type_mismatch(t):
    return L.type_mismatch(L.with_types(X.files(t))).select("path", "ext", "detected_ext")


# Every third document in the Chinese code page, a word of it before its ASCII part; the others in UTF-8.
_ASCII_SQL = "regexp_replace(text, '[^ -~' || chr(10) || ']', '', 'g')"


def _coded(t, others):
    """doc_id and content: GBK bytes of two characters and the ASCII part of the text, or ``others``."""
    ascii_part = F.encode(F.regexp_replace("text", "[^ -~\n]", ""), "utf-8")
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("机密".encode("gbk").hex())), ascii_part)).otherwise(others)
    return t.documents.select("doc_id", content.alias("content"))


@query("file_decode_text", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '机密' || {_ASCII_SQL} ELSE text END AS text FROM documents")
def file_decode_text(t):
    return _coded(t, F.encode("text", "utf-8")).select("doc_id", L.decode_text(F.col("content")).alias("text"))


@query("file_carve_strings", f"""
SELECT doc_id, CASE WHEN len(runs) > 0 THEN array_to_string(runs, chr(10)) END AS text
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['机密'] ELSE [] END || regexp_extract_all({_ASCII_SQL}, {Q.lit('[ -~]{4,}')}) AS runs FROM documents)""")
def file_carve_strings(t):
    plain = F.encode(F.regexp_replace("text", "[^ -~\n]", ""), "utf-8")
    return _coded(t, plain).select("doc_id", L.carve_strings(F.col("content")).alias("text"))


@query("file_archive_encrypted", f"SELECT path, status FROM {X.ARCHIVES_SQL}")
def file_archive_encrypted(t):
    return archives(t).select("path", "status")


@query("file_status", f"SELECT path, status, reason FROM {X.CHECKED_SQL}")
def file_status(t):
    return checked(t).select("path", "status", "reason")


@query("file_low_text", f"SELECT path FROM {X.TYPED_SQL} WHERE size > 10240 AND length({Q.strip('text')}) < 10")
def file_low_text(t):
    return X.files(t).where(P.low_text(F.col("size"), F.col("text"))).select("path")


@query("file_findings", f"SELECT path, file_type, line_no, content, keyword FROM {FOUND}")
def file_findings(t):
    return findings(t)


@query("file_type_counts", f"SELECT detected_ext, count(*) AS n FROM {X.TYPED_SQL} WHERE route = 'document' GROUP BY 1")
def file_type_counts(t):
    return L.type_counts(checked(t))


@query("file_summary", f"""
SELECT count(*) FILTER (WHERE route = 'document') AS supported_files,
    (SELECT count(DISTINCT path) FROM {FOUND}) AS matched_files,
    count(*) FILTER (WHERE route = 'document' AND status = 'encrypted') AS encrypted_files,
    count(*) FILTER (WHERE route = 'document' AND status = 'damaged') AS damaged_files,
    count(*) FILTER (WHERE is_hidden) AS hidden_files,
    (SELECT count(*) FROM {X.ARCHIVES_SQL}) AS archives_scanned,
    (SELECT count(*) FROM {X.ARCHIVES_SQL} WHERE status = 'encrypted') AS encrypted_archives
FROM {X.CHECKED_SQL}""")
def file_summary(t):
    return file_check(t).summary().drop("findings")


_ZIPPED = f"(SELECT '/z/' || doc_id || '.zip' AS path, '[in archive .txt]' AS file_type, line_no, content, keyword FROM {Q.findings('documents', 'doc_id', KW)})"


def _with_zips(t):
    """The files, and every document in an archive besides."""
    zips = X.archives(t).select("path", "content", F.octet_length("content").cast("long").alias("size"),
                                F.lit(None).cast("string").alias("text"), F.lit("ok").alias("extract_status"))
    return C.check_files(X.files(t).where(P.route(P.ext(F.col("path"))) != "archive").drop("doc_id").unionByName(zips), KW, expand=True)


@query("file_check", f"""
SELECT count(*) FILTER (WHERE route = 'document') AS supported_files,
    (SELECT count(DISTINCT path) FROM {FOUND}) + (SELECT count(DISTINCT path) FROM {_ZIPPED}) AS matched_files,
    count(*) FILTER (WHERE route = 'document' AND status = 'encrypted') AS encrypted_files,
    count(*) FILTER (WHERE route = 'document' AND status = 'damaged') AS damaged_files,
    count(*) FILTER (WHERE is_hidden) AS hidden_files, (SELECT count(*) FROM documents) AS archives_scanned, 0 AS encrypted_archives,
    (SELECT count(*) FROM {FOUND}) + (SELECT count(*) FROM {_ZIPPED}) AS findings
FROM {X.CHECKED_SQL} WHERE route <> 'archive'""")
def file_check_counters(t):
    return _with_zips(t).summary()


@query("file_check_findings", f"SELECT path, file_type, line_no, content, keyword FROM {FOUND} UNION ALL SELECT * FROM {_ZIPPED}")
def file_check_findings(t):
    return _with_zips(t).findings()


REGISTRY_SQL = f"""(SELECT doc_id, path, detected_ext AS ext, 'file' AS kind, 'encrypted' AS status FROM {X.CHECKED_SQL}
    WHERE route = 'document' AND status = 'encrypted'
    UNION ALL SELECT doc_id, path, ext, 'archive', 'encrypted' FROM {X.ARCHIVES_SQL} WHERE status = 'encrypted')"""


def file_check(t):
    """The files in one pass."""
    return C.check_files(X.files(t), KW)


def registry(t):
    return file_check(t).registry()


@query("enc_registry", f"SELECT path, ext, kind, status FROM {REGISTRY_SQL}")
def enc_registry(t):
    return registry(t).select("path", "ext", "kind", "status")


def attempted(t):
    """Every second file opens; its findings are those of the document text, counted where it is read."""
    doc = F.col("doc_id")
    results = t.documents.where(doc % 3 != 2).select(
        X.file_path().alias("path"), (doc % 2 == 0).alias("ok"), F.when(doc % 2 == 0, F.size(W.finding_array(F.col("text"), KW))).alias("matched"))
    return L.apply_results(registry(t), results)


ATTEMPT_SQL = f"""(SELECT r.path, r.ext, r.kind, CASE WHEN r.doc_id % 3 = 2 THEN r.status
        WHEN r.doc_id % 2 = 0 THEN 'decrypted' ELSE 'failed' END AS status,
    CASE WHEN r.doc_id % 3 <> 2 AND r.doc_id % 2 = 0 THEN coalesce(n, 0) END AS matched
    FROM {REGISTRY_SQL} r LEFT JOIN (SELECT doc_id, count(*) AS n FROM {Q.matches('documents', 'doc_id', KW)} GROUP BY 1) USING (doc_id))"""


@query("enc_apply_attempt", f"SELECT path, ext, kind, status, matched FROM {ATTEMPT_SQL}")
def enc_apply_attempt(t):
    return attempted(t)


@query("enc_skip_all", f"SELECT path, 'skipped' AS status FROM {REGISTRY_SQL}")
def enc_skip_all(t):
    return L.skip_all(registry(t)).select("path", "status")


@query("enc_retry_set", f"SELECT path, kind FROM {ATTEMPT_SQL} WHERE status = 'failed'")
def enc_retry_set(t):
    return L.retry_set(attempted(t)).select("path", "kind")


@query("run_pending", """
SELECT DISTINCT source, lang FROM documents
EXCEPT SELECT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def run_pending(t):
    """Units are (source, language); those with a toxic label count as completed."""
    units = t.documents.select("source", "lang").distinct()
    log = t.documents.join(t.labels.where("toxic = 1"), "doc_id").select(
        "source", "lang", F.lit("completed").alias("status"))
    return L.pending_modules(units, log, ["source", "lang"])


@query("st_dedupe", """
SELECT md5(text) AS md5, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def st_dedupe(t):
    from lineward.streaming.jobs import first_of_each

    return first_of_each(t.documents.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("md5")), "doc_id")
