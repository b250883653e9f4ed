"""Report parts over the results of the other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineward.functions import display as D
from lineward.operators import files as L
from lineward.operators import images as I
from lineward.operators import keyword_scan as S
from lineward.operators import report as R
from lineward.operators import tables as T
from lineward.operators import web as W
from lineward.plans import file_queries as FQ
from lineward.plans import fixtures as X
from lineward.plans import image_queries as IQ
from lineward.plans import sqltext as Q
from lineward.plans import table_queries as TQ
from lineward.plans import web_queries as WQ
from lineward.plans.keyword_queries import KW, KWT
from lineward.plans.registry import query
from lineward.session import ensure_checkpoint_dir

_TABLES = ["part", "orders", "customer"]


@query("rep_union", f"""
SELECT 'file' AS module, CAST(doc_id AS VARCHAR) AS container, NULL AS locator, line_no, content, keyword
FROM {Q.findings('documents', 'doc_id', KW)}
UNION ALL SELECT 'web', url, NULL, line_no, content, keyword FROM {Q.findings(X.text_sql('pages', 'url'), 'url', KW)}
UNION ALL SELECT 'db', "table", field || '#' || record_id, NULL, NULL, keyword FROM ({TQ.findings_group_sql('part', KWT)})""")
def rep_union(t):
    docs = S.line_findings(t.documents.select("doc_id", "text"), KW)
    parts = T.database_findings(TQ.specs(t, ["part"]), KWT)
    return R.union_findings([
        R.as_findings(docs, "file", "doc_id"),
        R.as_findings(W.page_findings(t.pages, KW), "web", "url"),
        R.as_findings(parts, "db", "table", F.concat_ws("#", "field", "record_id")),
    ]).select("module", "container", "locator", "line_no", "content", "keyword")


def counts(t):
    ensure_checkpoint_dir(t.spark)
    scanned = WQ.scanned(t)
    cached = W.cached_only(W.incremental_findings(scanned)).agg(F.count("*").alias("cached_matched"))
    check = FQ.file_check(t)
    return R.union_findings([
        R.counters(W.incremental_counters(scanned), "web"), R.counters(cached, "web"),
        R.counters(T.totals(T.database_stats(TQ.specs(t, _TABLES), KWT)), "db"),
        R.counters(check.summary(), "file", {
            "supported_files": "supported_files", "matched_files": "matched_files",
            "archives_scanned": "archives_scanned", "damaged_files": "damaged", "hidden_files": "hidden"}),
        R.counters(R.encryption_note(check.registry()), "file"),
        R.counters(I.summary(I.inventory(X.images(t)), I.findings(IQ._items(t), KW)), "image"),
    ])


_STATS = TQ.union_sql(TQ.stats_sql(n, KWT) for n in _TABLES)
_COUNTS = f"""(SELECT 'web' AS module, (SELECT count(*) FROM pages) AS checked,
        (SELECT count(DISTINCT url) FROM (SELECT url FROM ({WQ._FRESH_FINDINGS}) UNION ALL SELECT url FROM ({WQ._OLD_FINDINGS}))) AS matched,
        (SELECT count(*) FILTER (WHERE status = 'not_modified') || ' skipped, '
             || count(*) FILTER (WHERE status <> 'not_modified') || ' new or changed' FROM {X.classified_sql(True)}) AS note
    UNION ALL SELECT 'db', (SELECT sum(total_records) FROM ({_STATS})), (SELECT count(*) FROM ({_STATS}) WHERE matched_records > 0),
        '3 tables, ' || (SELECT sum(candidate_records) FROM ({_STATS})) || ' candidates'
    UNION ALL SELECT 'file', (SELECT count(*) FROM {X.TYPED_SQL} WHERE route = 'document'), (SELECT count(DISTINCT path) FROM {FQ.FOUND}),
        (SELECT count(*) FROM {X.ARCHIVES_SQL}) || ' archives, ' || (SELECT count(*) FROM {FQ.REGISTRY_SQL}) || ' encrypted, '
        || (SELECT count(*) FROM {X.CHECKED_SQL} WHERE route = 'document' AND status = 'damaged') || ' damaged, '
        || (SELECT count(*) FROM {X.TYPED_SQL} WHERE is_hidden) || ' hidden'
    UNION ALL SELECT 'image', (SELECT count(*) FROM {X.IMAGES_SQL}), (SELECT count(DISTINCT image_path) FROM {IQ._FOUND}), 'OCR: N/A')"""


@query("rep_summary", f"SELECT module, CAST(checked AS BIGINT) AS checked, CAST(matched AS BIGINT) AS matched, note FROM {_COUNTS}")
def rep_summary(t):
    return R.summary(counts(t)).drop("seq")


@query("rep_grand_total", f"SELECT CAST(sum(matched) AS BIGINT) AS matched FROM {_COUNTS}")
def rep_grand_total(t):
    return R.grand_total(R.summary(counts(t)))


@query("rep_notes", f"SELECT module, note FROM {_COUNTS}")
def rep_notes(t):
    return R.notes(counts(t))


def _ellipsis(c, n):
    return f"CASE WHEN length({c}) > {n} THEN substring({c}, 1, {n}) || '...' ELSE {c} END"


def _sanitize(c, n=40):
    return f"replace(substring(replace(replace({c}, chr(13), ''), chr(10), ' '), 1, {n}), '|', '\\|')"


def _trim(c, n=5):
    parts = f"[trim(x) FOR x IN string_split({c}, ',') IF trim(x) <> '']"
    return (f"CASE WHEN len({parts}) > {n} THEN array_to_string({parts}[1:{n}], ', ') || ' and more, '"
            f" || len({parts}) || ' in all' ELSE {c} END")


@query("rep_web_sections", f"""
SELECT from_cache, row_number() OVER (PARTITION BY from_cache ORDER BY url, line_no, content) AS seq,
       {_ellipsis('url', 60)} AS url, line_no, {_trim('keyword')} AS keyword, {_sanitize('content')} AS content
FROM ({WQ._FRESH_FINDINGS} UNION ALL {WQ._OLD_FINDINGS})""")
def rep_web_sections(t):
    return R.web_sections(W.incremental_findings(WQ.scanned(t)))


@query("rep_table_stats", f"SELECT \"table\", total_records, matched_records, n_text_columns, n_columns FROM ({_STATS})")
def rep_table_stats(t):
    return R.table_stats(T.database_stats(TQ.specs(t, _TABLES), KWT))


@query("rep_type_counts", f"""
SELECT detected_ext AS ext, upper(substring(detected_ext, 2)) AS name, count(*) AS n
FROM {X.TYPED_SQL} WHERE route = 'document' GROUP BY 1, 2""")
def rep_type_counts(t):
    return R.type_counts(L.type_counts(FQ.checked(t)), "detected_ext")


@query("rep_encrypted", f"""
SELECT row_number() OVER (ORDER BY path) AS seq, path, upper(substring(ext, 2)) AS type,
       CASE status WHEN 'failed' THEN 'not decrypted' WHEN 'encrypted' THEN 'not handled' ELSE status END AS status,
       CASE WHEN status = 'decrypted' THEN matched || ' findings' ELSE '-' END AS found
FROM {FQ.ATTEMPT_SQL}""")
def rep_encrypted(t):
    return R.encrypted_list(FQ.attempted(t))


@query("rep_enc_note", f"""
SELECT count(*) AS encrypted, count(*) FILTER (WHERE status = 'decrypted') AS decrypted FROM {FQ.ATTEMPT_SQL}""")
def rep_enc_note(t):
    return R.encryption_note(FQ.attempted(t))


def _list_sql(src: str) -> str:
    return f"""SELECT 0 AS seq, '**' || count(*) || '** in all:' AS line FROM {src}
        UNION ALL SELECT n, n || '. `' || path || '`' FROM (SELECT path, row_number() OVER (ORDER BY path) AS n FROM {src})"""


@query("rep_file_list", f"""
SELECT 'damaged' AS list, * FROM ({_list_sql(f"(SELECT path FROM {X.CHECKED_SQL} WHERE route = 'document' AND status = 'damaged')")})
UNION ALL SELECT 'hidden', * FROM ({_list_sql(f"(SELECT path FROM {X.TYPED_SQL} WHERE is_hidden)")})
UNION ALL SELECT 'none', 0, 'No such files.'""")
def rep_file_list(t):
    checked = FQ.checked(t)
    lists = {
        "damaged": checked.where("route = 'document' AND status = 'damaged'"),
        "hidden": checked.where("is_hidden"), "none": checked.where("status = 'absent'")}
    return R.union_findings([
        R.file_list(paths, "No such files.").withColumn("list", F.lit(name)) for name, paths in lists.items()])


@query("rep_number", f"""
SELECT row_number() OVER (ORDER BY container, line_no, keyword, content) AS seq, container, line_no, content, keyword
FROM (SELECT CAST(doc_id AS VARCHAR) AS container, line_no, content, keyword FROM {Q.findings('documents', 'doc_id', KW)})""")
def rep_number(t):
    found = S.line_findings(t.documents.select(F.col("doc_id").cast("string").alias("container"), "text"), KW)
    return R.numbered(found)


@query("rep_sanitize", f"SELECT doc_id, {_sanitize(chr(39) + 'a|b' + chr(39) + ' || text')} AS text FROM documents")
def rep_sanitize(t):
    return t.documents.select("doc_id", D.sanitize(F.concat(F.lit("a|b"), "text")).alias("text"))


@query("rep_trim_keywords", f"SELECT doc_id, {_trim('words')} AS keyword FROM (SELECT doc_id, translate(text, ' ' || chr(10) || chr(9) || chr(13), ',,,,') AS words FROM documents)")
def rep_trim_keywords(t):
    """All words of a document as its keyword list."""
    return t.documents.select("doc_id", D.trim_keywords(F.translate("text", " \n\t\r", ",,,,")).alias("keyword"))


@query("rep_visual_width", """
SELECT doc_id, length(text) + 2 * (doc_id % 5) + 2 * CAST(doc_id % 3 = 0 AS INTEGER) + CAST(doc_id % 2 = 0 AS INTEGER) AS width FROM documents""")
def rep_visual_width(t):
    doc = F.col("doc_id")
    mixed = F.concat("text", F.expr("repeat('密', cast(doc_id % 5 as int))"),
                     F.when(doc % 3 == 0, "（").otherwise(""), F.when(doc % 2 == 0, "ﾊ").otherwise(""))
    return t.documents.select("doc_id", D.visual_width(mixed).cast("long").alias("width"))


_PATH_SQL = """(SELECT doc_id, '/data/' || source || '/' || repeat('dir/', CAST(doc_id % 12 AS INTEGER)) || repeat('n', CAST(doc_id % 45 AS INTEGER))
    || 'doc' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.docx' END AS path FROM documents)"""


@query("rep_truncate_path", f"""
SELECT doc_id, CASE WHEN length(path) <= 40 THEN path ELSE substring(path, 1, 14) || '/.../' ||
    CASE WHEN length(name) <= 22 THEN name
         WHEN contains(name, '.') THEN substring(name, 1, least(length(name) - 5, 16)) || '~.docx'
         ELSE substring(name, 1, 21) || '~' END END AS path
FROM (SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM {_PATH_SQL})""")
def rep_truncate_path(t):
    path = F.expr("""concat('/data/', source, '/', repeat('dir/', cast(doc_id % 12 as int)), repeat('n', cast(doc_id % 45 as int)),
        'doc', doc_id, if(doc_id % 4 = 0, '', '.docx'))""")
    return t.documents.select("doc_id", D.truncate_path(path).alias("path"))


@query("rep_truncate", f"SELECT page_id, {_ellipsis('url || url', 60)} AS url, {_ellipsis('url', 40)} AS directory FROM pages")
def rep_truncate(t):
    return t.pages.select("page_id", D.ellipsis(F.concat("url", "url"), D.URL_CHARS).alias("url"),
                          D.ellipsis(F.col("url"), D.DIRECTORY_CHARS).alias("directory"))


@query("rep_markdown", f"""
SELECT -1 AS seq, '| No. | Table | Field | Record | Keywords |' AS line UNION ALL SELECT 0, '|-----|-----|-----|-----|-----|'
UNION ALL SELECT n, '| ' || n || ' | ' || "table" || ' | ' || field || ' | ' || record_id || ' | ' || {_trim('keyword')} || ' |'
FROM (SELECT *, row_number() OVER (ORDER BY "table", field, record_id) AS n FROM ({TQ.findings_group_sql('part', KWT)}))""")
def rep_markdown(t):
    rows = R.numbered(T.database_findings(TQ.specs(t, ["part"]), KWT), ["table", "field", "record_id"])
    return R.table_lines(rows, ["No.", "Table", "Field", "Record", "Keywords"],
                         ["seq", "table", "field", "record_id", D.trim_keywords(F.col("keyword"))])
