"""Sources, sinks, plug-in jobs and streams, fed from the tables.

Streams and sinks write below the session's checkpoint folder, each call in a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lineward.operators import files as L
from lineward.operators import images as I
from lineward.operators import keyword_scan as S
from lineward.operators import report as R
from lineward.operators import scoring as M
from lineward.operators import tables as T
from lineward.operators import web as W
from lineward.plans import fixtures as X
from lineward.plans import report_queries as RQ
from lineward.plans import sqltext as Q
from lineward.plans import table_queries as TQ
from lineward.plans.keyword_queries import KW, KWT
from lineward.plans.registry import SQL, query
from lineward.schemas import PAGE, PAGE_STATE
from lineward.session import ensure_checkpoint_dir
from lineward.sources import delta_state as D
from lineward.sources import inventory as N
from lineward.sources import jdbc as J
from lineward.sources import run_log as RL
from lineward.sources import state as St
from lineward.streaming import jobs as Str


def _folder(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"


@query("src_list_databases", """
SELECT event_id, name FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'MySQL' WHEN 1 THEN 'Performance_Schema'
    ELSE event_type END AS name FROM events) WHERE lower(name) NOT IN ('mysql', 'information_schema', 'performance_schema', 'sys')""")
def src_list_databases(t):
    kind = F.col("event_id") % 4
    names = t.events.select("event_id", F.when(kind == 0, "MySQL").when(kind == 1, "Performance_Schema")
                            .otherwise(F.col("event_type")).alias("name"))
    return J.list_databases(names, "mysql")


def _document_files(t) -> str:
    """A folder tree with the documents as text files, ten to a file, in order."""
    path = _folder(t)
    lines = t.documents.select("doc_id", F.floor(F.col("doc_id") / 10).alias("ten"), F.col("text").alias("value"))
    lines.repartition("ten").sortWithinPartitions("ten", "doc_id").select("ten", "value").write.partitionBy("ten").text(path)
    return path


_DOCUMENT_FILES = """(SELECT doc_id // 10 AS ten, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)"""


def _ten() -> F.Column:
    return F.regexp_extract("path", "/ten=([0-9]+)/", 1).cast("long").alias("ten")


@query("src_file_inventory", f"""
SELECT ten, octet_length(encode(content)) AS size, '.txt' AS ext, 'document' AS route, FALSE AS is_hidden FROM {_DOCUMENT_FILES}""")
def src_file_inventory(t):
    found, _ = N.file_inventory(t.spark, _document_files(t))
    return found.where("not is_hidden").select(_ten(), "size", "ext", "route", "is_hidden")


@query("src_binary", f"SELECT ten, octet_length(encode(content)) AS size, md5(content) AS md5 FROM {_DOCUMENT_FILES}")
def src_binary(t):
    return N.read_binary(t.spark, _document_files(t), [".txt"]).select(_ten(), "size", F.md5("content").alias("md5"))


@query("state_save_load", f"SELECT url, content_hash, etag, last_modified FROM {X.STATE_SQL}")
def state_save_load(t):
    path = _folder(t)
    ok, message = St.save_state(X.page_state(t, KW), path)
    if not ok:
        raise RuntimeError(message)
    return St.load_state(t.spark, path, PAGE_STATE).select("url", "content_hash", "etag", "last_modified")


@query("sink_findings", f"""
SELECT 'file' AS module, 'r1' AS run_id, CAST(doc_id AS VARCHAR) AS container, line_no, content, keyword
FROM {Q.findings('documents', 'doc_id', KW)}
UNION ALL SELECT 'db', 'r1', "table", NULL, NULL, keyword FROM ({TQ.findings_group_sql('part', KWT)})""")
def sink_findings(t):
    path = _folder(t)
    docs = S.line_findings(t.documents.select("doc_id", "text"), KW)
    parts = T.database_findings(TQ.specs(t, ["part"]), KWT)
    St.write_findings(R.union_findings([R.as_findings(docs, "file", "doc_id"), R.as_findings(parts, "db", "table")]), path, "r1")
    return t.spark.read.parquet(path).select("module", "run_id", "container", "line_no", "content", "keyword")


@query("sink_markdown", f"SELECT line FROM ({SQL['rep_markdown']})")
def sink_markdown(t):
    path = _folder(t)
    St.write_markdown(R.assemble([RQ.rep_markdown(t)]), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("file_extract", "SELECT doc_id, text, 'ok' AS extract_status FROM documents")
def file_extract(t):
    files = t.documents.select("doc_id", F.concat(F.lit("/d/"), "doc_id", F.lit(".txt")).alias("path"),
                               F.encode("text", "utf-8").alias("content"))
    return L.extract(L.with_types(files)).select("doc_id", "text", "extract_status")


@query("file_expand_archives", f"""
SELECT '/z/' || doc_id || '.zip' AS path,
       CASE WHEN doc_id % 3 = 0 THEN 'inner.zip!' ELSE '' END || 'd' || doc_id || '.txt' AS member_path,
       '[in archive .txt]' AS file_type, line_no, content, keyword FROM {Q.findings('documents', 'doc_id', KW)}""")
def file_expand_archives(t):
    ensure_checkpoint_dir(t.spark)
    members, _ = L.expand_archives(X.archives(t).checkpoint())
    return L.member_findings(members, KW)


@query("img_apply_ocr", f"""
SELECT DISTINCT i.md5, r.text, r.position, r.md5 IS NULL AS failed FROM {X.IMAGES_SQL} i
LEFT JOIN (SELECT DISTINCT m.md5, c.text, CASE WHEN c.turn % 2 = 0 THEN 'top' ELSE '' END AS position FROM conversations c
           JOIN (SELECT md5(text) AS md5, min(conv_id) AS conv_id FROM conversations WHERE turn = 0 AND conv_id % 3 > 0 GROUP BY 1) m USING (conv_id)) r USING (md5)""")
def img_apply_ocr(t):
    """Results stored by content, of conversations two in three: their turns are the items that were read."""
    known = t.conversations.where("turn = 0 AND conv_id % 3 > 0").groupBy(F.md5(F.encode("text", "utf-8")).alias("md5")).agg(F.min("conv_id").alias("conv_id"))
    item = F.struct("text", F.lit(0.9).alias("confidence"), F.when(F.col("turn") % 2 == 0, "top").otherwise("").alias("position"))
    results = t.conversations.join(known, "conv_id").groupBy("md5").agg(F.collect_list(item).alias("ocr_items"))
    read = I.apply_results(I.with_md5(X.images(t)).select("md5").distinct(), results)
    return read.select("md5", F.inline_outer("ocr_items"), "failed").select("md5", "text", "position", "failed").distinct()


@query("llm_score", f"""
WITH asked AS (SELECT doc_id, window_no, md5(prompt) AS k FROM ({SQL['llm_prompt']})),
known AS (SELECT k, CAST(min(window_no) AS VARCHAR) AS response FROM asked WHERE doc_id % 3 > 0 GROUP BY k)
SELECT doc_id, window_no, response, CASE WHEN response IS NULL THEN 'no stored answer' END AS error
FROM asked LEFT JOIN known USING (k)""")
def llm_score(t):
    """Stored answers, known for the prompts of two documents in three."""
    asked = M.prompts(t.documents.select("doc_id", "text"), KW, "text")
    known = asked.where("doc_id % 3 > 0").select(F.md5("prompt").alias("prompt_key"), F.col("window_no").cast("string").alias("response"))
    return M.stored_scorer(known)(asked).select("doc_id", "window_no", "response", "error")


def _drain(writer, folder: str) -> None:
    run = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()


@query("st_scan", f"SELECT doc_id, line_no, content, keyword FROM {Q.findings('documents', 'doc_id', KW)}")
def st_scan(t):
    folder, schema = _folder(t), t.documents.schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.root.rstrip('/')}/document[s].parquet")
    found = Str.scan_stream(stream.select("doc_id", "text"), KW)
    _drain(found.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    return t.spark.read.parquet(f"{folder}/out").select("doc_id", "line_no", "content", "keyword")


def _visits(t):
    pid, html = F.col("page_id"), F.col("html")
    body = F.when((F.col("visit") == 2) & (pid % 3 == 1), F.concat(html, F.lit("x"))).otherwise(html)
    both = t.pages.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("visit")).where((F.col("visit") == 1) | (pid % 3 != 2))
    return both.select("url", body.alias("html"), F.lit("").alias("etag"), F.lit("").alias("last_modified"),
                       F.timestamp_seconds("visit").alias("fetched_at"))


@query("st_change_detect", """
SELECT url, 1 AS visit, 'new' AS status FROM pages
UNION ALL SELECT url, 2, CASE WHEN page_id % 3 = 1 THEN 'changed' ELSE 'not_modified' END FROM pages WHERE page_id % 3 <> 2""")
def st_change_detect(t):
    folder = _folder(t)

    def visit() -> None:
        changes = Str.detect_changes(Str.read_pages(t.spark, f"{folder}/in", PAGE))
        _drain(changes.writeStream.format("parquet").option("path", f"{folder}/out"), folder)

    _visit_twice(t, folder, visit)
    return t.spark.read.parquet(f"{folder}/out").select(
        "url", F.unix_seconds("fetched_at").cast("int").alias("visit"), "status")


def _visit_twice(t, folder: str, run) -> None:
    """The stream goes on where it stopped: the second visit arrives after the first has been handled."""
    for visit in (1, 2):
        _visits(t).where(F.unix_seconds("fetched_at") == visit).write.mode("append").parquet(f"{folder}/in")
        run()


_CHANGED = "(SELECT page_id, url, html || 'x' AS html FROM pages WHERE page_id % 3 = 1)"
_UNCHANGED = "(SELECT page_id, url, html FROM pages WHERE page_id % 3 = 0)"


@query("st_incremental_scan", f"""
SELECT url, line_no, content, keyword, FALSE AS from_cache, 1 AS visit FROM {Q.findings(X.text_sql('pages', 'url'), 'url', KW)}
UNION ALL SELECT url, line_no, content, keyword, FALSE, 2 FROM {Q.findings(X.text_sql(_CHANGED, 'url'), 'url', KW)}
UNION ALL SELECT url, line_no, content, keyword, TRUE, 2 FROM {Q.findings(X.text_sql(_UNCHANGED, 'url'), 'url', KW)}""")
def st_incremental_scan(t):
    folder = _folder(t)

    def visit() -> None:
        stream = Str.read_pages(t.spark, f"{folder}/in", PAGE)
        _drain(Str.incremental_scan_stream(stream, KW, f"{folder}/state", f"{folder}/out"), folder)

    _visit_twice(t, folder, visit)
    return t.spark.read.parquet(f"{folder}/out").select(
        "url", "line_no", "content", "keyword", "from_cache", (F.col("batch") + 1).cast("int").alias("visit"))


@query("web_page_findings_text", f"SELECT url, count(*) AS n FROM {Q.findings(X.text_sql('pages', 'url'), 'url', KW)} GROUP BY url")
def web_page_findings_text(t):
    """Findings per page from the array form that is kept in the state."""
    scanned = W.page_text(t.pages).select("url", F.size(W.finding_array(F.col("text"), KW)).cast("long").alias("n"))
    return scanned.where("n > 0")


# --- state as changes, runs taken up again, copies in a stream -------------------------------------

@query("state_changes", SQL["web_state_upsert"])
def state_changes(t):
    """The state saved whole, a visit saved as changes, both compacted: the rows of the next state."""
    path, state = f"{_folder(t)}/pages", X.page_state(t, KW)
    D.save_changes(state, path)
    known = D.load_state(t.spark, path, PAGE_STATE)
    scanned = W.rescan(W.classify(W.scan_pages(X.snapshot(t, True), KW), known), KW)
    D.save_changes(W.state_changes(scanned), path)
    D.compact(t.spark, path, PAGE_STATE)
    D.remove_old(t.spark, path, keep=1)
    return D.load_state(t.spark, path, PAGE_STATE).select(
        "url", "content_hash", "etag", "last_modified", F.coalesce(F.size("findings"), F.lit(0)).cast("long").alias("n_findings"),
        F.coalesce(F.size("links"), F.lit(0)).cast("long").alias("n_links"))


@query("run_resume", SQL["rep_union"])
def run_resume(t):
    """A run whose second module fails, taken up again: the first module is not worked out twice."""
    path, ran, broken = _folder(t), [], [True]

    def module(name, work):
        def run():
            ran.append(name)
            if name == "web" and broken:
                broken.clear()
                raise ConnectionError("site is away")
            return work().select("module", "container", "locator", "line_no", "content", "keyword")
        return run

    def table_rows():
        return R.as_findings(T.database_findings(TQ.specs(t, ["part"]), KWT), "db", "table", F.concat_ws("#", "field", "record_id"))

    modules = {
        "file": module("file", lambda: R.as_findings(S.line_findings(t.documents.select("doc_id", "text"), KW), "file", "doc_id")),
        "web": module("web", lambda: R.as_findings(W.page_findings(t.pages, KW), "web", "url")), "db": module("db", table_rows)}
    try:
        RL.run_modules(t.spark, path, modules)
    except ConnectionError:
        pass
    results = RL.run_modules(t.spark, path, modules)
    if ran != ["file", "web", "web", "db"]:
        raise RuntimeError(f"modules ran as {ran}")
    return R.union_findings(list(results.values()))


_HOUR = 3600


def dedupe_visits(t):
    """(md5, visit, time): all documents; copies half an hour later; copies after four hours, and again half an hour after these."""
    doc = F.col("doc_id")
    visits = F.array(F.lit(1), F.when(doc % 3 == 0, 2), F.when(doc % 5 == 0, 3), F.when(doc % 2 == 0, 4))
    rows = t.documents.select("doc_id", F.md5(F.encode("text", "utf-8")).alias("md5"), F.explode(F.array_compact(visits)).alias("visit"))
    late = F.element_at(F.array(*[F.lit(x) for x in (0, _HOUR // 2, 4 * _HOUR, 4 * _HOUR + _HOUR // 2)]), F.col("visit"))
    return rows.select("md5", "visit", F.timestamp_seconds(10 * _HOUR + late + doc % 600).alias("time"))


def dedupe_run(t, folder: str, rows, visits=(1, 2, 3, 4)):
    """Feed the visits one after the other to a stream that remembers contents for an hour; yields each one's progress."""
    for visit in visits:
        rows.where(F.col("visit") == visit).write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        once = Str.dedupe_stream(stream, "md5", "time", "1 hour")
        run = once.writeStream.format("parquet").option("path", f"{folder}/out").option(
            "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        run.awaitTermination()
        yield visit, run.lastProgress


@query("st_dedupe_stream", """
SELECT DISTINCT md5(text) AS md5, 1 AS visit FROM documents UNION ALL SELECT DISTINCT md5(text), 4 FROM documents WHERE doc_id % 2 = 0""")
def st_dedupe_stream(t):
    """Copies within the hour are dropped; the fourth visit finds the memory of the first expired, as the third moved the time on."""
    folder = _folder(t)
    for _ in dedupe_run(t, folder, dedupe_visits(t)):
        pass
    return t.spark.read.parquet(f"{folder}/out").select("md5", "visit")
