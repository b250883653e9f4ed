"""Inputs the checked queries derive from the tables: Spark frames and the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.functions import html as H
from lineward.functions.binding import let
from lineward.functions import urls as U
from lineward.operators import web as W
from lineward.operators.numbering import number_within
from lineward.plans import sqltext as Q

# --- pages ---------------------------------------------------------------------------------------

def _when(test, value):
    return F.when(test, value).otherwise("")


def snapshot(t, failed: bool = False) -> DataFrame:
    """Pages with validators; with ``failed`` some have no body and no validators."""
    pid = F.col("page_id")
    etag = _when(pid % 5 == 0, F.concat(F.lit("e"), pid))
    modified = _when(pid % 8 == 0, F.concat(F.lit("n"), pid))
    html = F.col("html")
    if failed:
        read = pid % 49 != 48
        html, etag, modified = (F.when(read, c) for c in (html, etag, modified))
    return t.pages.select("page_id", "url", html.alias("html"), etag.alias("etag"),
                          modified.alias("last_modified"))


def snapshot_sql(failed: bool = False) -> str:
    sql = """SELECT page_id, url, html,
        CASE WHEN page_id % 5 = 0 THEN 'e' || page_id ELSE '' END AS etag,
        CASE WHEN page_id % 8 = 0 THEN 'n' || page_id ELSE '' END AS last_modified FROM pages"""
    if failed:
        sql = f"""SELECT page_id, url, CASE WHEN page_id % 49 <> 48 THEN html END AS html,
            CASE WHEN page_id % 49 <> 48 THEN etag END AS etag,
            CASE WHEN page_id % 49 <> 48 THEN last_modified END AS last_modified FROM ({sql})"""
    return f"({sql})"


def page_state(t, keywords: list[str]) -> DataFrame:
    """An earlier state of two thirds of the pages, half of these with another body."""
    pid = F.col("page_id")
    old_findings = F.transform(
        W.finding_array(H.visible_text(F.col("html")), keywords),
        lambda x: x.withField("content", F.concat(F.lit("old "), x["content"])))
    old_links = F.transform(W.link_array(F.col("url"), F.col("html")),
                            lambda u: F.concat(u, F.lit("?s=1")))
    body = F.when(pid % 3 == 1, F.concat("html", F.lit("x"))).otherwise(F.col("html"))
    return t.pages.where(pid % 3 != 2).select(
        "url", W.content_hash(body).alias("content_hash"),
        _when(pid % 5 == 0, F.concat(F.lit("e"), pid)).alias("etag"),
        _when(pid % 4 == 0, F.concat(F.lit("m"), pid)).alias("last_modified"),
        F.lit(None).cast("timestamp").alias("last_checked"),
        old_links.alias("links"), old_findings.alias("findings"))


STATE_SQL = """(SELECT page_id, url, html,
    md5(CASE WHEN page_id % 3 = 1 THEN html || 'x' ELSE html END) AS content_hash,
    CASE WHEN page_id % 5 = 0 THEN 'e' || page_id ELSE '' END AS etag,
    CASE WHEN page_id % 4 = 0 THEN 'm' || page_id ELSE '' END AS last_modified
    FROM pages WHERE page_id % 3 <> 2)"""


def _re2(pattern: str) -> str:
    """Possessive quantifiers do not exist in RE2, which needs none."""
    return pattern.replace("++", "+").replace("*+", "*")


def text_sql(src: str, cols: str) -> str:
    """Visible text; the fixture pages hold the entities amp, quot, copy and middot only."""
    blank = Q.lit(" \t\n\f\r")
    nodes = f"""[CASE WHEN trim(x, {blank}) <> '' THEN x WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END
        FOR x IN string_split(regexp_replace(html, {Q.lit(_re2(H.MARKUP))}, chr(1), 'g'), chr(1)) IF x <> '']"""
    text = f"array_to_string({nodes}, chr(10))"
    for name, ch in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{ch}')"
    return f"(SELECT {cols}, {text} AS text FROM {src} WHERE html IS NOT NULL)"


HOST_SQL = "regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
ROOT_SQL = "regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0)"


def links_sql(src: str, cols: str) -> str:
    """Links of the fixture pages, which are all relative to the site root."""
    anchors = (f"regexp_extract_all(regexp_replace(html, {Q.lit(_re2(H.OPAQUE))}, '', 'g'),"
               f" {Q.lit(_re2(H.ANCHOR))})")
    return f"""(SELECT {cols}, split_part({ROOT_SQL.format('url')} || href, '#', 1) AS link FROM (
        SELECT {cols}, html, trim(regexp_extract(unnest({anchors}), {Q.lit(H.HREF)}, 1), {Q.lit('"' + "'")}) AS href
        FROM {src} WHERE html IS NOT NULL) WHERE starts_with(href, '/') AND NOT starts_with(href, '//'))"""


def classified_sql(failed: bool = False) -> str:
    return f"""(SELECT s.page_id, s.url, s.html, s.etag, s.last_modified, md5(s.html) AS content_hash,
        o.content_hash AS old_hash, o.etag AS old_etag, o.last_modified AS old_modified,
        CASE WHEN o.url IS NULL THEN 'new'
             WHEN s.etag <> '' AND s.etag = o.etag THEN 'not_modified'
             WHEN s.last_modified <> '' AND s.last_modified = o.last_modified THEN 'not_modified'
             WHEN s.html IS NULL THEN 'new'
             WHEN md5(s.html) = o.content_hash THEN 'not_modified' ELSE 'changed' END AS status
        FROM {snapshot_sql(failed)} s LEFT JOIN {STATE_SQL} o USING (url))"""


def site_tree(t) -> DataFrame:
    """Edges of a tree per host: page rank r links to ranks 2r, 2r+1 and back to 1."""
    ranked = number_within(t.pages.select("page_id", U.host(F.col("url")).alias("host")),
                           "host", ["page_id"], "r")
    node = lambda r: F.concat_ws("#", F.col("host"), r.cast("string"))
    nodes = ranked.select(node(F.col("r")).alias("node"), "host", "r")
    targets = F.array(F.col("r") * 2, F.col("r") * 2 + 1, F.lit(1).cast("long"))
    links = nodes.select("host", F.col("node").alias("src"), F.explode(targets).alias("to"))
    links = links.select("src", node(F.col("to")).alias("dst"))
    return links.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


SITE_SQL = f"""nodes AS (SELECT host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r
        FROM (SELECT page_id, {HOST_SQL.format('url')} AS host FROM pages)),
    edges AS (SELECT DISTINCT n.host || '#' || n.r AS src, m.host || '#' || m.r AS dst
        FROM nodes n JOIN nodes m ON n.host = m.host AND (m.r = 2 * n.r OR m.r = 2 * n.r + 1 OR m.r = 1))"""


def bfs_sql(seeds: str, depth: int = 20) -> str:
    return f"""WITH RECURSIVE {SITE_SQL},
    walk(seed, url, depth) AS (
        SELECT host || '#' || r, host || '#' || r, CAST(0 AS INTEGER) FROM nodes WHERE {seeds}
        UNION SELECT w.seed, e.dst, CAST(w.depth + 1 AS INTEGER) FROM walk w JOIN edges e ON e.src = w.url
        WHERE w.depth < {depth}),
    reached AS (SELECT seed, url, min(depth) AS depth FROM walk GROUP BY seed, url)"""


# --- images --------------------------------------------------------------------------------------

IMAGE_KINDS = [".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif"]


def _image_path():
    conv = F.col("conv_id")
    kind = F.get(F.array(*[F.lit(k) for k in IMAGE_KINDS]), (conv % 7).cast("int"))
    return F.concat(F.lit("/img/"), conv % 7, F.lit("/i"), conv, F.lit("_"), F.col("turn"), kind)


def images(t) -> DataFrame:
    """One image per turn of a conversation; its content is the text."""
    return t.conversations.select(
        "conv_id", _image_path().alias("image_path"), F.encode("text", "utf-8").alias("content"))


def img_cache(t) -> DataFrame:
    """Stored items for the contents of every second image."""
    from lineward.operators import images as I

    item = F.struct(F.col("text"), F.lit(0.9).alias("confidence"), F.lit("top").alias("position"))
    known = I.with_md5(images(t).where("conv_id % 2 = 0").withColumn("text", F.decode("content", "utf-8")))
    return known.groupBy("md5").agg(F.array(F.min(item)).alias("ocr_items"))


def ocr_items(t) -> DataFrame:
    """Every turn as a recognised item with a confidence and a box."""
    conv, turn = F.col("conv_id"), F.col("turn")
    top = (turn * 97) % 900
    return t.conversations.select(
        _image_path().alias("image_path"), "text",
        (((conv * 31 + turn * 17) % 100) / 100).alias("confidence"), top.alias("y_top"),
        (top + 40).alias("y_bottom"), F.when(conv % 29 == 0, 0).otherwise(1000).alias("height"))


_IMAGE_PATH_SQL = ("'/img/' || (conv_id % 7) || '/i' || conv_id || '_' || turn || ["
                   + ", ".join(Q.lit(k) for k in IMAGE_KINDS) + "][1 + conv_id % 7]")
IMAGES_SQL = f"(SELECT conv_id, {_IMAGE_PATH_SQL} AS image_path, md5(text) AS md5, text FROM conversations)"
OCR_SQL = f"""(SELECT {_IMAGE_PATH_SQL} AS image_path, text, ((conv_id * 31 + turn * 17) % 100) / 100.0 AS confidence,
    CASE WHEN conv_id % 29 = 0 THEN '' WHEN ((turn * 97) % 900 + 20) < 330 THEN 'top'
         WHEN ((turn * 97) % 900 + 20) < 660 THEN 'middle' ELSE 'bottom' END AS position FROM conversations)"""


# --- answers of a scorer -------------------------------------------------------------------------

def responses(t) -> DataFrame:
    """Answers of five kinds, built from the document texts."""
    words = F.regexp_replace("text", "[^a-zA-Z ]", "")
    answer = F.concat(F.lit('{"has_sensitive": true, "matches": [{"keyword": "k'), F.col("doc_id"),
                      F.lit('", "context": "'), words, F.lit('"}]}'))
    kind = F.col("doc_id") % 5
    text = (F.when(kind == 0, answer).when(kind == 1, F.concat(F.lit("Sure: "), answer, F.lit(" done.")))
            .when(kind == 2, '{"matches": []}').when(kind == 3, "yes, true").otherwise("no {broken} x"))
    return t.documents.select("doc_id", text.alias("response"))


# --- files ---------------------------------------------------------------------------------------

FILE_KINDS = [".txt", ".PDF", ".docx", ".xlsx", ".pptx", ".doc", ".zip", ".bin"]


def file_path():
    doc = F.col("doc_id")
    kind = F.get(F.array(*[F.lit(k) for k in FILE_KINDS]), (doc % 8).cast("int"))
    return F.concat(F.lit("/data/"), "source", F.lit("/"), F.when(doc % 17 == 0, ".").otherwise(""),
                    F.lit("d"), doc, kind)


def _reversed_hex(n):
    """Four bytes, lowest first."""
    return F.regexp_replace(F.lpad(F.hex(n), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1")


def _tiny_zip(text, inner: str, locked):
    """A ZIP head, the text, and a directory with one entry of the given name."""
    name = inner.encode().hex().upper()
    entry = F.concat(F.lit("504B0102" + "00" * 4), F.when(locked, "0100").otherwise("0000"),
                     F.lit("00" * 18 + "%02X00" % len(inner) + "00" * 16 + name))
    length = 46 + len(inner)
    end = F.concat(F.lit("504B0506" + "00000000" + "01000100"), _reversed_hex(F.lit(length)),
                   _reversed_hex(F.octet_length(text) + 4), F.lit("0000"))
    return F.concat(F.unhex(F.lit("504B0304")), text, F.unhex(entry), F.unhex(end))


def files(t) -> DataFrame:
    """Documents as files of many types, with heads that fit their extension or do not."""
    doc = F.col("doc_id")
    head = (F.floor(doc / 8) % 7).cast("int")
    body = F.encode("text", "utf-8")
    locked = doc % 13 == 0
    content = (
        F.when(head == 2, F.concat(F.encode(F.lit("%PDF"), "utf-8"), body))
        .when(head == 3, _tiny_zip(body, "word/document.xml", locked))
        .when(head == 4, _tiny_zip(body, "xl/workbook.xml", locked))
        .when(head == 5, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), body))
        .when(head == 6, F.concat(F.unhex(F.lit("504B0304")), F.encode(F.lit("xl/"), "utf-8"), body))
        .otherwise(body))
    padding = F.when(doc % 10 == 0, 20000).otherwise(0)
    return t.documents.select(
        "doc_id", file_path().alias("path"), content.alias("content"),
        (F.octet_length(body) + padding).cast("long").alias("size"),
        F.when(doc % 11 == 0, None).when(doc % 10 == 0, "  token ").otherwise(F.col("text")).alias("text"),
        F.when(locked, "encrypted").otherwise("ok").alias("extract_status"))


_EXT_SQL = "lower([" + ", ".join(Q.lit(k) for k in FILE_KINDS) + "][1 + doc_id % 8])"
_TYPED_SQL = f"""(SELECT doc_id, '/data/' || source || '/' || CASE WHEN doc_id % 17 = 0 THEN '.' ELSE '' END || 'd' || doc_id
        || [{', '.join(Q.lit(k) for k in FILE_KINDS)}][1 + doc_id % 8] AS path,
    {_EXT_SQL} AS ext, (doc_id // 8) % 7 AS head, doc_id % 13 = 0 AS locked, doc_id % 17 = 0 AS is_hidden,
    CASE WHEN doc_id % 8 < 6 THEN 'document' WHEN doc_id % 8 = 6 THEN 'archive' ELSE 'unsupported' END AS route,
    octet_length(encode(text)) + CASE WHEN doc_id % 10 = 0 THEN 20000 ELSE 0 END AS size,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN '  token ' ELSE text END AS text FROM documents)"""
TYPED_SQL = f"""(SELECT *, CASE WHEN route <> 'document' THEN ext WHEN head = 2 THEN '.pdf'
    WHEN head IN (3, 6) THEN '.docx' WHEN head = 4 THEN '.xlsx' ELSE ext END AS detected_ext FROM {_TYPED_SQL})"""
_DIAGNOSIS_SQL = """CASE
    WHEN detected_ext IN ('.docx', '.xlsx', '.pptx') THEN
        CASE WHEN head = 4 OR (head = 3 AND locked) THEN 'encrypted' ELSE 'damaged' END
    WHEN detected_ext IN ('.doc', '.xls', '.ppt') THEN CASE WHEN head = 5 THEN 'missing_lib' ELSE 'damaged' END
    WHEN detected_ext = '.pdf' THEN 'damaged' ELSE 'unknown' END"""
CHECKED_SQL = f"""(SELECT *, CASE WHEN reason IN ('ok', 'encrypted') THEN reason ELSE 'damaged' END AS status FROM (
    SELECT *, CASE WHEN text IS NULL THEN {_DIAGNOSIS_SQL} WHEN locked THEN 'encrypted'
        WHEN low THEN CASE WHEN {_DIAGNOSIS_SQL} = 'encrypted' THEN 'encrypted' ELSE 'low_text' END
        ELSE 'ok' END AS reason FROM (SELECT *, coalesce(size > 10240 AND length({Q.strip('text')}) < 10, FALSE) AS low FROM {TYPED_SQL})))"""
ARCHIVES_SQL = f"""(SELECT doc_id, path, ext, CASE WHEN head NOT IN (3, 4) THEN 'damaged' WHEN locked THEN 'encrypted' ELSE 'ok' END AS status
    FROM {_TYPED_SQL} WHERE route = 'archive')"""


def zip_of(data, name):
    """A ZIP file with one stored entry, built from its bytes and its name."""
    def fields(x):
        size, label_size = _reversed_hex(F.octet_length(x["data"])), _reversed_hex(F.octet_length(x["label"]))
        common = F.concat(F.lit("00" * 12), size, size, F.substring(label_size, 1, 4), F.lit("0000"))
        return F.struct(x["data"].alias("data"), x["label"].alias("label"), common.alias("common"))

    def parts(x):
        head = F.concat(F.unhex(F.concat(F.lit("504B0304" + "1400"), x["common"])), x["label"], x["data"])
        entry = F.concat(F.unhex(F.concat(F.lit("504B0102" + "1400" + "1400"), x["common"], F.lit("00" * 14))), x["label"])
        return F.struct(head.alias("head"), entry.alias("entry"))

    def whole(x):
        end = F.concat(F.lit("504B0506" + "00000000" + "01000100"), _reversed_hex(F.octet_length(x["entry"])),
                       _reversed_hex(F.octet_length(x["head"])), F.lit("0000"))
        return F.concat(x["head"], x["entry"], F.unhex(end))

    given = F.struct(data.alias("data"), F.encode(name, "utf-8").alias("label"))
    return let(let(let(given, fields), parts), whole)


def archives(t) -> DataFrame:
    """Every document in an archive of its own, every third one in an archive within an archive."""
    doc, body = F.col("doc_id"), F.encode("text", "utf-8")
    one = zip_of(body, F.concat(F.lit("d"), doc, F.lit(".txt")))
    twice = lambda z: F.when(doc % 3 == 0, zip_of(z, F.lit("inner.zip"))).otherwise(z)
    return t.documents.select(
        F.concat(F.lit("/z/"), doc, F.lit(".zip")).alias("path"), let(one, twice).alias("content"))
