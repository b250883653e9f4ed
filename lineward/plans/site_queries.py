"""Whole sites checked from their start pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineward.functions import html as H
from lineward.functions import urls as U
from lineward.operators import site as C
from lineward.operators import web as W
from lineward.operators.numbering import number_within
from lineward.plans import fixtures as X
from lineward.plans import sqltext as Q
from lineward.plans.keyword_queries import KW
from lineward.plans.registry import query
from lineward.session import ensure_checkpoint_dir

# The pages of a host, each with links to two others and to the first one beside its own, as a site has them.


def _site(t):
    """Snapshot of the sites: page_id, r (rank on its host), url without fragment, html with the links added, validators."""
    ensure_checkpoint_dir(t.spark)
    one_each = t.pages.groupBy(U.strip_fragment(F.col("url")).alias("url")).agg(F.min("page_id").alias("page_id"))
    ranked = number_within(one_each.withColumn("host", U.host(F.col("url"))), "host", ["page_id"], "r").checkpoint()
    targets = F.array(F.col("r") * 2, F.col("r") * 2 + 1, F.lit(1).cast("long"))
    wanted = ranked.select("page_id", "host", F.explode(targets).alias("r"))
    path = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    found = wanted.join(ranked.select("host", "r", path.alias("path")), ["host", "r"]).groupBy("page_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<p><a href="'), "path", F.lit('">more</a></p>')))), "").alias("anchors"))
    pid = F.col("page_id")
    return t.pages.select("page_id", "html").join(ranked.select("page_id", "r", "url"), "page_id").join(found, "page_id").select(
        "page_id", "r", "url", F.when(pid % 49 != 48, F.concat("html", "anchors")).alias("html"), F.concat("html", "anchors").alias("whole"),
        F.when(pid % 7 == 0, F.concat(F.lit("e"), pid)).otherwise("").alias("etag"), F.lit("").alias("last_modified"))


def _state(site):
    pid = F.col("page_id")
    old = F.transform(W.finding_array(H.visible_text(F.col("whole")), KW), lambda x: x.withField("content", F.concat(F.lit("old "), x["content"])))
    return site.where(pid % 3 != 2).select(
        "url", W.content_hash(F.when(pid % 3 == 1, F.concat("whole", F.lit("x"))).otherwise(F.col("whole"))).alias("content_hash"),
        F.when(pid % 7 == 0, F.concat(F.lit("e"), pid)).otherwise("").alias("etag"), F.lit("").alias("last_modified"),
        F.lit(None).cast("timestamp").alias("last_checked"), W.link_array(F.col("url"), F.col("whole")).alias("links"), old.alias("findings"))


def _check(t, depth=None):
    site = _site(t).checkpoint()
    seeds = site.where("r <= 2").select(F.col("url").alias("seed"))
    return C.check_site(site.select("url", "html", "etag", "last_modified"), _state(site), seeds, KW, depth)


def _sql(depth: int) -> str:
    return f"""WITH RECURSIVE ranked AS (SELECT page_id, html, url, {X.HOST_SQL.format('url')} AS host,
        row_number() OVER (PARTITION BY {X.HOST_SQL.format('url')} ORDER BY page_id) AS r
        FROM (SELECT page_id, html, split_part(url, '#', 1) AS url FROM pages
              QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY page_id) = 1)),
    anchors AS (SELECT a.page_id, string_agg(p, '' ORDER BY p) AS anchors FROM (
        SELECT a.page_id, '<p><a href="' || regexp_replace(b.url, '^[a-z]+://[^/?#]*', '') || '">more</a></p>' AS p
        FROM ranked a, unnest([2 * a.r, 2 * a.r + 1, 1]) AS w(r) JOIN ranked b ON b.host = a.host AND b.r = w.r) a GROUP BY 1),
    site AS MATERIALIZED (SELECT page_id, url, r, html || anchors AS whole, CASE WHEN page_id % 49 <> 48 THEN html || anchors END AS html,
        CASE WHEN page_id % 3 = 2 THEN 'new' WHEN page_id % 7 = 0 THEN 'not_modified' WHEN page_id % 49 = 48 THEN 'new'
             WHEN page_id % 3 = 0 THEN 'not_modified' ELSE 'changed' END AS status
        FROM ranked JOIN anchors USING (page_id)),
    edges AS MATERIALIZED (SELECT DISTINCT url AS src, link AS dst
        FROM {X.links_sql("(SELECT url, CASE WHEN status = 'not_modified' THEN whole ELSE html END AS html FROM site)", 'url')}),
    walk(seed, url, depth) AS (
        SELECT url, url, CAST(0 AS INTEGER) FROM site WHERE r <= 2
        UNION SELECT w.seed, e.dst, CAST(w.depth + 1 AS INTEGER) FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < {depth}),
    reached AS (SELECT seed, url, min(depth) AS depth FROM walk GROUP BY seed, url),
    visited AS (SELECT seed, url, depth, coalesce(status, 'new') AS status, html IS NULL AND coalesce(status, 'new') <> 'not_modified' AS failed
                FROM reached LEFT JOIN site USING (url)),
    fresh AS (SELECT url, html FROM site WHERE status <> 'not_modified' AND html IS NOT NULL AND url IN (SELECT url FROM reached)),
    kept AS (SELECT url, whole AS html FROM site WHERE status = 'not_modified' AND url IN (SELECT url FROM reached)),
    found AS (SELECT url, line_no, content, keyword, FALSE AS from_cache FROM {Q.findings(X.text_sql('fresh', 'url'), 'url', KW)}
              UNION ALL SELECT url, line_no, 'old ' || content, keyword, TRUE FROM {Q.findings(X.text_sql('kept', 'url'), 'url', KW)})"""


@query("web_check", _sql(20) + " SELECT seed, url, depth, status, failed FROM visited")
def web_check(t):
    return _check(t).pages


@query("web_check_findings", _sql(2) + " SELECT url, line_no, content, keyword, from_cache FROM found")
def web_check_findings(t):
    return _check(t, 2).findings


@query("web_check_counters", _sql(20) + """
SELECT seed, count(*) AS total, count(*) FILTER (status = 'not_modified') AS skipped_pages, count(*) FILTER (status <> 'not_modified') AS new_pages,
       count(*) FILTER (url IN (SELECT url FROM found WHERE NOT from_cache)) AS matched_pages FROM visited GROUP BY seed""")
def web_check_counters(t):
    return _check(t).counters()


@query("web_check_state", _sql(2) + f"""
SELECT url, md5(CASE WHEN page_id % 3 <> 1 OR url IN (SELECT url FROM fresh) THEN whole ELSE whole || 'x' END) AS content_hash, coalesce(n, 0) AS n_findings
FROM site LEFT JOIN (SELECT url, count(*) AS n FROM {Q.findings(X.text_sql('(SELECT url, whole AS html FROM site)', 'url'), 'url', KW)} GROUP BY 1) USING (url)
WHERE page_id % 3 <> 2 OR url IN (SELECT url FROM fresh)""")
def web_check_state(t):
    return _check(t, 2).state.select("url", "content_hash", F.size("findings").cast("long").alias("n_findings"))
