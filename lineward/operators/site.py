"""Check of whole sites from their start pages: traversal over real links, findings of the pages it reaches.

Bodies are read twice and never per level: once row by row for hash and links, which are short, and once for the
text of the pages that turned out to be reached and new. Edges and visited pages are kept in tables bucketed by url
with the same number of buckets, so a level shuffles the pages it discovers and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.functions import urls as U
from lineward.operators import web as W
from lineward.session import ensure_checkpoint_dir


def _bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``key``; rows are in place before they are written."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    writer = df.write.mode(mode).option("path", folder).format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(name)
    return spark.table(name)


@contextmanager
def colocated(spark: SparkSession) -> Iterator[None]:
    """Plans made inside join on (url, seed) where both sides are dealt out by url alone."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def next_level(visited: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, url, depth): what the pages at ``depth`` - 1 link to and no level has.

    The join and the removal of known pages find both sides in place. The one shuffle is that of the pages found, by url;
    links to one page are merged before they travel, the seeds that reach it as a set.
    """
    here = visited.where(F.col("depth") == depth - 1).select("seed", "url")
    found = here.join(edges, here["url"] == edges["src"]).groupBy(F.col("dst").alias("url")).agg(F.collect_set("seed").alias("seeds"))
    found = found.select("url", F.explode("seeds").alias("seed"))
    known = visited.select(F.col("seed").alias("_seed"), F.col("url").alias("_url"))
    return found.join(known, (F.col("url") == F.col("_url")) & (F.col("seed") == F.col("_seed")), "left_anti").select("seed", "url", F.lit(depth).alias("depth"))


def traverse(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``seed, url, depth`` like ``web.bfs``, with edges and visited pages in one hash layout.

    One job per level, which appends the level to the visited pages. ``edges`` has ``src, dst``; ``seeds`` has ``seed``.
    """
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    run = f"site_{uuid.uuid4().hex}"
    known = _bucketed(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), f"{run}_edges", "src", buckets)
    first = seeds.select("seed", F.col("seed").alias("url")).where("seed is not null").distinct().withColumn("depth", F.lit(0))
    visited = _bucketed(first, f"{run}_visited", "url", buckets)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        # A table can't be appended to while it is read: the level is a checkpoint, and short.
        with colocated(spark):
            level = next_level(visited, known, depth).checkpoint()
        if level.isEmpty():
            break
        visited = _bucketed(level, f"{run}_visited", "url", buckets, "append")
    return visited


@dataclass
class SiteCheck:
    """pages: seed, url, depth, status, failed. findings: url, line_no, content, keyword, from_cache. state: the next one."""

    pages: DataFrame
    findings: DataFrame
    state: DataFrame

    def counters(self) -> DataFrame:
        """For each seed total, skipped and new or changed pages, and pages with fresh findings."""
        hits = self.findings.where("not from_cache").select("url").distinct().withColumn("_hit", F.lit(True))
        kept = F.col("status") == W.NOT_MODIFIED
        return self.pages.join(hits, "url", "left").groupBy("seed").agg(
            F.count("*").alias("total"), F.count_if(kept).alias("skipped_pages"), F.count_if(~kept).alias("new_pages"),
            F.count_if("_hit").alias("matched_pages"))


def check_site(snapshot: DataFrame, state: DataFrame, seeds: DataFrame, keywords: list[str], max_depth: int | None = None) -> SiteCheck:
    """Follow links from ``seeds(seed)`` through ``snapshot`` and scan what is reached and new or changed.

    ``snapshot`` stands for what a fetch returns (url, html, validators), one row for a url; a linked url that it lacks, or has without a body, is
    a failed fetch: counted as new, without findings or links, and not stored. Pages that didn't change take findings and
    links from ``state``. A page that several seeds reach is scanned once and counts for each.
    """
    spark = snapshot.sparkSession
    ensure_checkpoint_dir(spark)
    # Links stay on the host of their page, so only hosts of seeds can be reached.
    hosts = seeds.select(U.host(F.col("seed")).alias("_host")).distinct()
    pages = snapshot.join(hosts, U.host(F.col("url")) == F.col("_host"), "left_semi")
    html = F.col("html")
    short = pages.select(*[c for c in pages.columns if c != "html"], W.content_hash(html).alias("content_hash"),
                         W.link_array(F.col("url"), html).alias("new_links"))
    judged = W.classify(short, state).checkpoint()
    links = W.effective_links(judged)
    reached = traverse(links.select(F.col("url").alias("src"), F.col("link").alias("dst")), seeds, max_depth)

    once = reached.select("url").distinct()
    seen = judged.join(once, "url", "left_semi")
    fresh = W.fresh_pages(seen).select("url")
    texts = W.page_findings(pages.select("url", "html").join(fresh, "url", "left_semi"), keywords).checkpoint()
    carried = W.carried_over(seen)
    findings = texts.withColumn("from_cache", F.lit(False)).unionByName(carried)

    stored = texts.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("line_no", "content", "keyword"))).alias("new_findings"))
    empty = F.array().cast("array<struct<line_no:int,content:string,keyword:string>>")
    scanned = W.rescan(seen.join(stored, "url", "left").withColumn("new_findings", F.coalesce("new_findings", empty)), keywords)
    status = judged.select("url", "status", "failed")
    visited = reached.join(status, "url", "left").select(
        "seed", "url", "depth", F.coalesce("status", F.lit(W.NEW)).alias("status"), F.coalesce("failed", F.lit(True)).alias("failed"))
    return SiteCheck(visited, findings, W.upsert_state(state, scanned))
