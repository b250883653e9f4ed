import html as python_html
from urllib.parse import urljoin

from pyspark.sql import functions as F

from lineward.functions import html as H
from lineward.functions import urls as U
from lineward.operators import web as W
from lineward.schemas import PAGE, PAGE_STATE

BASES = ["http://h.example/a/b/c.html?x=1#f", "https://h.example", "http://h.example:8080/", "http://h.example/a//b/d"]
REFS = ["", "/x", "x/../y", "./z", "../../up", "../../../far", "?q=1", "#part", "//other/p", "mailto:a@b", "g;x=1/../y",
        "https://o.example/", "a/./b/..", "..", ".", "/a/../b", "x y", "/p?next=/../q", "dir/"]


def test_resolve_like_the_standard_library(spark):
    pairs = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(pairs, "base string, ref string")
    for row in df.withColumn("full", U.resolve(F.col("base"), F.col("ref"))).collect():
        assert row.full.rstrip("#") == urljoin(row.base, row.ref).rstrip("#"), (row.base, row.ref)


def texts(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r.t for r in df.select("i", H.visible_text(F.col("html")).alias("t")).orderBy("i").collect()]


def test_visible_text(spark):
    got = texts(
        spark, "<p>a<b>b</b></p>\n\n\n<p>c</p>", "<!-- x<p> -->t<script>var a='</p>';</script>u<style>p{}</style>",
        "<!DOCTYPE html><p title='a>b' data-x=\"<q>\">x</p>  <p>y</p>", "plain < text & more", "<script>never closed",
        "a<br/>b", "")
    assert got == ["a\nb\n\n\nc", "t\nu", "x\n \ny", "plain < text & more", "", "a\nb", ""]


def test_entities(spark):
    samples = ["&amp;lt;", "&lt;p&gt; &copy; &#233; &#xE9; &#128512; &middot;", "&nosuch; & &", "&quot;x&quot;", "a &amp b"]
    got = texts(spark, *samples)
    assert got[:4] == [python_html.unescape(s) for s in samples[:4]]
    assert got[4] == "a & b"


def test_long_markup_needs_no_stack(spark):
    page = "<ul>" + "<li></li>" * 50_000 + "<p " + "a=1 " * 20_000 + ">x</p><p " + "b " * 50_000
    assert texts(spark, page)[0].startswith("x")


def test_links(spark):
    html = """<a href="/x#f">1</a> <a class=k href='y?a=1&amp;b=2'>2</a> <A HREF=http://h.example/z>3</A>
        <a href="http://h.example:81/p">other port</a> <a href="mailto:a@b">m</a> <a name=n>no</a>
        <!-- <a href="/hidden">h</a> --> <script>'<a href="/js">'</script> <a href="/x#g">again</a> <abbr href="/no">"""
    pages = spark.createDataFrame([("http://h.example/d/i.html", html)], "url string, html string")
    links = [r.link for r in W.page_links(pages).collect()]
    assert links == ["http://h.example/x", "http://h.example/d/y?a=1&b=2", "http://h.example/z", "http://h.example/x"]
    assert pages.select(W.link_array(F.col("url"), F.col("html")).alias("l")).first().l == links


def state(spark, rows):
    return spark.createDataFrame([tuple(r.get(f) for f in PAGE_STATE.names) for r in rows], PAGE_STATE)


def snapshot(spark, rows):
    return spark.createDataFrame([tuple(r.get(f) for f in PAGE.names) for r in rows], PAGE)


def test_second_visit(spark):
    kw = ["token"]
    first = snapshot(spark, [
        {"url": "http://h/1", "html": "<p>token one</p><a href='/2'>x</a>", "etag": "e1"},
        {"url": "http://h/2", "html": "<p>token two</p>", "etag": "", "last_modified": "m2"},
        {"url": "http://h/3", "html": "<p>clean</p>"}, {"url": "http://h/4", "html": None}])
    empty = state(spark, [])
    scanned = W.rescan(W.classify(first, empty), kw)
    assert W.incremental_counters(scanned).first().asDict() == {
        "total": 4, "skipped": 0, "new_pages": 4, "matched_pages": 2}
    stored = W.upsert_state(empty, scanned).checkpoint()
    assert stored.count() == 3 and stored.where("url = 'http://h/3'").first().links is None

    second = snapshot(spark, [
        {"url": "http://h/1", "html": None, "etag": "e1"},
        {"url": "http://h/2", "html": "<p>nothing now</p>", "etag": "", "last_modified": ""},
        {"url": "http://h/3", "html": "<p>clean</p>"}, {"url": "http://h/4", "html": None}])
    again = W.rescan(W.classify(second, stored), kw)
    assert {r.url[-1]: (r.status, r.failed) for r in again.collect()} == {
        "1": ("not_modified", False), "2": ("changed", False), "3": ("not_modified", False), "4": ("new", True)}
    found = W.incremental_findings(again)
    assert [(r.url, r.from_cache, r.content) for r in found.collect()] == [("http://h/1", True, "token one")]
    assert [r.url for r in W.cached_only(found).collect()] == ["http://h/1"]
    after = {r.url: r for r in W.upsert_state(stored, again).collect()}
    assert after["http://h/2"].last_modified == "m2" and after["http://h/2"].findings == []
    assert len(after["http://h/1"].findings) == 1 and len(after) == 3


def test_traversal(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)] + [("3", "0"), ("0", "5"), ("0", "5")],
                                  "src string, dst string")
    seeds = spark.createDataFrame([("0",), ("11",), ("x",)], "seed string")
    got = {(r.seed, r.url): r.depth for r in W.bfs(edges, seeds, compact_every=2).collect()}
    assert got[("0", "12")] == 8 and got[("0", "5")] == 1 and got[("11", "12")] == 1 and got[("x", "x")] == 0
    assert len(got) == 13 + 2 + 1
    assert W.bfs(edges, seeds, max_depth=0).count() == 3
    assert {r.depth for r in W.bfs(edges, seeds, max_depth=2).collect()} == {0, 1, 2}


def test_character_references_of_all_kinds(spark):
    body = "to&#x0000006b;en &#0000107;ey&NewLine;&lbrace;x&rbrace;&period; &#146;s &unknown; &amp;lt; &#99999999;"
    text = spark.createDataFrame([(body,)], "h string").select(H.unescape(F.col("h"))).first()[0]
    assert text == "token key\n{x}. \u2019s &unknown; &lt; &#99999999;"
