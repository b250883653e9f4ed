"""Site check on a small site, and the plan of a level."""

from lineward.operators import site as C
from lineward.operators import web as W
from lineward.schemas import PAGE_STATE

A = "http://a.example"


def page(path, links=(), text="plain", host=A):
    body = "".join(f'<a href="{x}">l</a>' for x in links)
    return (f"{host}{path}", f"<p>{text}</p>{body}", "", "")


def check(spark, pages, seeds, state=(), depth=None):
    snapshot = spark.createDataFrame(pages, "url string, html string, etag string, last_modified string")
    return C.check_site(snapshot, spark.createDataFrame(list(state), PAGE_STATE), spark.createDataFrame([(s,) for s in seeds], "seed string"), ["token"], depth)


PAGES = [page("/", ["/x", "/y", "http://b.example/z"], "token one"), page("/x", ["/", "/deep"]), page("/y", ["/x", "/gone"], "a token"),
         page("/deep", ["/y#part"], "to ken"), page("/alone", [], "token"), page("/z", [], "token", "http://b.example"), (f"{A}/gone", None, None, None)]


def test_first_visit(spark):
    found = check(spark, PAGES, [f"{A}/"])
    rows = {r["url"][len(A):]: (r["depth"], r["status"], r["failed"]) for r in found.pages.collect()}
    assert rows == {"/": (0, "new", False), "/x": (1, "new", False), "/y": (1, "new", False), "/deep": (2, "new", False), "/gone": (2, "new", True)}
    assert sorted(r["url"][len(A):] for r in found.findings.collect()) == ["/", "/deep", "/y"]
    assert found.counters().first()[1:] == (5, 0, 5, 3)
    # The page that nothing links to and the failed one are not stored.
    assert {r["url"][len(A):] for r in found.state.collect()} == {"/", "/x", "/y", "/deep"}


def test_second_visit_takes_over_what_did_not_change(spark):
    state = check(spark, PAGES, [f"{A}/"]).state.collect()
    changed = [page("/y", [], "nothing") if p[0].endswith("/y") else p for p in PAGES]
    found = check(spark, changed, [f"{A}/", f"{A}/x"], state)
    rows = {(r["seed"][len(A):], r["url"][len(A):]): (r["depth"], r["status"]) for r in found.pages.collect()}
    assert rows["/", "/deep"] == (2, "not_modified") and rows["/x", "/deep"] == (1, "not_modified") and rows["/x", "/y"] == (2, "changed")
    assert ("/", "/gone") not in rows  # only the old version linked to it
    assert sorted((r["url"][len(A):], r["from_cache"]) for r in found.findings.collect()) == [("/", True), ("/deep", True)]
    assert {r["seed"][len(A):]: r[1:] for r in found.counters().collect()} == {"/": (4, 3, 1, 0), "/x": (4, 3, 1, 0)}


def test_depth_limit_and_unknown_seed(spark):
    assert check(spark, PAGES, [f"{A}/"], depth=0).pages.count() == 1
    assert check(spark, PAGES, [f"{A}/"], depth=1).pages.count() == 3
    (row,) = check(spark, PAGES, ["http://nowhere.example/"]).pages.collect()
    assert row["failed"] and row["status"] == W.NEW
    assert check(spark, [], []).pages.count() == 0


def test_a_level_shuffles_only_what_it_finds(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for levels that are large
    try:
        pages = spark.range(3000).selectExpr("concat('u', id) AS src", "concat('u', (id * 7) % 3000) AS dst")
        edges = C._bucketed(pages, "site_test_edges", "src", 8)
        visited = C._bucketed(pages.selectExpr("'s' AS seed", "src AS url", "0 AS depth").where("src < 'u2'"), "site_test_visited", "url", 8)
        with C.colocated(spark):
            level = C.next_level(visited, edges, 1)
            plan = level._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        known = {r["url"] for r in visited.collect()}
        assert {r["url"] for r in level.collect()} == {f"u{int(u[1:]) * 7 % 3000}" for u in known} - known
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS site_test_edges")
        spark.sql("DROP TABLE IF EXISTS site_test_visited")
