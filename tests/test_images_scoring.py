import json

from pyspark.sql import functions as F

from lineward.functions import scoring as S
from lineward.functions.images import position
from lineward.operators import images as I
from lineward.operators import scoring as M
from lineward.operators import tables as T
from lineward.plans.scoring_queries import contains_scorer


def test_position_limits(spark):
    df = spark.createDataFrame([(310, 350, 1000), (309, 350, 1000), (640, 680, 1000), (639, 680, 1000), (1, 2, 0), (1, 2, None)],
                               "a int, b int, h int")
    got = [r.p for r in df.select(position(F.col("a"), F.col("b"), F.col("h")).alias("p")).collect()]
    assert got == ["middle", "top", "bottom", "middle", "", ""]


def test_scan_with_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def engine():
        def read(path):
            calls.add(1)
            if path == "/i/bad.png":
                raise ValueError("broken")
            return [("to ken", 0.7, "top"), ("token", 0.69), ("none", 0.9)] if "new" in path else []
        return read

    images = spark.createDataFrame(
        [("/i/new1.png", "m1"), ("/i/new2.png", "m1"), ("/i/known.png", "m2"), ("/i/bad.png", "m3"), ("/i/blank.png", "m4")],
        "image_path string, md5 string")
    cache = spark.createDataFrame([("m2", [("TOKEN", 0.8, None)])],
                                  "md5 string, ocr_items array<struct<text:string,confidence:double,position:string>>")
    assert I.cache_counts(images, cache).first().asDict() == {"total": 5, "hits": 1, "to_read": 3}
    found, entries = I.scan(images, cache, engine, ["token"])
    got = sorted((r.image_path, r.directory, r.filename, r.position, r.ocr_text, r.keyword) for r in found.collect())
    assert got == [("/i/known.png", "/i", "known.png", "", "TOKEN", "TOKEN"),
                   ("/i/new1.png", "/i", "new1.png", "top", "to ken", "to ken"),
                   ("/i/new2.png", "/i", "new2.png", "top", "to ken", "to ken")]
    assert {r.md5 for r in entries.collect()} == {"m1", "m4"}
    assert calls.value == 3  # each image once, for both results


def parsed(spark, *answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, r string")
    return [r.v for r in df.select("i", S.parse(F.col("r")).alias("v")).orderBy("i").collect()]


def test_answers(spark):
    good, prose, bare, two, single, wrong, null = parsed(
        spark, '{"has_sensitive": true, "matches": [{"keyword": "k", "context": "c"}, {}]}',
        'Sure: {"matches": []} done', "{}", '{"has_sensitive": false} or {x}', "{'has_sensitive': true}", "nothing", None)
    assert good.has_sensitive and [tuple(m) for m in good.matches] == [("k", "c", ""), ("unknown", "", "")]
    assert (prose.has_sensitive, prose.matches, prose.parse_status) == (False, [], "json")
    assert (bare.has_sensitive, bare.parse_status) == (False, "json")
    assert two.parse_status == "inferred" and single.has_sensitive and single.parse_status == "inferred"
    assert not wrong.has_sensitive and wrong.matches[0].context == "nothing" and null is None


def test_batches(spark):
    text = "\n".join(["x"] * 10 + [" "] * 10 + ["y"])
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r.batch_no, r.start, len(r.lines)) for r in M.line_batches(df).collect()] == [(0, 0, 10), (2, 20, 1)]


def test_failing_requests_are_left_out(spark):
    def make():
        def call(prompt):
            if "bad" in prompt:
                raise TimeoutError("slow")
            hit = {"keyword": "secret", "context": "a secret plan" + "!" * 200}
            return json.dumps({"has_sensitive": True, "matches": [hit, hit, {"keyword": "other", "context": "not there"}]})
        return call

    df = spark.createDataFrame([(1, "one\n  a secret plan" + "!" * 200 + "\nend"), (2, "bad")], "id int, text string")
    got = sorted((r.id, r.line_no, r.keyword, len(r.content)) for r in
                 M.scored_findings(df, "id", ["secret"], M.python_scorer(make)).collect())
    assert got == [(1, 1, "other", 9), (1, 2, "secret", 120)]


def test_table_cells(spark):
    def make():
        return lambda prompt: '{"has_sensitive": true, "matches": []}' if "Text:\nred" in prompt else "no"

    df = spark.createDataFrame([(1, "red", "x"), (2, "red", " "), (3, "blue", "y")], "id int, a string, b string")
    spec = T.TableSpec("t", df, ("id",))
    got = sorted(tuple(r) for r in M.table_findings(spec, ["red"], M.python_scorer(make)).collect())
    assert got == [("t", "a", "1", "", ""), ("t", "a", "2", "", "")]


def test_long_texts_are_asked_about_whole(spark):
    """Ten long lines are more than one request holds; the last of them counts too."""
    text = "\n".join(["x" * 450] * 9 + ["here is the token" + "." * 5000 + " and the secret"])
    df = spark.createDataFrame([(1, text)], "id int, text string")
    asked = M.prompts(M.line_batches(df), ["token"])
    assert asked.count() == 3 and all(len(r.prompt) <= len(S.instruction(["token"])) + S.MAX_CHARS for r in asked.collect())
    got = sorted(tuple(r) for r in M.scored_findings(df, "id", ["token", "secret"], contains_scorer(["token", "secret"])).select(
        "id", "line_no", "keyword").collect())
    assert got == [(1, 10, "secret"), (1, 10, "token")]


def test_line_of_a_context_is_found_by_its_whole_first_line(spark):
    lines = ["the same beginning of a long line, one", "the same beginning of a long line, two"]
    df = spark.createDataFrame([(lines, lines[1] + "\nmore")], "lines array<string>, context string")
    assert df.select(S.locate(F.col("lines"), F.lit(0), F.col("context"))).first()[0] == 2
