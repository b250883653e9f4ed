import datetime

from pyspark.sql import functions as F

from lineward.operators import tables as T


def people(spark):
    return spark.createDataFrame(
        [(1, "red bolt", True, bytearray(b"red"), datetime.date(2020, 1, 2), {"a": "red"}, 1.5),
         (2, "r e d", False, None, None, None, 2.5), (3, None, None, None, None, None, None),
         (1, "bolt\nx\nred RED", True, None, None, None, None)],
        "id int, name string, flag boolean, raw binary, day date, extra map<string,string>, n double")


def test_text_columns(spark):
    assert T.text_columns(people(spark)) == ["name", "day", "extra"]
    assert T.skipped_columns(people(spark)) == ["id(int)", "flag(boolean)", "raw(binary)", "n(double)"]


def test_findings_merge_equal_ids_and_lines(spark):
    spec = T.TableSpec("people", people(spark), ("id",))
    got = {(r.field, r.record_id): r.keyword for r in T.findings(spec, ["red", "bolt"], prefilter="exact").collect()}
    assert got == {("name", "1"): "RED, red, bolt, bolt, red",
                   ("extra", "1"): "red"}


def test_spaced_variant_needs_the_fuzzy_filter(spark):
    spec = T.TableSpec("people", people(spark), ("id",))
    ids = lambda **how: {r.record_id for r in T.findings(spec, ["red"], **how).collect()}
    assert ids(prefilter="exact") == {"1"} and ids() == {"1", "2"}
    stats = T.table_stats(spec, ["red"], prefilter="fuzzy").first()
    assert (stats.total_records, stats.candidate_records, stats.matched_records) == (4, 3, 2)


def test_case_of_the_coarse_filter(spark):
    spec = T.TableSpec("t", spark.createDataFrame([(1, "RED")], "id int, s string"), ("id",), True)
    assert T.findings(spec, ["red"]).count() == 1
    assert T.findings(spec, ["red"], ignore_case=False, prefilter="exact").count() == 0


def test_unique_key_needs_no_shuffle(spark):
    spec = T.TableSpec("people", people(spark), ("id",), unique_key=True)
    assert "Exchange" not in T.findings(spec, ["red"])._jdf.queryExecution().executedPlan().toString()


def test_composite_ids_that_collide_stay_apart(spark):
    df = spark.createDataFrame([("a-b", "c", "red"), ("a", "b-c", "red"), (None, "c", "red")], "k1 string, k2 string, s string")
    got = sorted(r.record_id for r in T.findings(T.TableSpec("t", df, ("k1", "k2")), ["red"]).collect() if r.field == "s")
    assert got == ["None-c", "a-b-c", "a-b-c"]


def test_no_key_numbers_every_row(spark):
    df = spark.createDataFrame([("red",), ("red",), ("blue",), ("bored",)], "s string")
    got = sorted((r.record_id, r.keyword) for r in T.findings(T.TableSpec("t", df), ["red"]).collect())
    assert got == [("1", "red"), ("2", "red"), ("3", "red")]
    assert T.table_stats(T.TableSpec("t", df), ["red"]).first().matched_records == 3
    assert T.hash_record_id(df).select("record_id").distinct().count() == 3


def test_tables_without_text_or_rows(spark):
    numbers = T.TableSpec("numbers", spark.range(5), ("id",))
    empty = T.TableSpec("empty", spark.createDataFrame([], "id int, s string"), ("id",))
    stats = {r.table: r for r in T.database_stats([numbers, empty], ["red"]).collect()}
    assert stats["numbers"].total_records == 0 and stats["numbers"].n_text_columns == 0
    assert stats["empty"].total_records == 0 and stats["empty"].n_text_columns == 1
    totals = T.totals(T.database_stats([numbers, empty], ["red"])).first()
    assert totals.total_tables == 2 and totals.matched_tables == 0


def test_failing_database_is_left_out(spark):
    def broken():
        raise OSError("unreachable")

    opened, failed = T.open_databases({"good": lambda: [T.TableSpec("t", spark.range(1))], "bad": broken})
    assert list(opened) == ["good"] and "unreachable" in failed["bad"]
    assert T.prefixed(opened)[0].name == "good.t"


def test_no_keywords(spark):
    spec = T.TableSpec("people", people(spark), ("id",))
    assert T.findings(spec, []).count() == 0
    row = T.table_stats(spec, []).first()
    assert (row.total_records, row.candidate_records, row.matched_records) == (4, 0, 0)
    assert F is not None
