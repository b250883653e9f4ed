from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lineward.operators.numbering import number_rows, number_within


def rows(spark):
    # One group holds most of the rows; some rows are equal.
    return spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        (F.col("id") * 7919 % 3000).alias("v"))


def test_numbers_like_a_global_window(spark):
    df = rows(spark)
    want = df.select("g", "v", F.row_number().over(Window.orderBy("v", "g")).alias("seq"))
    assert sorted(map(tuple, number_rows(df, ["v", "g"]).collect())) == sorted(map(tuple, want.collect()))


def test_numbers_restart(spark):
    df = rows(spark).withColumn("s", F.col("v") % 2 == 0)
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("s").orderBy("v", "g")))
    assert sorted(map(tuple, number_rows(df, ["v", "g"], by=["s"]).collect())) == sorted(map(tuple, want.collect()))


def test_numbers_within_many_groups(spark):
    df = rows(spark)
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("v")))
    got = number_within(df, "g", ["v"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_rows(spark):
    assert number_rows(rows(spark).where("v < 0"), ["v"]).count() == 0
