"""Running numbers over a whole result without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineward.session import ensure_checkpoint_dir

_ROW_BITS = 33


def number_rows(df: DataFrame, order: list[Column | str], name: str = "seq",
                by: list[str] | None = None) -> DataFrame:
    """Add 1-based numbers in the given order, restarting for each value of ``by``.

    The rows are range-partitioned and sorted once and written to a reliable checkpoint together
    with their position (partition and row). Each partition then only needs to know how many rows
    came before it, which is a table of at most partitions x groups rows. A group that holds most
    of the rows is spread over many partitions like any other.

    ``by`` must have few distinct values (sections of a report, for example).
    """
    by = by or []
    ensure_checkpoint_dir(df.sparkSession)
    position = F.monotonically_increasing_id
    # Sorting reads its input twice, to find the ranges and to place the rows: compute it once.
    # The position in that copy breaks ties, so that even equal rows are spread over the ranges.
    copy = df.checkpoint().withColumn("_tie", position())
    placed = copy.sort(*by, *order, "_tie").drop("_tie").withColumn("_at", position()).checkpoint()
    placed = placed.withColumn("_part", F.shiftright("_at", _ROW_BITS))

    counts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_part").alias("_in"), "_from", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])

    condition = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        condition &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    number = F.col("_before") + F.col("_at") - F.col("_from") + 1
    return placed.join(offsets, condition).select(*df.columns, number.alias(name))


def number_within(df: DataFrame, group: str, order: list[Column | str], name: str = "seq") -> DataFrame:
    """1-based numbers within each value of ``group``, of which there may be many and uneven ones.

    All rows are numbered once; a row's number within its group is its distance to the group's
    first number, which takes an aggregate with one row per group.
    """
    numbered = number_rows(df, [group, *order], "_n")
    first = numbered.groupBy(group).agg(F.min("_n").alias("_first"))
    placed = numbered.join(first.withColumnRenamed(group, "_g"),
                           numbered[group].eqNullSafe(F.col("_g")))
    return placed.select(*df.columns, (F.col("_n") - F.col("_first") + 1).alias(name))
