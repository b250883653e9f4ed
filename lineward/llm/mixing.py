"""Mix of sources by weight: weighted sampling without replacement, up to a token budget for each source.

Every document has an exponential key divided by its quality weight, so that taking a source's documents in
ascending key samples them by weight. A source's target is met by complete epochs of all its documents, then
by documents in key order until the rest of the budget is used. Keys come from the document id: runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineward.llm.common import WORD, written
from lineward.operators.numbering import number_rows

# Weights of the sources in code point order, and the share of all sizes that is mixed.
WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
_SEED = 20_240_607


def size_in_words(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column | str = "text") -> Column:
    """Between 0.1 and 1: the share of letters, marks and white space; junk is drawn later than prose."""
    text = F.col(text) if isinstance(text, str) else text
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\s]+", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - odd / F.greatest(F.length(text), F.lit(1))), F.lit(0.1))


def sampling_key(weight: Column, *identity: str) -> Column:
    """Exponential with rate ``weight``, a function of the identity alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(_SEED), *identity), 11) + 0.5) / float(1 << 53)
    return -F.log(uniform) / weight


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, as many as there are.

    Sources in code point order, null last, weigh WEIGHTS in turn. They share SHARE of all sizes by weight;
    what is over MOST_EPOCHS of a source's size is shared again among the others. Every round fixes at
    least one source; rounds work on a table of the sources, only its totals come to the driver.
    """
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = written(ranked.select("source", "source_size", F.get(weights, (F.col("_rank") - 1) % len(WEIGHTS)).alias("_w")), "sources")
    most = F.col("source_size") * float(MOST_EPOCHS)
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # target for each unit of weight, of the sources that are not at their most
    while True:
        full = F.col("_w") * level > most if level else F.lit(False)
        free, held = ranked.agg(F.sum(F.when(~full, F.col("_w"))), F.coalesce(F.sum(F.when(full, most)), F.lit(0.0))).first()
        new = (total * SHARE - held) / free if free else level
        if new <= level or not free:
            break
        level = new
    return ranked.select("source", "source_size", F.least(most, F.col("_w") * level).alias("target"))


def _before(docs: DataFrame) -> DataFrame:
    """Add to (source, _key, size, ...) the words of the source's documents with smaller keys, as ``_before``.

    One range sort of narrow rows; a source's rows may lie in many partitions. Within a partition a window
    adds up, and the partitions' totals, a row for each partition and source in it, are added up in turn.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("_tie")]
    placed = written(docs.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "placed")
    totals = placed.groupBy("_part", "source").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_part").alias("_p"), F.col("source").alias("_s"),
                           F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_part", "source").orderBy("_key", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(totals, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_before", F.col("_ahead") + F.col("_inside"))


def _row_key() -> Column:
    """Hash of id, text and source; a null source is no source's name."""
    return F.xxhash64("doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text")


def mix(docs: DataFrame, weight: Column | None = None, cut_last: bool = True) -> DataFrame:
    """How much of each row of ``docs(doc_id, text, source)`` the mix takes.

    doc_id, size (words; null text 0), source_size, target (of its source) and taken (words, repeats
    counted), and ``row_key``, a hash of id, text and source. With ``cut_last`` the document at the end of a budget
    gives only the words that are missing; without, it comes whole if that is nearer to the target.
    Rows of equal keys (repeated rows) follow each other in an order fixed by the plan's own row numbers.
    A null source is a source of its own, a null id has a key by its text alone.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", size_in_words("text").alias("size"),
        _row_key().alias("row_key"),
        sampling_key(weight if weight is not None else quality_weight("text"), "doc_id", "text").alias("_key"),
    ).withColumn("_tie", F.monotonically_increasing_id())
    rows = written(rows, "sized")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumnRenamed("source", "_source")
    placed = _before(rows).join(plan, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size") - F.col("_before")  # budget left for this document
    if cut_last:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.round(rest).cast("long")))
    else:
        part = F.when(rest * 2 >= F.col("size"), F.when(rest > 0, F.col("size")).otherwise(0)).otherwise(0)
    taken = (epochs * F.col("size") + part).cast("long")
    copies = (epochs + F.when((part > 0) | (F.col("size") == 0) & (rest > 0), 1).otherwise(0)).cast("int")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"),
                         "source", "row_key")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, as often as whole copies are taken, with all their columns.

    Rows that repeat id, text and source share the copies that were planned for them, the first ones one more if they
    don't come out even; the same text in another source has that source's copies. No rows give none.
    """
    amount = mix(docs, cut_last=False)
    copies = amount.groupBy(F.col("row_key").alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    rows = docs.select(F.struct("*").alias("row"), _row_key().alias("_key")).join(copies, "_key")
    # Only repeated rows are numbered: within the part that they lie in, after those of the parts before.
    repeated = written(rows.where("_rows > 1").withColumn("_part", F.spark_partition_id()).withColumn("_tie", F.monotonically_increasing_id()), "repeated")
    parts = repeated.groupBy("_part", "_key").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_key", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy("_part", "_key").orderBy("_tie"))
    repeated = repeated.withColumn("_inside", inside).join(parts, ["_part", "_key"])
    one_more = F.col("_ahead") + F.col("_inside") <= F.col("_copies") % F.col("_rows")
    share = F.floor(F.col("_copies") / F.col("_rows")) + F.when(one_more, 1).otherwise(0)
    repeated = repeated.select("row", share.cast("long").alias("_copies")).where("_copies > 0")
    every = rows.where("_rows = 1").select("row", "_copies").unionByName(repeated)
    return every.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
