"""Interaction of quality filters: what each removes, in every order of applying them.

Words become columns of a sparse document-term matrix. Documents are counted in blocks; the words of all blocks
form one dictionary, whose numbers go back to the blocks that hold them, and each block becomes a shard of the
matrix in CSR form. Row sums and numbers of nonzero entries decide the filters on words. A document is then no
more than the set of filters that it fails, so all orders are worked out on counts of such sets.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import joined_to_groups, written

#: Characters, documents and different words that a block holds at most before it is closed.
BLOCK_CHARS, BLOCK_DOCS, BLOCK_WORDS = 1 << 25, 50_000, 1 << 20
#: Bytes of a text that are split into words together.
_SLICE = 1 << 22
_SPACE = b" \t\n\r\x0b\x0c"

# Limits of the filters, which are named by letters.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 100, 80, 10, r"[#$%&*|]"


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in parts that end where a word ends."""
    at = 0
    while len(raw) - at > _SLICE:
        part = raw[at:at + _SLICE]
        stop = max(part.rfind(c) for c in (_SPACE[i:i + 1] for i in range(len(_SPACE))))
        if stop < 0:  # one word; it goes on to its end
            ends = [e for e in (raw.find(_SPACE[i:i + 1], at + _SLICE) for i in range(len(_SPACE))) if e >= 0]
            stop = (min(ends) if ends else len(raw)) - at
        yield raw[at:at + stop]
        at += stop + 1
    yield raw[at:]


def word_counts(text: str) -> Counter:
    """How often each word of a text occurs; bytes split at ASCII white space and nothing else."""
    raw = text.encode()
    if len(raw) <= _SLICE:
        return Counter(raw.split())
    total: Counter = Counter()
    for part in _slices(raw):
        total.update(part.split())
    return total


def _counted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with their words as numbers within a block, and a row for each block with its words.

    ``rows`` has a string ``text``, which goes, and the columns ``keep``, which stay.
    """
    kinds = dict(rows.dtypes)
    schema = ["block long", *[f"{c} {kinds[c]}" for c in keep], "terms binary", "times binary", "words array<binary>"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        chars = 0
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        held: list[tuple] = []
        where = None

        def flush() -> Iterator[pa.RecordBatch]:
            i, terms, times = ([x[k] for x in held] for k in range(3))
            n = len(held)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), *[pa.array([where.column(c)[k].as_py() for k in i], where.column(c).type) for c in keep],
                     pa.array(terms, pa.binary()), pa.array(times, pa.binary()), pa.nulls(n, pa.list_(pa.binary()))], names)
                held.clear()

        def words() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), *[pa.nulls(1, where.column(c).type) for c in keep], pa.nulls(1, pa.binary()),
                 pa.nulls(1, pa.binary()), pa.array([list(known)], pa.list_(pa.binary()))], names)

        names, n_docs = ["block", *keep, "terms", "times", "words"], 0
        for batch in batches:
            where = batch
            for i, text in enumerate(batch.column("text").to_pylist()):
                if n_docs and (chars + len(text) > BLOCK_CHARS or n_docs >= BLOCK_DOCS or len(known) > BLOCK_WORDS):
                    yield from flush()
                    yield words()
                    known.clear()
                    block, chars, n_docs = block + 1, 0, 0
                found = word_counts(text)
                terms = np.fromiter(map(known.__getitem__, found), "<u4", len(found))
                times = np.fromiter(found.values(), "<i8", len(found))
                times = times.astype("<u2" if not len(times) or times.max() < 1 << 16 else "<u4")
                held.append((i, terms.tobytes(), times.tobytes()))
                chars, n_docs = chars + len(text), n_docs + 1
            yield from flush()
        if n_docs:
            yield words()

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(schema))


class Shard:
    """Rows of the document-term matrix in CSR form: row i is ``indices`` and ``data`` from indptr[i] to indptr[i + 1]."""

    def __init__(self, docs: pa.Table, terms: pa.Table):
        column = np.zeros(terms.num_rows, np.int64)
        column[terms.column("local").to_numpy()] = terms.column("term").to_numpy()
        pieces = [np.frombuffer(x.as_buffer(), "<u4") for x in docs.column("terms")]
        sizes = np.array([len(x) for x in pieces], np.int64)
        times = [np.frombuffer(x.as_buffer(), "<u2" if x.as_buffer().size == 2 * n else "<u4") for x, n in zip(docs.column("times"), sizes.tolist())]
        self.indptr = np.concatenate([[0], np.cumsum(sizes)])
        self.indices = column[np.concatenate([*pieces, np.zeros(0, np.uint32)]).astype(np.int64)]
        self.data = np.concatenate([*times, np.zeros(0, np.uint16)]).astype(np.int64)

    def row_sums(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.data)])[self.indptr])

    def nonzero(self) -> np.ndarray:
        return np.diff(self.indptr)


def _numbered(named: DataFrame) -> DataFrame:
    """(block, local, term, word) from (block, local, word): each word's number in the corpus, the word in one of its rows only.

    One shuffle by word: in a sorted partition a word's number is how many others came before it, and partitions
    follow each other. Only their sizes come to the driver, one for each.
    """
    spark = named.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        part, last, at = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(2)
            new = np.append(word[0].as_py() != last, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False))
            place = at + np.cumsum(new)
            last, at = word[len(word) - 1].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(word), part, np.int32)), batch.column(0), batch.column(1), pa.array(place), pc.if_else(pa.array(new), word, None)],
                ["part", "block", "local", "at", "word"])

    sorted_ = named.select("block", "local", "word").repartition(parts, "word").sortWithinPartitions("word")
    placed = written(sorted_.mapInArrow(run, "part int, block long, local int, at long, word binary"), "terms")
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg((F.max("at") + 1).alias("n")).collect())
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, accumulate((n for _, n in sizes), initial=0))], "part int, base long")
    return placed.join(F.broadcast(bases), "part").select("block", "local", (F.col("base") + F.col("at")).alias("term"), "word")


def _shards(rows: DataFrame, keep: list[str]) -> tuple:
    """Documents and the numbers of their words, both grouped by block, and the global dictionary."""
    counted = written(_counted(rows, keep), "counted")
    terms = _numbered(counted.where("words is not null").select("block", F.posexplode("words").alias("local", "word")))
    dictionary = terms.where("word is not null").select("word", "term")
    terms = terms.select(F.col("block").alias("of"), "local", "term")
    return counted.where("words is null").drop("words").groupBy("block").cogroup(terms.groupBy("of")), dictionary


def term_matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix of ``docs(doc_id, text)`` and its dictionary.

    Matrix: shard, doc_id, and the row as indices (ascending) and data. Dictionary: word (bytes) and term, its index
    from 0 on without gaps. Null and empty texts have empty rows; repeated rows are rows of their own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    grouped, dictionary = _shards(rows, ["doc_id"])

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left, right)
        indices, data = [], []
        for i, j in zip(shard.indptr.tolist(), shard.indptr[1:].tolist()):
            order = np.argsort(shard.indices[i:j])
            indices.append(shard.indices[i:j][order])
            data.append(shard.data[i:j][order])
        return pa.table({"shard": left.column("block"), "doc_id": left.column("doc_id"),
                         "indices": pa.array(indices, pa.list_(pa.int64())), "data": pa.array(data, pa.list_(pa.int64()))})

    return (grouped.applyInArrow(build, "shard long, doc_id long, indices array<long>, data array<long>"),
            dictionary)


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and ``fails``, the letters of the failed filters in order, for every row of ``docs(doc_id, text, lang)``.

    A: under 100 words; B: under 80 different words in 100; C: over 10 characters A-Z in 100; D: holds one of # $ % & * |;
    E: equal to the text of a row with a smaller doc_id. Null text: empty; null lang: the empty part. A null
    id has no smaller ones and is none. Empty texts fail A, and E if they repeat.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length(text)).alias("c"), text.rlike(MARKS).alias("d"),
        F.unhex(F.sha2(text, 256)).alias("key"))
    grouped, _ = _shards(rows, ["doc_id", "part", "c", "d", "key"])

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left, right)
        words, distinct = shard.row_sums(), shard.nonzero()
        return left.select(["doc_id", "part", "c", "d", "key"]).append_column("a", pa.array(words < LEAST_WORDS)).append_column(
            "b", pa.array(100 * distinct < LEAST_DISTINCT * words))

    decided = written(grouped.applyInArrow(decide, "doc_id long, part string, c boolean, d boolean, key binary, a boolean, b boolean"), "decided")
    groups = decided.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1"), "same-texts")
    known = joined_to_groups(decided, groups, ["key"], "n", decided.count())
    failed = {"A": F.col("a"), "B": F.col("b"), "C": F.col("c"), "D": F.col("d"), "E": F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))}
    return known.select("doc_id", "part", F.concat(*[F.when(failed[f], f).otherwise("") for f in FILTERS]).alias("fails"))


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """What the filters of ``failures`` remove from each part, for all orders and steps.

    part, filter_order, step, and counts: kept, removed, redundant (failing, removed earlier), unique_fails (failing
    nothing else), good_lost and toxic_lost (removed, with quality or toxic 1 in ``labels``), shapley (removed by this
    filter at any step, over all orders). Documents of several label rows have a label if one of them has. Parts
    without documents have no rows.
    """
    # Repeated ids are counted before they meet their label.
    rows = failed.groupBy("doc_id", "part", "fails").agg(F.count("*").alias("n"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    # A row for each part, set of failed filters and label.
    sets = written(rows.join(known, "doc_id", "left").groupBy(
        "part", "fails", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.sum("n").alias("n")), "fail-sets")
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = sets.withColumn("filter_order", F.explode(F.lit(orders))).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    letter = F.substr(F.col("filter_order"), F.col("step"), F.lit(1))
    fails = F.contains(F.col("fails"), letter)

    def none_of(letters: Column) -> Column:
        return F.call_function("translate", letters, F.col("fails"), F.lit("")) == letters

    steps = steps.select(
        "part", "filter_order", "step", "n", "good", "toxic", fails.alias("bad"), (F.col("fails") == letter).alias("only"),
        F.length("fails").alias("n_fails"), none_of(F.substr(F.col("filter_order"), F.lit(1), F.col("step") - 1)).alias("there"))

    def total(when: Column, n: Column | None = None) -> Column:
        return F.sum(F.when(when, F.col("n") if n is None else n).otherwise(0)).cast("long")

    removed = F.col("there") & F.col("bad")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("there") & ~F.col("bad")).alias("kept"), total(removed).alias("removed"), total(F.col("bad") & ~F.col("there")).alias("redundant"),
        total(F.col("only")).alias("unique_fails"), total(removed & F.col("good")).alias("good_lost"),
        total(removed & F.col("toxic")).alias("toxic_lost"),
        # A filter comes before all others that a document fails in one of n_fails orders.
        total(F.col("bad"), F.expr(f"n * {len(orders)} div greatest(n_fails, 1)")).alias("shapley"))
