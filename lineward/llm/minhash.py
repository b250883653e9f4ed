"""Near-duplicates of word shingles: one-permutation MinHash, banded buckets, star-shaped candidate edges.

Documents of equal shingle sets are one class, however many they are. A class has one hash per bin of one
permutation; an empty bin takes the value of another bin, by an order that is the same for all (optimal
densification). Bands of values are buckets. In each bucket the class that shares most buckets is the centre,
and only edges from it are candidates. Links are confirmed on the full sets. A bucket whose classes are then
not all connected is searched again: its classes are compared with those of the other components in blocks,
first by their sketches, then by their full sets, so that no link depends on the choice of centres. A block
hands on no candidates, only links that join components.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import chunks, components, in_batches, joined_to_groups, mix64, texts_of, with_partner, written

SHINGLE, SIMILARITY = 4, 80
BINS, ROWS = 128, 4
#: Classes of a family that are compared by one task with as many others.
BLOCK = 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Standard deviations that a sketch's estimate may lie below the similarity.
_DEVIATIONS = 5
_SETS_HELD = 256
#: Characters of text whose shingles are held at once.
_CHUNK = 1 << 18


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, text after text, and how many each has.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text of fewer words is one shingle.
    """
    raw = [t.encode("utf-8") + b" " for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8)
    ends_of = np.cumsum([len(r) for r in raw])
    space = (b == 32) | ((b >= 9) & (b <= 13))
    code = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint64) + np.uint64(1)
    word = ~space
    starts = np.flatnonzero(word & ~np.append(False, word[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    # A word's hash: its bytes weighted by their place, as a difference of running sums.
    place = np.arange(len(b)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(b)]])))
    weight = mix64(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(word, code * weight, np.uint64(0)))])
    names = mix64(run[ends] - run[starts])
    owner = np.searchsorted(ends_of, starts, "right")
    n_words = np.bincount(owner, minlength=len(texts))
    # Shingles start at every word that has enough words after it; short texts have one at their first.
    first = np.concatenate([[0], np.cumsum(n_words)[:-1]])
    left = (np.repeat(n_words, n_words) - (np.arange(len(names)) - np.repeat(first, n_words)))
    total = np.zeros(len(names), np.uint64)
    padded = np.append(names, np.zeros(size, np.uint64))
    for i in range(size):
        own = np.where(left > i, padded[i:i + len(names)], np.uint64(0))  # zero where the text has ended
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + own)
    at = np.flatnonzero((left >= size) | ((np.repeat(n_words, n_words) < size) & (left == np.repeat(n_words, n_words))))
    values, of = total[at], owner[at]
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.append(True, (values[1:] != values[:-1]) | (of[1:] != of[:-1]))
    values, of = values[new], of[new]
    return values, np.bincount(of, minlength=len(texts))


def _orders() -> np.ndarray:
    """For each bin the order in which it asks the others for a value."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


_ORDERS = _orders()


def sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One row of BINS values for each text with shingles."""
    counts = counts[counts > 0]
    out = np.full((len(counts), BINS), _EMPTY)
    of = np.repeat(np.arange(len(counts)), counts)
    slot = of * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    lowest = np.append(True, slot[1:] != slot[:-1]) if len(slot) else np.zeros(0, bool)
    out.reshape(-1)[slot[lowest]] = values[lowest]
    full = out != _EMPTY
    row, bin_ = np.nonzero(~full)
    for i in range(BINS):
        if not len(row):
            break
        ask = _ORDERS[bin_, i]
        has = full[row, ask]
        out[row[has], bin_[has]] = out[row[has], ask[has]]
        row, bin_ = row[~has], bin_[~has]
    return out


def short(sketch: np.ndarray) -> np.ndarray:
    """The last 16 bits of each value: what is kept, for buckets and for estimates."""
    return (sketch & np.uint64(0xFFFF)).astype("<u2")


def bands(sketch: np.ndarray) -> np.ndarray:
    """Bucket of each band of short sketches; the band is part of it."""
    sketch = sketch.astype(np.uint64)
    total = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64) + np.uint64(1), (len(sketch), BINS // ROWS)).copy()
    for i in range(ROWS):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + sketch[:, i::ROWS])
    return total.view(np.int64)


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document without its text: number of shingles, digest of the set, sketch."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks([len(t) for t in texts], _CHUNK):
                values, counts = shingles(texts[a:b], size)
                sketch = short(sketches(values, counts))
                ends = np.cumsum(counts)
                keys, own, i = [], [], 0
                for end, n in zip(ends.tolist(), counts.tolist()):
                    keys.append(hashlib.blake2b(values[end - n:end].tobytes(), digest_size=16).digest() if n else None)
                    own.append(sketch[i].tobytes() if n else None)
                    i += n > 0
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(a, b - a), "text_key": batch.column(2).slice(a, b - a), "n_shingles": counts,
                    "set_key": pa.array(keys, pa.binary()), "sketch": pa.array(own, pa.binary())})

    return in_batches(texts_of(docs).withColumn("text_key", F.xxhash64("text")),
                      run, "doc_id long, text_key long, n_shingles long, set_key binary, sketch binary")


def _members(classes: DataFrame) -> DataFrame:
    """(node, bucket): the buckets of each class, from its sketch."""

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                sketch = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, BINS)
                yield pa.RecordBatch.from_pydict({"node": np.repeat(part.column(0).to_numpy(), BINS // ROWS), "bucket": bands(sketch).reshape(-1)})

    return in_batches(classes.select("node", "sketch"), run, "node long, bucket long")


def _possible(n_a, n_b, agree):
    """Whether sizes and the share of equal bins leave room for the similarity; numpy arrays."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    share = SIMILARITY / 100
    least = share - _DEVIATIONS * np.sqrt(share * (1 - share) / np.minimum(low, BINS))
    return (100 * low >= SIMILARITY * high) & (agree >= least)


def _sketch_test(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out."""
    own = classes.select("node", "n_shingles", "sketch")
    joined = (pairs.join(own.toDF("a", "n_a", "sketch_a"), "a").join(own.toDF("b", "n_b", "sketch_b"), "b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
                ok = _possible(batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), (sa == sb).mean(1))
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return in_batches(joined, run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, on the full sets of both texts."""
    joined = (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
              .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))

    def run(batches):
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def sets(nodes, column):
            new = {k: i for i, k in enumerate(nodes) if k not in held}
            values, counts = shingles([column[i].as_py() for i in new.values()], size)
            held.update(zip(new, np.split(values, np.cumsum(counts)[:-1])))

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                sets(a, part.column("text_a"))
                sets(b, part.column("text_b"))
                ok = []
                for x, y in zip(a, b):
                    both = len(np.intersect1d(held[x], held[y], assume_unique=True))
                    ok.append(100 * both >= SIMILARITY * (len(held[x]) + len(held[y]) - both))
                while len(held) > _SETS_HELD:
                    held.popitem(last=False)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return in_batches(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _likely(pdf: pd.DataFrame) -> pd.DataFrame:
    """The classes of two blocks that their sketches may link with one of another component: the others need no text."""
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    a, b = (pdf[pdf["block"] == k] for k in (x, y))
    if not len(a) or not len(b):
        return pdf.iloc[:0][_PLACED]
    sa, sb = (np.frombuffer(b"".join(f["sketch"]), "<u2").reshape(-1, BINS) for f in (a, b))
    na, nb, la, lb = (f[c].to_numpy() for c in ("n_shingles", "label") for f in (a, b))
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for j in range(len(b)):
        some = (la != lb[j]) & (100 * np.minimum(na, nb[j]) >= SIMILARITY * np.maximum(na, nb[j]))
        some = np.flatnonzero(some & ~in_a if in_b[j] else some)
        if len(some):
            ok = some[_possible(na[some], nb[j], (sa[some] == sb[j]).mean(1))]
            in_a[ok] = True
            in_b[j] |= len(ok) > 0
    return pd.concat([a[in_a], b[in_b]])[_PLACED].drop_duplicates()


_PLACED = ["hub", "x", "y", "block", "label", "node"]


def _across(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """Links between two blocks of a family, as far as they join components: confirmed on the full sets.

    A pair is looked at if its components are still apart and the sketches leave room for the similarity.
    """
    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    a, b = (pdf[pdf["block"] == k].sort_values("node") for k in (x, y))
    links: list[tuple[int, int]] = []
    if len(a) and len(b):
        label_of, labels = np.unique(np.concatenate([a["label"], b["label"]]), return_inverse=True)
        now = np.arange(len(label_of))  # components that have met count as one
        la, lb = labels[:len(a)], labels[len(a):]
        sa, sb = (np.frombuffer(b"".join(f["sketch"]), "<u2").reshape(-1, BINS) for f in (a, b))
        na, nb, ka, kb, ta, tb = (f[c].to_numpy() for c in ("n_shingles", "node", "text") for f in (a, b))
        sets: dict[int, np.ndarray] = {}

        def whole(key, text):
            if key not in sets:
                sets[key] = shingles([text], size)[0]
            return sets[key]

        for j in range(len(b)):
            some = np.flatnonzero((now[la] != now[lb[j]]) & (100 * np.minimum(na, nb[j]) >= SIMILARITY * np.maximum(na, nb[j])))
            if x == y:
                some = some[some < j]
            if not len(some):
                continue
            agree = (sa[some] == sb[j]).mean(1)
            likely = _possible(na[some], nb[j], agree)
            for i in some[likely][np.argsort(-agree[likely], kind="stable")].tolist():
                if now[la[i]] == now[lb[j]]:
                    continue
                one, other = whole(ka[i], ta[i]), whole(kb[j], tb[j])
                both = len(np.intersect1d(one, other, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(one) + len(other) - both):
                    links.append((ka[i], kb[j]))
                    now[now == now[lb[j]]] = now[la[i]]
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _families(members: DataFrame, links: DataFrame) -> DataFrame:
    """(hub, node, label): classes of buckets with more than one component, beside the largest one of their bucket.

    Two classes of a bucket are in the family of its hub. A family holds what shares a bucket with its hub,
    not what shares one with that in turn.
    """
    placed = components(links)
    sizes = placed.groupBy("component").agg(F.count("*").alias("n_own"))
    placed = placed.join(sizes, "component")
    named = members.select("bucket", "node").join(placed, "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("label"), F.coalesce("n_own", F.lit(1)).alias("n_own"))
    mixed = named.groupBy("bucket").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("n_own", "label")).alias("top")
    ).where("lo <> hi").select("bucket", F.col("top.label").alias("hub"))
    return named.join(mixed, "bucket").select("hub", "node", "label").distinct()


def _block_pairs(family: DataFrame) -> DataFrame:
    """Each class with every pair (x, y) of blocks of its family that it is in; pairs within the hub are left out."""
    own = F.col("label") == F.col("hub")
    counts = family.groupBy("hub").agg(
        F.ceil(F.count_if(own) / BLOCK).alias("b_own"), F.ceil(F.count_if(~own) / BLOCK).alias("b_other"))
    place = F.xxhash64("node")
    dealt = family.join(counts, "hub").withColumn("block", F.when(own, F.pmod(place, F.col("b_own"))).otherwise(
        F.col("b_own") + F.pmod(place, F.col("b_other"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b_own") + F.col("b_other") - 1)))
    return dealt.select("hub", "node", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                        "b_own").where("y >= b_own").drop("b_own")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``.

    A link: 100 * intersection >= 80 * union of the sets of distinct shingles of ``size`` words. Null, empty and blank
    texts have no shingles and link with nothing. component_id is the smallest doc_id reachable by links; kept
    is doc_id = component_id. Repeated rows have equal sets and so one component; a row without id has
    the component of its links, or null, and isn't kept. Two texts at the threshold share a bucket with a
    probability of 1 - 5e-8.
    """
    return _placed(docs, size).drop("text_key")


def _placed(docs: DataFrame, size: int) -> DataFrame:
    """The rows of ``near_duplicates`` with the key of their text."""
    rows = written(_sketched(docs, size), "sketches")
    classes = rows.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    members = _members(classes)
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = members.join(shared, "bucket")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = written(members.join(degree, "node").select("bucket", "node", "degree"), "members")
    # One column as the key, null ids included: the join's partitions serve the aggregate that follows.
    ids = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("key"))
    whole = texts_of(docs).select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("key"), "text")
    whole = with_partner(whole, ids, ["key"])  # texts that share no bucket stay where they are
    texts = written(whole.join(ids, "key").groupBy("key").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "texts")

    centre = members.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("n"))).alias("top")).select(
        "bucket", (-F.col("top.n")).alias("a"))
    star = members.join(centre, "bucket").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = written(_confirmed(_sketch_test(star, classes), texts, size), "links")

    # Buckets with more than one component left: their classes are compared across components, block by block.
    # First by their sketches, which say who needs a text at all; blocks are dealt out by their number, not their bytes.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketched = classes.select("node", "n_shingles", "sketch")
    pairs = _block_pairs(written(_families(members, links), "families")).join(sketched, "node").repartition(parts, "hub", "x", "y")
    likely = written(pairs.groupBy("hub", "x", "y").applyInPandas(_likely, "hub long, x long, y long, block long, label long, node long"), "likely")
    pairs = likely.join(sketched, "node").join(texts, "node").repartition(parts, "hub", "x", "y")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        return _across(pdf, size)

    more = written(pairs.groupBy("hub", "x", "y").applyInPandas(across, "a long, b long"), "links")

    placed = components(links.union(more))
    named = written(classes.select("node", "set_key", "low", "copies").join(placed, "node", "left").select(
        "set_key", "low", "copies", F.coalesce("component", "node").alias("component")), "named")
    lowest = written(named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "lowest")
    named = joined_to_groups(named, lowest, ["component"], "n", named.count())
    named = written(named.select("set_key", "copies", "component_id"), "named")
    out = rows.select("doc_id", "text_key", "n_shingles", "set_key")
    out = joined_to_groups(out.where("set_key is not null"), named, ["set_key"], "copies", rows.count()).drop("copies").unionByName(
        out.where("set_key is null").withColumn("component_id", F.col("doc_id")))
    component = F.col("component_id")
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without all but one document of each group of near-duplicates, all columns.

    The document with the smallest id stays. Rows without id stay, since nothing names them. Of rows that
    repeat an id each different text counts for itself; of equal rows that stay one stays.
    """
    found = written(_placed(docs, size).where("doc_id is not null").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept"), "found")
    repeated = found.where("kept").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id")
    repeated = written(found.where("kept").join(repeated, "_id", "left_semi").select("_id", "_key").distinct(), "repeated")
    named = found.where("not kept").select("_id", "_key").union(repeated).distinct()
    # Rows that may be named by neither list stay without a shuffle: texts move only to be looked up in them.
    rows = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_key": F.xxhash64(F.coalesce("text", F.lit("")))})
    alone = with_partner(rows, named, ["_id", "_key"], "left_anti")
    once = with_partner(rows, named, ["_id", "_key"]).join(named, ["_id", "_key"], "left_anti")
    again = with_partner(rows, repeated, ["_id", "_key"]).join(repeated, ["_id", "_key"], "left_semi")
    return alone.select(docs.columns).unionByName(once.select(docs.columns)).unionByName(
        again.select(docs.columns).dropDuplicates(["doc_id", "text"]))
