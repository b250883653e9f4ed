"""Document fingerprints by locally consistent parsing.

A text is parsed level by level. Neighbouring equal symbols become one; then deterministic coin tossing
gives each symbol a small label that depends on a few symbols to its left only, and phrases start where
labels are locally largest. A phrase's name is a hash of what it holds, and names are the symbols of the next
level. What two texts share is so cut alike, wherever it stands, but for a few symbols at its ends; names of
all phrases but the smallest are sketched into one string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import chunks, codepoints, mix64, texts_of

#: Values of a fingerprint, four hexadecimal digits each; phrases count from this level on.
VALUES, FROM_LEVEL = 64, 2
_ROUNDS = 4  # 64 bits: labels below 128, 14, 8, 6
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _runs(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours of a text become one symbol, named after symbol and number."""
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(names)))
    kept = names[at]
    many = size > 1
    kept[many] = mix64(kept[many] ^ (size[many].astype(np.uint64) * _STEP))
    return kept, first[at]


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: twice the lowest bit in which a symbol differs from the one before it, and that bit."""
    now = names
    for _ in range(_ROUNDS):
        differ = np.empty_like(now)
        differ[1:] = now[1:] ^ now[:-1]
        differ[first] = 1
        low = differ & (~differ + np.uint64(1))
        bit = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
        now = (bit << np.uint64(1)) | ((now >> bit) & np.uint64(1))
    return now.astype(np.int8)


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and which are the first of a text."""
    label = _labels(names, first)
    start = first.copy()
    # A text starts a phrase; others start where a label is above both neighbours', not right after one.
    if len(label) > 2:
        inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        start[1:-1] |= inner & ~first[:-2] & ~first[2:]
    at = np.flatnonzero(start)
    place = np.arange(len(names)) - np.repeat(at, np.diff(np.append(at, len(names))))
    return mix64(np.add.reduceat(mix64(names + place.astype(np.uint64) * _STEP), at)), first[at]


def fingerprints(texts: list[str]) -> list[str]:
    """A string of 4 * VALUES hexadecimal digits for each text; an empty text has zeros."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), VALUES), 1 << 32, np.uint64)
    own = np.flatnonzero(sizes)  # texts with symbols
    if len(own):
        names = mix64(codepoints("".join(texts)).astype(np.uint64) + np.uint64(1))
        first = np.zeros(len(names), bool)
        first[(np.cumsum(sizes) - sizes)[own]] = True
        level, bits = 0, VALUES.bit_length() - 1
        while len(own):
            level += 1
            names, first = _phrases(*_runs(names, first))
            counts = np.diff(np.append(np.flatnonzero(first), len(names)))
            # The phrase that is a whole text counts at any level; the text is then done.
            counted = np.repeat((counts == 1) | (level >= FROM_LEVEL), counts)
            hashed = mix64(names[counted])
            slot = np.repeat(own, counts)[counted] * VALUES + (hashed >> np.uint64(64 - bits)).astype(np.int64)
            np.minimum.at(out.reshape(-1), slot, hashed & np.uint64(0xFFFFFFFF))
            going = np.repeat(counts > 1, counts)
            names, first, own = names[going], first[going], own[counts > 1]
    short = np.where(out < (1 << 32), (out >> np.uint64(16)) % np.uint64(0xFFFF) + np.uint64(1), 0).astype(">u2")
    return [row.tobytes().hex() for row in short]


def likeness(a: str, b: str) -> float:
    """Share of equal values among those that either has: an estimate of the phrases in common; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float(((x == y) & (x > 0)).sum() / ((x > 0) | (y > 0)).sum())


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many of the first characters of the other."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compared(keys: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Rows of the result; ``following`` holds the document after each text."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    # The document after each is the next row's, but for the last.
    known = fingerprints([*texts, following[-1]])
    new = fingerprints(changed)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(keys, pa.int64()), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fingerprint": known[:-1], "edited_fingerprint": new,
        "near_edited": [likeness(a, b) for a, b in zip(known, new)],
        "near_next": [likeness(a, b) for a, b in zip(known, known[1:])]})


def _walk(batches):
    """Rows in order; a copy of the next part's first row ends each part and has no result of its own."""
    keys: list = []
    texts: list[str] = []
    for batch in batches:
        ids, found, copies = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for a, b in chunks([len(t) for t in found]):
            for key, text, copy in zip(ids[a:b], found[a:b], copies[a:b]):
                if copy and not texts:
                    continue
                if copy:
                    yield _compared(keys, texts, [*texts[1:], text])
                    keys, texts = [], []
                else:
                    keys.append(key)
                    texts.append(text)
            if len(texts) > 1:  # all but the last, whose next row isn't known yet
                yield _compared(keys[:-1], texts[:-1], texts[1:])
                keys, texts = keys[-1:], texts[-1:]


def compare_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of ``docs(doc_id, text)`` and of its edited text, and their likeness.

    Columns as in _RESULT. The next document is the one with the next smaller doc_id (equal ids by text, null
    ids last), after the last comes the first. Null texts are empty; an empty text's fingerprint is zeros and
    is like nothing but another empty one. Documents are dealt out once, by ranges of doc_id that start at
    existing ids; a range also gets a copy of the next one's first document.
    """
    texts = texts_of(docs)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shares = [i / parts for i in range(1, parts)]
    largest, quantiles = texts.agg(F.max("doc_id"), F.percentile_approx("doc_id", shares or [0.5], 100 * parts)).first()
    # The first ids of the ranges after the first, falling: bounded by the number of partitions.
    starts = sorted({q for q in quantiles or [] if q != largest}, reverse=True) if shares else []
    bounds = F.array(*[F.lit(s).cast("long") for s in starts]) if starts else F.array().cast("array<long>")
    part = F.coalesce(F.size(F.filter(bounds, lambda s: F.col("doc_id") <= s)), F.lit(0))
    part = F.when(F.col("doc_id").isNull(), len(starts)).otherwise(part)
    here = F.struct(part.alias("part"), F.lit(False).alias("copy"))
    before = F.when(F.array_contains(bounds, F.col("doc_id")), F.struct((part - 1).alias("part"), F.lit(True).alias("copy")))
    ring = F.when(F.col("doc_id").eqNullSafe(F.lit(largest).cast("long")), F.struct(F.lit(len(starts)).alias("part"), F.lit(True).alias("copy")))
    dealt = texts.withColumn("at", F.explode(F.array_compact(F.array(here, before, ring)))).select("doc_id", "text", "at.*")
    dealt = dealt.repartitionById(len(starts) + 1, F.col("part").cast("int"))
    dealt = dealt.sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.select("doc_id", "text", "copy").mapInArrow(_walk, _RESULT)
