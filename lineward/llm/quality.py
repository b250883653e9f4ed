"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

A document is the mean of the vectors of its words and character n-grams; a linear layer and softmax give
the two classes. Vectors and layer are trained together by stochastic gradient descent in numpy. As the
layer is linear, a feature's vector counts in a score only through its product with the layer, so that the
model is sent to tasks as one number for each bucket.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import bounded_sample, chunks, in_batches, map_texts, mix64, texts_of

BUCKETS, DIMENSIONS, GRAMS = 1 << 17, 10, (2, 3, 4)
#: Features for "the word before, again" and "another word"; each word has one of them so many times.
_AGAIN, _OTHER, _PAIRS = np.uint64(0), np.uint64(1), 3
EPOCHS, RATE, SEED = 8, 20.0, 7
#: The classifier is fitted on at most so many labelled documents, half of each class, by a hash of their id.
FIT_DOCS = 4000
#: Characters of text whose features are held at once.
_CHUNK = 1 << 17
#: Score from which a document counts as good.
THRESHOLD = 0.3


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and character n-grams, and how many each text has; texts follow each other.

    A feature is a run of UTF-8 bytes; n-grams may begin or end with white space but not hold it inside.
    White space counts as a blank. A text without any is one blank, so it has features too.
    """
    raw = [b" " + t.encode("utf-8") + b" " for t in texts]
    sizes = np.array([len(r) for r in raw])
    b = np.frombuffer(b"".join(raw), np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    code = np.where(space, 32, b).astype(np.uint64) + np.uint64(1)
    first = np.zeros(len(b), bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    out, where = [], []
    gram = code.copy()
    bad = np.zeros(len(b), bool)  # an n-gram from here holds white space inside or leaves its text
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * np.uint64(1000003) + code[n - 1:]
        bad = bad[:-1] | first[n - 1:]
        if n > 2:
            bad |= space[n - 2:-1]
        if n in GRAMS:
            at = np.flatnonzero(~bad)
            out.append(mix64(gram[at] + np.uint64(n)) & np.uint64(BUCKETS - 1))
            where.append(at)
    # Words: difference of running sums of scrambled bytes, weighted by their place in the word.
    word = ~space
    starts = np.flatnonzero(word & ~np.append(False, word[:-1]))
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    if len(starts):
        place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else \
            np.arange(len(b)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))])
        weight = mix64(place.astype(np.uint64) + np.uint64(99)) | np.uint64(1)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(word, code * weight, np.uint64(0)))])
        names = mix64(run[ends] - run[starts])
        out.append(names & np.uint64(BUCKETS - 1))
        where.append(starts)
        # Word pairs, as far as they say something of words not seen before: the same word again, or another.
        text_of = np.searchsorted(np.cumsum(sizes), starts, "right")
        again = np.append(False, (names[1:] == names[:-1]) & (text_of[1:] == text_of[:-1]))
        out += [np.where(again, _AGAIN, _OTHER)] * _PAIRS
        where += [starts] * _PAIRS
    where, out = np.concatenate(where), np.concatenate(out).astype(np.int32)
    owner = np.searchsorted(np.cumsum(sizes), where, "right")
    order = np.argsort(owner, kind="stable")
    return out[order], np.bincount(owner, minlength=len(texts))


@dataclass
class QualityModel:
    """Contribution of each bucket to the difference of the classes' outputs, and their bias."""

    gain: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of the good class; every text has one."""
        ids, sizes = features(texts)
        ends = np.cumsum(sizes)
        total = np.add.reduceat(self.gain[ids], ends - sizes)
        return 1 / (1 + np.exp(-np.clip(total / sizes + self.bias, -30, 30)))


def fit(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Stochastic gradient descent over documents given as distinct buckets and how often they have them."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(ids)), 0
    # Each class weighs half of all, whatever their numbers.
    weight = [len(labels) / (2 * max(1, int((labels == c).sum()))) for c in (0, 1)]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(ids)):
            rate = np.float32(RATE * (1 - done / steps)) * np.float32(min(1.0, weight[labels[i]]) if weight[labels[i]] < 1 else 1.0)
            share = (counts[i] / counts[i].sum()).astype(np.float32)
            hidden = share @ vectors[ids[i]]
            out = hidden @ layer + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            step = np.float32(0.05) * rate
            layer -= step * np.outer(hidden, p)
            bias -= np.float32(0.02) * step * p
            vectors[ids[i]] -= (rate * share)[:, None] * back
            done += 1
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id="doc_id") -> F.Column:
    """Rows that are never trained on: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _narrow(counts: np.ndarray) -> bytes:
    """Whole numbers in the fewest of 1, 2 or 4 bytes that hold the largest."""
    most = int(counts.max(initial=0))
    return counts.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // n])


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as they are sent to the driver: many are small, so a byte or less each."""
    return zlib.compress(_narrow(numbers), 1)


def _gathered(rows) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets and counts of each row, all in two arrays that are given back as a whole."""
    ends = np.cumsum([r["n"] for r in rows])
    ids = np.empty(ends[-1], np.int32)
    counts = np.empty(ends[-1], "u1" if max(r["most"] for r in rows) < 1 << 8 else np.uint32)
    for r, end in zip(rows, ends.tolist()):
        some = slice(end - r["n"], end)
        np.cumsum(_widened(zlib.decompress(r["gaps"]), r["n"]), out=ids[some])
        counts[some] = _widened(zlib.decompress(r["counts"]), r["n"])
    return np.split(ids, ends[:-1]), np.split(counts, ends[:-1])


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on a bounded sample of the labelled documents that are not held out.

    ``labels(doc_id, quality)``; labels other than 0 and 1 and rows without id are left out, and the texts
    alone are inputs. Without labelled documents of both classes every score is one half.
    """
    known = (labels.where("quality in (0, 1) and doc_id is not null").where(~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")))
    chosen = [bounded_sample(known.where(F.col("quality") == c), FIT_DOCS // 2) for c in (0, 1)]
    sample = F.broadcast(chosen[0].union(chosen[1]))  # FIT_DOCS rows at most

    def run(keys, texts):
        ids, sizes = features(texts)
        each = [np.unique(x, return_counts=True) for x in np.split(ids, np.cumsum(sizes)[:-1])]
        return {"doc_id": keys, "n": pa.array([len(x) for x, _ in each], pa.int32()), "most": [int(n.max()) for _, n in each],
                "gaps": pa.array([_packed(np.diff(x, prepend=0)) for x, _ in each], pa.binary()),
                "counts": pa.array([_packed(n) for _, n in each], pa.binary())}

    rows = (map_texts(texts_of(docs).join(sample.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]),
                      run, "doc_id long, n int, most long, gaps binary, counts binary", _CHUNK)
            .join(sample, "doc_id").orderBy("doc_id").collect())
    if len({r["quality"] for r in rows}) < 2:
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0)
    ids, counts = _gathered(rows)
    labels = np.array([r["quality"] for r in rows])
    del rows
    return fit(ids, counts, labels)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text of ``docs(doc_id, text)``.

    Null and empty texts are scored as a text of one blank. Repeated rows come back as often, a row without
    id isn't held out. The model is 0.5 MB and sent to the tasks once.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys, texts):
        return {"doc_id": keys, "score": sent.value.scores(texts).astype(float)}

    return map_texts(texts_of(docs), run, "doc_id long, score double", _CHUNK).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more, all columns; scored and filtered where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            good = [sent.value.scores(texts[a:b]) >= THRESHOLD for a, b in chunks([len(t) for t in texts], _CHUNK)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return in_batches(docs, run, docs.schema)
