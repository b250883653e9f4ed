"""Alignment of two tokenizers over the same bytes.

Both sides cut the bytes of a text, so every token start lies in one token of the other side. ``merge_asof``,
keyed by document, finds that covering token for the starts of either side; the union of both directions is
all pairs of overlapping tokens. Where tokens of both sides end, a group ends.

How often a pair of ids is linked in the whole corpus takes a count of every document, so it is found in two
steps. Documents are handled in blocks. A block hands on its distinct pairs, these are counted by a shuffle,
and the counts a block asks for come back to it as one table, next to the block's documents.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import chunks, texts_of, written

#: Characters and documents that a block holds at most; a longer text is a block of its own.
BLOCK_CHARS, BLOCK_DOCS = 1 << 24, 20_000
#: Characters that are aligned together.
_CHUNK = 1 << 19

# Bytes that a byte-level vocabulary shows as themselves; the others follow each other from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of() -> dict[str, int]:
    shown = {chr(b): b for b in _SHOWN}
    return shown | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in shown)}


class ByteLevel:
    """Byte-level BPE of a tokenizers file; texts are encoded after a blank."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of, vocab = _byte_of(), self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [b""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            self.names[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode()
        self.fast = self._by_ranks(path)

    def _by_ranks(self, path: str):
        """The same encoding by ranks, four times as fast; only if the merges are in the order of the ids."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, byte_of = whole["model"], _byte_of()
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (made != sorted(made) or whole["normalizer"] or {k: (whole["pre_tokenizer"] or {}).get(k) for k in plain} != plain
                or model.get("ignore_merges") or model.get("dropout")):
            return None
        special = {t["content"] for t in whole["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> list[int]:
        # The pattern tries every length of a run of white space; a long one is left to the tokenizer itself.
        if self.fast is not None and len(text) < 1 << 16:
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(" " + t) for t in texts]


class Pieces:
    """Sentence pieces of a model file, which puts a blank before texts by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.names = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(map(self.model.id_to_piece, range(n)))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


@lru_cache(maxsize=2)
def _sides(a: str, b: str):
    """Both tokenizers, byte lengths of their ids, and all ids as text before each separator of a group list."""
    sides = tokenizer(a), tokenizer(b)
    sizes = [np.array([len(x) for x in s.names], np.int64) for s in sides]
    most = max(map(len, sizes))
    shown = [f"{i}{sep}" for sep in ",|;" for i in range(most)]
    return sides, sizes, most, shown


class Aligned:
    """The tokens of some texts on both sides, side by side in ``doc``, ``id``, ``start`` and ``end``, and their links.

    Starts and ends count the bytes of all texts together. A text without tokens has none on either side.
    """

    def __init__(self, texts: list[str], a: str, b: str):
        sides, sizes, most, _ = _sides(a, b)
        found = [s.encode(texts) for s in sides]
        empty: list[int] = []
        for i, text in enumerate(texts):
            raw = b" " + text.encode()
            if not text or any(b"".join(map(s.names.__getitem__, f[i])) != raw for s, f in zip(sides, found)):
                for f in found:
                    f[i] = empty
        self.counts = [np.array([len(x) for x in f], np.int64) for f in found]
        self.doc = [np.repeat(np.arange(len(texts)), n) for n in self.counts]
        self.id = [np.fromiter((i for x in f for i in x), np.int64, int(n.sum())) for f, n in zip(found, self.counts)]
        self.end = [np.cumsum(s[i]) for s, i in zip(sizes, self.id)]
        self.start = [e - s[i] for e, s, i in zip(self.end, sizes, self.id)]
        self.most = most
        self._groups()
        self._links()

    def _groups(self) -> None:
        """``ends``: whether a token ends a group; ``group``: the number of its group."""
        e, f = self.end
        self.ends = [np.isin(x, y, assume_unique=True) for x, y in ((e, f), (f, e))]
        self.group = [np.cumsum(x) - x for x in self.ends]

    def _links(self) -> None:
        """``link``: numbers of the tokens of both sides that overlap, each pair once, in the order of side a, then b."""
        frames = [pd.DataFrame({"doc": d, "start": s, side: np.arange(len(s))}) for side, d, s in zip("ab", self.doc, self.start)]
        x, y = frames
        over_a = pd.merge_asof(x, y, on="start", by="doc")["b"].to_numpy(np.int64)
        over_b = pd.merge_asof(y, x, on="start", by="doc")["a"].to_numpy(np.int64)
        new = self.start[0][over_b] != self.start[1]  # equal starts have been found from side a
        one = np.concatenate([x["a"].to_numpy(), over_b[new]])
        two = np.concatenate([over_a, y["b"].to_numpy()[new]])
        order = np.lexsort((two, one))
        self.link = one[order], two[order]

    def listed(self) -> np.ndarray:
        """The ids of all texts in the order of ``a1,a2|b1;a3|b2,b3``, as places in the list of shown ids."""
        a, b = self.ends
        n = max((int(g[-1]) + 1 for g in self.group if len(g)), default=0)
        in_a, in_b = (np.bincount(g, minlength=n) for g in self.group)
        before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        shown = np.empty(len(a) + len(b), np.int64)
        shown[np.arange(len(a)) + before_b[self.group[0]]] = self.id[0] + self.most * a
        shown[np.arange(len(b)) + upto_a[self.group[1]]] = self.id[1] + 2 * self.most * b
        return shown

    def per_doc(self, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, minlength=len(self.counts[0]))


def _pair_type(a: str, b: str) -> tuple[np.dtype, int]:
    """How a pair of ids is written: one number, a * factor + b."""
    _, (x, y), _, _ = _sides(a, b)
    return np.dtype("<u4" if len(x) * len(y) < 1 << 32 else "<u8"), len(y)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_DOCS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, counts binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("counts", pa.binary())])


def _aligned_docs(ids: list, texts: list[str], a: str, b: str) -> tuple[dict, np.ndarray, np.ndarray]:
    """A row for each text, with its distinct pairs, and the distinct pairs of all texts."""
    kind, factor = _pair_type(a, b)
    out = Aligned(texts, a, b)
    shown = out.listed()
    text = list(map(_sides(a, b)[3].__getitem__, shown.tolist()))
    stops = np.cumsum(out.counts[0] + out.counts[1]).tolist()
    digests = ["" if i == j else hashlib.sha256("".join(text[i:j])[:-1].encode()).hexdigest() for i, j in zip([0, *stops], stops)]
    i, j = out.link
    doc = out.doc[0][i]
    pair = out.id[0][i].astype(np.uint64) * np.uint64(factor) + out.id[1][j].astype(np.uint64)
    order = np.lexsort((pair, doc))
    pair, by_doc = pair[order], doc[order]
    first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (by_doc[1:] != by_doc[:-1]))) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(pair)))
    pair, by_doc = pair[first], by_doc[first]
    cuts = np.searchsorted(by_doc, np.arange(len(texts) + 1)).tolist()
    raw, n = pair.astype(kind), times.astype("<u4")
    rows = {"doc_id": ids, "n_a": out.counts[0], "n_b": out.counts[1], "n_groups": out.per_doc(out.doc[0][out.ends[0]]),
            "n_links": out.per_doc(doc), "groups_sha256": digests,
            "pairs": [raw[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], "counts": [n[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]}
    return rows, *_summed(pair, times)


def _blocks(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each document, in blocks, and one without other columns for each block: its distinct pairs."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        kind, _ = _pair_type(a, b)
        block = TaskContext.get().partitionId() << 32
        chars = n_docs = 0
        keys, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows(columns: dict) -> pa.RecordBatch:
            n = len(columns["pairs"])
            return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, [None] * n) for f in _SCHEMA} | {"block": [block] * n}, _SCHEMA)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y in chunks([len(t) for t in texts], _CHUNK):
                size = sum(map(len, texts[x:y]))
                if n_docs and (chars + size > BLOCK_CHARS or n_docs + y - x > BLOCK_DOCS):
                    yield rows({"pairs": [keys.astype(kind).tobytes()], "counts": [times.astype("<u8").tobytes()]})
                    block, chars, n_docs = block + 1, 0, 0
                    keys, times = keys[:0], times[:0]
                found, pair, n = _aligned_docs(ids[x:y], texts[x:y], a, b)
                yield rows(found)
                keys, times = _summed(np.concatenate([keys, pair]), np.concatenate([times, n]))
                chars, n_docs = chars + size, n_docs + y - x
        if n_docs:
            yield rows({"pairs": [keys.astype(kind).tobytes()], "counts": [times.astype("<u8").tobytes()]})

    return docs.mapInArrow(run, _DOCS)


def _block_pairs(blocks: DataFrame, kind: np.dtype) -> DataFrame:
    """(block, pair, n) for the distinct pairs of each block."""

    def run(batches):
        for batch in batches:
            for block, pairs, n in zip(*(c.to_pylist() for c in batch.columns)):
                keys, counts = np.frombuffer(pairs, kind).astype(np.int64), np.frombuffer(n, "<i8")
                for i in range(0, len(keys), 100_000):
                    some = keys[i:i + 100_000]
                    yield pa.RecordBatch.from_pydict({"block": np.full(len(some), block), "pair": some, "n": counts[i:i + 100_000]})

    whole = blocks.where("n_a is null").select("block", "pairs", "counts")
    return whole.mapInArrow(run, "block long, pair long, n long")


def pair_counts(pairs: DataFrame, factor: int) -> DataFrame:
    """(pair, n, best) from (pair, n): its number of links, and whether that is the highest of its id on side b."""
    total = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    total = written(total.withColumn("b", F.col("pair") % factor), "pair-counts")
    # A row for each id of a vocabulary at most.
    top = F.broadcast(total.groupBy("b").agg(F.max("n").alias("top")))
    return total.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def link_statistics(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Alignment of the tokenizers in files ``a`` (byte-level, after a blank) and ``b`` (sentence pieces) in numbers.

    For every row of ``docs(doc_id, text)``: doc_id, n_a, n_b tokens, n_groups, n_links, groups_sha256, n_best (links
    whose pair of ids is linked most often in the corpus of those with its id of ``b``, ties included) and count_sum
    (over links, how often their pair is linked). Null and empty texts, and texts whose bytes one side doesn't give back,
    have zeros and an empty digest. Repeated rows count each time; null ids come back as they are. No rows: none.
    """
    kind, factor = _pair_type(a, b)
    blocks = written(_blocks(texts_of(docs), a, b), "aligned")
    pairs = _block_pairs(blocks, kind)
    known = pairs.select("block", "pair").join(pair_counts(pairs, factor), "pair").select(F.col("block").alias("of"), "pair", "n", "best")
    own = blocks.where("n_a is not null")

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        keys, total, best = (right.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
        sums, bests = [], []
        for pairs, counts in zip(left.column("pairs"), left.column("counts")):
            at = np.searchsorted(keys, np.frombuffer(pairs.as_buffer(), kind).astype(np.int64))
            n = np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64)
            sums.append(int((total[at] * n).sum()))
            bests.append(int(n[best[at]].sum()))
        return left.drop_columns(["block", "pairs", "counts"]).append_column("n_best", pa.array(bests, pa.int64())).append_column(
            "count_sum", pa.array(sums, pa.int64()))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return own.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(merge, schema)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The alignment itself, a row for every row of ``docs(doc_id, text)``.

    doc_id; for both sides the ids, the byte offset where each token ends, and the group it is in, both from the
    start of the document; links as numbers of an a and a b token, ordered. Cases as in ``link_statistics``.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for x, y in chunks([len(t) for t in texts], _CHUNK):
                out = Aligned(texts[x:y], a, b)
                row = {"doc_id": ids.slice(x, y - x)}
                firsts = []
                for side in (0, 1):
                    stops = np.cumsum(out.counts[side])
                    firsts.append(first := stops - out.counts[side])
                    cuts = list(zip(first.tolist(), stops.tolist()))
                    row[f"{'ab'[side]}_ids"] = [out.id[side][i:j] for i, j in cuts]
                    row[f"{'ab'[side]}_ends"] = [out.end[side][i:j] - out.start[side][i] if i < j else [] for i, j in cuts]
                    row[f"{'ab'[side]}_groups"] = [out.group[side][i:j] - out.group[side][i] if i < j else [] for i, j in cuts]
                i, j = out.link
                doc = out.doc[0][i]
                at = np.searchsorted(doc, np.arange(y - x + 1)).tolist()
                links = np.stack([i - firsts[0][doc], j - firsts[1][doc]], 1)
                row["links"] = [[{"a": int(p), "b": int(q)} for p, q in links[s:t]] for s, t in zip(at, at[1:])]
                yield pa.RecordBatch.from_pydict(row, schema)

    lists = [(f"{s}_{c}", pa.list_(pa.int64())) for s in "ab" for c in ("ids", "ends", "groups")]
    schema = pa.schema([("doc_id", pa.int64()), *lists, ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
    spark_schema = ("doc_id long, a_ids array<long>, a_ends array<long>, a_groups array<long>, b_ids array<long>, b_ends array<long>, "
                    "b_groups array<long>, links array<struct<a: long, b: long>>")
    return texts_of(docs).mapInArrow(run, spark_schema)
