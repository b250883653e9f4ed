"""Token ids in flat files: unsigned integers, 64-bit document offsets, read through a memory map.

A folder holds, for every partition p that has documents,

    ids-p.bin      all ids, 2 bytes each if the vocabulary fits, else 4, little-endian
    docs-p.bin     document ids, 8 bytes each
    offsets-p.bin  where each document starts among all ids of the folder, and where the last ends

Partitions follow each other in ascending document id. Their first offsets are prefix sums over the
partitions' totals; ids themselves are written once and never moved.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lineward.llm.common import chunks, in_batches, shared_folder, texts_of

#: Words whose ids a worker keeps; the store is emptied when it is full.
CACHED_WORDS = 600_000
_LONGEST_CACHED = 64
#: Characters of text whose words are held at once.
_CHUNK = 1 << 18
_MARK, _MARK_BYTE, _TOGETHER = "\x01", b"\x01", 2000
#: Marks at which a word may be cut after a letter; the apostrophe opens suffixes.
_PUNCTUATION = "".join(c for c in string.punctuation if c != "'")
_LETTERS_AND_MARKS = re.compile(rb"^([a-zA-Z\x80-\xff]*[a-zA-Z])([" + re.escape(_PUNCTUATION).encode() + rb"]+)$", re.M)
#: Small letters of which any run is one piece, as it stands; none of them combines with another.
_SMALL = string.ascii_lowercase + "".join(c for c in map(chr, range(0xDF, 0x100)) if c != "\xf7")
_SMALL_WORD = re.compile(f"[{_SMALL}]+")
#: Characters by which byte-level vocabularies write bytes.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}
#: Stands for a null document id in docs-p.bin.
NULL_ID = -(1 << 63)


def _byte_level(text: str) -> str:
    return text.encode().decode("latin-1").translate(_BYTE_CHARS)


class WordEncoder:
    """Ids of whole texts, found word by word.

    Only for tokenizers that drop white space before they merge: there the ids of a text are those of
    its words, one after the other, so that a word that occurs again is looked up.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}

        # A mark between words, so that thousands are encoded by one call; its id comes from nothing else.
        (self.mark,) = self._plain(_MARK)
        if any(self._plain(f"a{c}b") != self._plain("a b") for c in "\t\n\r\x0b\x0c"):
            raise ValueError("the tokenizer doesn't drop white space")
        self.lower = all(self._plain(c.upper()) == self._plain(c) for c in string.ascii_lowercase)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = all(self._plain(f"ab{c}") == self._plain("ab") + self._plain(c) for c in _PUNCTUATION)

        # The merges alone, for words that the tokenizer hands them unchanged: it finds no pieces in them by patterns.
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.small = self._takes_small_words()
        # Ids that end a word, as tokens of a vocabulary that has others inside words.
        end, ids = getattr(self.merges.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.last = np.zeros(max(ids.values()) + 1, bool)
        self.last[[i for t, i in ids.items() if end and t.endswith(end)]] = True

    def _takes_small_words(self) -> bool:
        """Whether words of small letters go to the merges as they are: normalised to themselves, one piece, byte by byte."""
        t, all_pairs = self.tokenizer, "".join(a + b for a in _SMALL for b in _SMALL)
        if t.pre_tokenizer is None or any(_SMALL_WORD.fullmatch(s.decode()) for s in self.special):
            return False
        return all(t.normalizer is None or t.normalizer.normalize_str(x) == x for x in (*_SMALL, all_pairs)) and all(
            [p for p, _ in t.pre_tokenizer.pre_tokenize_str(x)] == [_byte_level(x)] for x in (*_SMALL, all_pairs)) and (
            self.merges.encode(_byte_level(_MARK), add_special_tokens=False).ids == [self.mark])

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word; none of them holds the mark or white space that ends a word."""
        if not self.small:
            return self._marked(words, self.tokenizer, _MARK)
        small = [_SMALL_WORD.fullmatch(w) is not None for w in words]
        whole = iter(self._marked([w for w, s in zip(words, small) if not s], self.tokenizer, _MARK))
        merged = iter(self._merged([w if w.isascii() else _byte_level(w) for w, s in zip(words, small) if s]))
        return [next(merged) if s else next(whole) for s in small]

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of words by the merges alone; where a word ends is seen by its last id, if ids tell."""
        out = []
        for at in range(0, len(words), _TOGETHER):
            line = words[at:at + _TOGETHER]
            (e,) = self.merges.encode_batch_fast([" ".join(line)], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.last[ids]) + 1
            out += self._cut(ids, [0, *cuts.tolist()], 0) if len(cuts) == len(line) and cuts[-1] == len(ids) else \
                self._marked(line, self.merges, _byte_level(_MARK))
        return out

    def _marked(self, words: list[str], tokenizer, mark: str) -> list[bytes]:
        out = []
        for at in range(0, len(words), _TOGETHER):
            (e,) = tokenizer.encode_batch_fast([f" {mark} ".join(words[at:at + _TOGETHER])], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            out += self._cut(ids, [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)], 1)
        return out

    def _cut(self, ids: np.ndarray, cuts: list[int], skip: int) -> list[bytes]:
        """The ids between cuts, as they are written; ``skip`` of them stand at each cut and belong to no word."""
        raw, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        return [raw[(a + skip) * size:b * size] for a, b in zip(cuts, cuts[1:])]

    def _folded(self, raw: bytes) -> bytes:
        """A text in lower case where the tokenizer makes no difference; its special tokens are found as they are written."""
        small = raw.lower() if self.lower else raw
        return raw if any(t in small for t in self.special) else small

    def _parts(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Words that are letters and marks behind them, cut where the tokenizer cuts too; many words share either part."""
        return {a + b: (a, b) for a, b in _LETTERS_AND_MARKS.findall(b"\n".join(words))} if self.cut else {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known = self.known
        # ASCII white space only: other white space is left to the tokenizer, and so are other capitals.
        split = [self._folded(t.encode()).split() for t in texts]
        words = set().union(*split)
        # The words at hand in a small table of their own; most texts are put together from it alone.
        here = dict(zip(words, map(known.get, words)))
        new = {w for w, ids in here.items() if ids is None}
        parts = self._parts(new)
        needed = new.difference(parts).union(*parts.values()).difference(known)
        marked = [w for w in needed if _MARK_BYTE in w]
        plain = list(needed.difference(marked))
        known.update(zip(plain, self._ids(b"\n".join(plain).decode().split("\n") if plain else [])))
        known.update((w, np.array(self._plain(w.decode()), self.dtype).tobytes()) for w in marked)
        known.update((w, known[a] + known[b]) for w, (a, b) in parts.items())
        here.update((w, known[w]) for w in new)
        out = [b"".join(map(here.__getitem__, own)) for own in split]
        for word in [w for some in (new, needed.difference(new)) for w in some if len(w) > _LONGEST_CACHED]:
            del known[word]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    store, path = pafs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://"))
    return store, path.rstrip("/")


def _array(store: pafs.FileSystem, path: str, dtype) -> np.ndarray:
    """A file's values: mapped into memory, or read where the store has no files to map."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> list[tuple[int, int, int, int]]:
    """Encode ``docs(doc_id, text)`` into ``folder``, ``end_id`` after each document.

    Returns (partition, documents, ids, ids before it) for each partition with documents; only these
    totals come to the driver. A task writes under a name of its own and moves the complete file, so
    that a task that runs twice leaves the same file. Documents are in ascending id, equal ids by text,
    null ids first; a null text has the end id only. No documents: no files.
    """
    spark = docs.sparkSession
    _place(folder)[0].create_dir(_place(folder)[1])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        encoder = word_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        task = TaskContext.get()
        store, path = _place(folder)
        own = f"{path}/_{task.partitionId()}-{task.taskAttemptId()}"
        n_docs = n_ids = 0
        with store.open_output_stream(f"{own}.ids") as ids, store.open_output_stream(f"{own}.docs") as keys, \
                store.open_output_stream(f"{own}.counts") as counts:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in chunks([len(t) for t in texts], _CHUNK):
                    found = [x + end for x in encoder.encode(texts[a:b])]
                    sizes = np.array([len(x) for x in found], "<i8") // encoder.dtype.itemsize
                    ids.write(b"".join(found))
                    counts.write(sizes.tobytes())
                    n_docs, n_ids = n_docs + len(found), n_ids + int(sizes.sum())
                keys.write(batch.column(0).fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
        for kind in ("ids", "docs", "counts"):
            if n_docs:
                store.move(f"{own}.{kind}", f"{path}/{kind}-{task.partitionId()}.bin")
            else:
                store.delete_file(f"{own}.{kind}")
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "docs": [n_docs], "ids": [n_ids]})

    placed = texts_of(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    totals = sorted(map(tuple, in_batches(placed, encode, "part long, docs long, ids long").collect()))
    bases = [0, *accumulate(t[2] for t in totals)]
    table = [(*t, base) for t, base in zip(totals, bases)]

    def offsets(batches):
        store, path = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                counts = _array(store, f"{path}/counts-{row['part']}.bin", "<i8")
                starts = row["base"] + np.concatenate([[0], np.cumsum(counts)])
                name = f"{path}/_offsets-{TaskContext.get().taskAttemptId()}-{row['part']}"
                with store.open_output_stream(name) as out:
                    out.write(starts.astype("<i8").tobytes())
                store.move(name, f"{path}/offsets-{row['part']}.bin")
            yield batch

    if table:
        _parts(spark, table).mapInArrow(offsets, _PARTS).write.format("noop").mode("overwrite").save()
    return table


_PARTS = "part long, docs long, ids long, base long"


def _parts(spark: SparkSession, table: list[tuple]) -> DataFrame:
    """A row for each partition, one partition each."""
    return spark.createDataFrame(spark.sparkContext.parallelize(table, max(1, len(table))), _PARTS)


def read_tokens(spark: SparkSession, folder: str, table: list[tuple], dtype: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids as 32-bit integers, from the files alone."""

    def read(batches):
        store, path = _place(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                ids = _array(store, f"{path}/ids-{part}.bin", dtype)
                keys = _array(store, f"{path}/docs-{part}.bin", "<i8")
                at = _array(store, f"{path}/offsets-{part}.bin", "<i8")
                for a in range(0, len(keys), 4096):
                    some, lo = slice(a, min(a + 4096, len(keys))), at[a:a + 4097] - at[0]
                    sums = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(lo, lo[1:])]
                    own = np.asarray(keys[some])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own, mask=own == NULL_ID), "start": np.asarray(at[some]),
                        "n_tokens": np.diff(lo), "ids_crc32": sums})

    return _parts(spark, table).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and read them back: one row for every document."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    table = write_tokens(docs, tokenizer, folder, end_id)
    return read_tokens(docs.sparkSession, folder, table, word_encoder(tokenizer).dtype.str)
