"""Byte-level BPE by a rank file: encoding of whole texts, and decoding of the ids.

Texts are cut without a regular expression. Every code point has a class; a small automaton reads the
classes and says where a piece starts. Its transitions are functions on eight states, and composing
functions is associative: blocks of a text are composed side by side, a scan over the blocks gives each
its first state, and a second walk marks the starts. A piece's ids are found by pair merging once and
then looked up.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lineward.llm.common import codepoints, map_texts, texts_of

#: Pieces whose ids a worker keeps; the store is emptied when it is full.
CACHED_PIECES = 400_000
_LONGEST_CACHED = 64
#: Characters of text that a round trip holds at once.
_CHUNK = 1 << 18
#: Pieces up to these many bytes are merged side by side, so many at once; longer ones with a heap.
_WIDTHS, _ROWS = (4, 8, 12, 16, 24, 32), 20_000
_NONE, _FREE, _FACTOR = np.uint32(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)

# The white space of Unicode.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# What the automaton reads: letter, number, other, apostrophe that may open a suffix of one or two
# letters, white space before more white space or the end, blank or other white space before text.
_L, _N, _O, _A1, _A2, _W, _BLANK, _LAST = range(8)
# Its states: inside letters, numbers, others, white space; after a blank that goes with what follows;
# after a closed piece; before the last or the last but one letter of a suffix.
_IN_L, _IN_N, _IN_O, _IN_W, _JOIN, _CLOSED, _ONE, _TWO = range(8)
_BLOCK = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece starts, by 8 * symbol + state; symbols from 8 on are the first of a text."""
    step, starts = np.zeros(128, np.uint8), np.zeros(128, bool)
    for symbol in range(16):
        for state in range(8):
            kind, now = symbol % 8, state if symbol < 8 else _CLOSED
            if now in (_ONE, _TWO):
                to, new = (_CLOSED if now == _ONE else _ONE), False
            elif kind in (_L, _N):
                to = kind
                new = now not in (kind, _JOIN)
            elif kind in (_O, _A1, _A2):
                new = now not in (_IN_O, _JOIN)
                to = _IN_O if kind == _O or not new else _ONE if kind == _A1 else _TWO
            elif kind == _W:
                to, new = _IN_W, now != _IN_W
            else:
                to, new = (_JOIN if kind == _BLANK else _CLOSED), True
            step[8 * symbol + state], starts[8 * symbol + state] = to, new
    return step, starts


_STEP, _STARTS = _automaton()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, _O, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = _L if kind == "L" else _N
    table[_SPACES] = _W
    return table


def _symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    symbols = _classes()[cp]
    space = symbols == _W
    ends = np.zeros(len(cp), bool)  # the last of a text
    ends[np.append(first[1:], len(cp)) - 1] = True
    before_text = np.zeros(len(cp), bool)
    before_text[:-1] = space[:-1] & ~space[1:] & ~ends[:-1]
    symbols[before_text] = np.where(cp[before_text] == 0x20, _BLANK, _LAST)
    at = np.flatnonzero(cp == 0x27)
    if len(at):
        own = np.searchsorted(first, at, "right")
        stop = np.append(first, len(cp))[own]  # where the text ends
        one = np.where(at + 1 < stop, cp[np.minimum(at + 1, len(cp) - 1)], 0)
        two = np.where(at + 2 < stop, cp[np.minimum(at + 2, len(cp) - 1)], 0)
        symbols[at[np.isin(one, [ord(c) for c in "stmd"])]] = _A1
        symbols[at[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]] = _A2
    symbols[first] += 8
    return symbols


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces start in the code points of texts that follow each other; ``first``: where texts start."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    lanes = -(-n // _BLOCK)
    symbols = np.full(lanes * _BLOCK, _O, np.uint8)
    symbols[:n] = _symbols(cp, first)
    by_step = np.ascontiguousarray(symbols.reshape(lanes, _BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
    for row in by_step:
        whole = _STEP[(row << 3)[:, None] + whole]
    reach = 1
    while reach < lanes:  # each lane's function after those of all lanes before it
        joined = whole.copy()
        joined[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), 1)
        whole, reach = joined, 2 * reach
    state = np.append(np.uint8(_CLOSED), whole[:-1, _CLOSED]).astype(np.uint8)
    marks = np.empty((_BLOCK, lanes), bool)
    for i, row in enumerate(by_step):
        at = (row << 3) + state
        marks[i], state = _STARTS[at], _STEP[at]
    return np.flatnonzero(np.ascontiguousarray(marks.T).reshape(-1)[:n])


class Vocabulary(dict):
    """Ids of pieces, as bytes of unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        names = [b""] * size
        for name, rank in self.ranks.items():
            names[rank] = name
        self.flat = np.frombuffer(b"".join(names), np.uint8)
        self.sizes = np.array([len(x) for x in names])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.uint32)
        self._table()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many pieces at once, those of like length side by side."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        low = 0
        for most in _WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= most))
            for a in range(0, len(some), _ROWS):
                for i, ids in zip(some[a:a + _ROWS].tolist(), self._merge_rows([pieces[i] for i in some[a:a + _ROWS]], most)):
                    out[i] = ids
            low = most
        for i in np.flatnonzero(sizes > low).tolist():
            out[i] = np.array(self._merge_long(pieces[i]), "<u4").tobytes()
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that two ids merge to, or _NONE."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b
        at = (key * _FACTOR) >> self.shift
        found = np.where(self.keys[at] == key, self.values[at], _NONE)
        for probe in range(1, self.probes):
            where = np.flatnonzero((found == _NONE) & (self.keys[at] != _FREE))
            if not len(where):
                break
            slot = (at[where] + np.uint64(probe)) & np.uint64(len(self.keys) - 1)
            found[where] = np.where(self.keys[slot] == key[where], self.values[slot], _NONE)
        return found

    def _table(self) -> None:
        """Hash table of the pairs whose concatenation is an id; a pair counts for every way to cut an id."""
        keys, values = [], []
        for name, rank in self.ranks.items():
            for i in range(1, len(name)):
                a, b = self.ranks.get(name[:i]), self.ranks.get(name[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        bits = max(4, (len(keys) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, _FREE), np.full(1 << bits, _NONE, np.uint32)
        self.probes = 1
        keys = np.array(keys, np.uint64)
        for key, at, value in zip(keys.tolist(), ((keys * _FACTOR) >> self.shift).tolist(), values):
            probe = 0
            while self.keys[(at + probe) % (1 << bits)] != _FREE:
                probe += 1
            self.keys[(at + probe) % (1 << bits)], self.values[(at + probe) % (1 << bits)] = key, value
            self.probes = max(self.probes, probe + 1)

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pair merging of pieces of at most ``width`` bytes, a column each."""
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width).T
        depth = np.arange(width + 1)[:, None]
        ids = np.full((width + 1, n), _NONE, np.uint32)
        ids[:width] = np.where(depth[:width] < sizes, self.bytes[raw], _NONE)
        after = np.minimum(depth + 1, sizes).astype(np.int64)  # row ``sizes`` stands for the end
        before = np.broadcast_to(depth - 1, ids.shape).copy()
        merged = np.full((width + 1, n), _NONE, np.uint32)
        for i in range(width - 1):
            col = np.flatnonzero(sizes > i + 1)
            if len(col):
                merged[i, col] = self._pair(ids[i, col], ids[i + 1, col])
        col = np.arange(n)
        while True:
            at = merged[:, col].argmin(0)
            best = merged[at, col]
            going = best != _NONE
            if not going.any():
                break
            col, at, best = col[going], at[going], best[going]
            gone = after[at, col]
            ids[at, col], ids[gone, col], merged[gone, col] = best, _NONE, _NONE
            follow = after[gone, col]
            after[at, col] = follow
            before[follow, col] = at
            last = follow >= sizes[col]
            merged[at, col] = np.where(last, _NONE, self._pair(best, ids[np.where(last, 0, follow), col]))
            ahead = before[at, col]
            some = np.flatnonzero(ahead >= 0)
            merged[ahead[some], col[some]] = self._pair(ids[ahead[some], col[some]], best[some])
        kept = ids[:width].T != _NONE
        flat = ids[:width].T[kept].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(kept.sum(1))]) * 4
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same with a heap, for long pieces."""
        n, rank = len(raw), self.ranks.get
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := rank(raw[i:end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[i], end[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or after[i] >= n or end[after[i]] != stop:
                continue  # one of the two has been merged meanwhile
            gone = after[i]
            end[i], after[i], end[gone] = stop, after[gone], -1
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > CACHED_PIECES:
            self.clear()
        whole = "".join(texts)
        sizes = np.array([len(t) for t in texts])
        first = np.concatenate([[0], np.cumsum(sizes)])
        starts = piece_starts(codepoints(whole), np.unique(first[:-1][sizes > 0]))
        bounds = np.append(starts, len(whole)).tolist()
        pieces = list(map(whole.__getitem__, map(slice, bounds, bounds[1:])))
        new = list(set(pieces).difference(self))
        self.update(zip(new, self.merge([p.encode("utf-8") for p in new])))
        ids = list(map(self.__getitem__, pieces))
        for piece in new:
            if len(piece) > _LONGEST_CACHED:
                del self[piece]
        cuts = np.searchsorted(starts, first).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(cuts, cuts[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where the bytes of each id start in the text, and where the last end."""
        return np.concatenate([[0], np.cumsum(self.sizes[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        sizes = np.diff(offsets)
        return self.flat[np.repeat(self.at[ids] - offsets[:-1], sizes) + np.arange(offsets[-1])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids and the byte offset of each id, for every row of ``docs(doc_id, text)``.

    A null or empty text has no ids. Repeated rows and null document ids come back as they are.
    """

    def run(keys, texts):
        words = vocabulary(ranks)
        ids = [np.frombuffer(x, "<u4") for x in words.encode(texts)]
        return {"doc_id": keys, "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                "offsets": pa.array([words.offsets(x)[:-1] for x in ids], pa.list_(pa.int64()))}

    return map_texts(texts_of(docs), run, "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the bytes of the text, from ids and offsets."""

    def run(batches):
        words = vocabulary(ranks)
        for batch in batches:
            ids = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            out = [words.decode(x, words.offsets(x)) for x in ids]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "content": pa.array(out, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them."""

    def run(keys, texts):
        words = vocabulary(ranks)
        raw = words.encode(texts)
        back = []
        for x in raw:
            ids = np.frombuffer(x, "<u4")
            back.append(words.decode(ids, words.offsets(ids)))
        return {"doc_id": keys, "n_tokens": [len(x) // 4 for x in raw],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}

    return map_texts(texts_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _CHUNK)
