"""Keyword matching against a table of keywords, of which there may be very many.

An alternation in a regular expression tries its keywords one after the other at every position. Here the
keywords share a trie over classes of equal characters, and all positions of many texts walk it together: a
state is (start, position, node), and every step looks at the next character and at the two behind it. The work
grows with the states that are alive, not with the number of keywords.

Results are those of the alternation in the order of the table: leftmost start first, of the keywords that start there
the first in order, and gaps as short as possible from left to right.
"""

from __future__ import annotations

import pickle
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.functions import keywords as K

#: Nodes of a trie at most, sixteen to twenty bytes each in a task and half of that on the way there.
PART_ENTRIES = 1 << 23
#: Characters of keywords for each of these, of which one task builds a trie.
_PART_CHARS = 3
#: Characters that are matched together.
_CHUNK = 1 << 18
#: Characters that are held while one trie after the other goes over them.
_HELD = 1 << 22
#: Places between those where walks along a chunk begin.
_STRIDE = 32
_NO_WORD = np.iinfo(np.int32).max
_STRIPPED = frozenset(K.WHITESPACE)


class Trie:
    """Keywords as nodes whose children by character class are numbered one after the other; node 0 is the root.

    A node holds a bit for each class of its children (of many classes, for their last six bits), and the number of its
    first child. Orders are kept as places among all orders of the trie.
    """

    def __init__(self, keywords: list[str], orders: list[int]):
        self.class_of: dict[int, int] = {}
        classes: dict[tuple, int] = {}
        for c in sorted({c for k in keywords for c in k}):
            same = K.case_variants(c)
            number = classes.setdefault(same, len(classes) + 1)
            for v in same:
                if self.class_of.setdefault(ord(v), number) != number:
                    raise ValueError(f"{v!r} equals characters that differ from each other")
        self.width = len(classes) + 1
        self.orders, place = np.unique(np.array(orders, np.int64), return_inverse=True)
        sizes = np.array([len(k) for k in keywords], np.int64)
        begins = np.cumsum(sizes) - sizes
        number = self._codes[np.frombuffer("".join(keywords).encode("utf-32-le"), "<u4")]
        self.__dict__.pop("_codes")
        at, count, keys = np.zeros(len(sizes), np.int64), 1, []
        for depth in range(int(sizes.max(initial=0))):  # the nodes of a depth in the order of their parents and classes
            longer = np.flatnonzero(sizes > depth)
            key, child = np.unique(at[longer] * self.width + number[begins[longer] + depth], return_inverse=True)
            at[longer] = count + child
            keys.append(key)
            count += len(key)
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        self.words = np.full(count, _NO_WORD, np.int32)
        np.minimum.at(self.words, at[sizes > 0], place[sizes > 0].astype(np.int32))
        self.bits = np.zeros(count, np.uint32 if self.width <= 32 else np.uint64)
        one = self.bits.dtype.type(1)
        np.bitwise_or.at(self.bits, key // self.width, one << (key % self.width & 63).astype(self.bits.dtype))
        self.key = key if self.width > 64 else None
        self._complete()

    def _complete(self) -> None:
        """What follows from the other arrays: first children, and the first in order among a node and all below it."""
        count = len(self.words)
        children = np.bitwise_count(self.bits).astype(np.int32) if self.key is None else np.bincount(self.key // self.width, minlength=count).astype(np.int32)
        self.first = np.cumsum(children, dtype=np.int32) - children + np.int32(1)
        self.least = self.words.copy()
        ends = [0, 1]  # of the depths: the children of the first node behind a depth begin where the next depth ends
        while ends[-1] < count:
            ends.append(int(self.first[ends[-1]]))
        for low, mid, high in zip(ends[-3::-1], ends[-2::-1], ends[::-1]):
            own = low + np.flatnonzero(children[low:mid])
            self.least[own] = np.minimum(self.least[own], np.minimum.reduceat(self.least[mid:high], self.first[own] - mid))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("first", "least", "_codes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._complete()

    @cached_property
    def _codes(self) -> np.ndarray:
        """Class of every code point; made where it is used and not sent along."""
        table = np.zeros(0x110000, np.uint16)
        for c, number in self.class_of.items():
            table[c] = number
        return table

    def _children(self, node: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes have a child of the class, and the children."""
        own = self.bits[node]
        bit, one = (number & 63).astype(own.dtype), own.dtype.type(1)
        some = np.flatnonzero(((own >> bit) & one).astype(bool) & (number > 0))
        if self.key is None:
            before = own[some] & ((one << bit[some]) - one)
            return some, self.first[node[some]] + np.bitwise_count(before).astype(np.int32)
        wanted = node[some].astype(np.int64) * self.width + number[some]
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        there = self.key[at] == wanted
        return some[there], (at[there] + 1).astype(np.int32)

    def _prepared(self, points: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class and room of each character, and where a keyword may start.

        ``closed`` marks characters that no match may hold, such as line ends. Room is how many of the three characters
        after each are open and follow without a break.
        """
        number = self._codes[points].astype(np.int32)
        number[closed] = 0
        n = len(points)
        open_ = np.append(~closed, [False] * 3).astype(np.int8)
        room = open_[1:n + 1] * (1 + open_[2:n + 2] * (1 + open_[3:n + 3]))
        begins = np.flatnonzero(number)
        return number, room, begins[self._children(np.zeros(len(begins), np.int32), number[begins])[0]]

    def _walk(self, number: np.ndarray, room: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first keyword in order that starts at each of ``begin``, _NO_WORD without any, and its end.

        A path goes on only while what lies below it may come before what its start has found.
        """
        best, end = np.full(len(begin), _NO_WORD, np.int32), np.full(len(begin), -1, np.int64)
        own, node = self._children(np.zeros(len(begin), np.int32), number[begin])
        at, rank = begin[own].astype(np.int64), np.zeros(len(own), np.int64)
        most, depth = max(4 * len(begin), 1 << 14), 0
        while len(own):
            word = self.words[node]
            hit = np.flatnonzero(word < best[own])
            if len(hit):  # of each start the first word, of its paths the one with the shorter gaps
                hit = hit[np.lexsort((rank[hit], word[hit], own[hit]))]
                hit = hit[np.append(True, own[hit][1:] != own[hit][:-1])]
                best[own[hit]], end[own[hit]] = word[hit], at[hit] + 1
            steps = []
            for gap in range(K.MAX_GAP + 1):
                some = np.flatnonzero(room[at] > gap)
                to = at[some] + 1 + gap
                live, child = self._children(node[some], number[to])
                better = np.flatnonzero(self.least[child] < best[own[some[live]]])
                live, child = live[better], child[better]
                some = some[live]
                steps.append((own[some], to[live], child, rank[some] * (K.MAX_GAP + 1) + gap))
            own, at, node, rank = (np.concatenate(x) for x in zip(*steps))
            depth += 1
            if depth % 20 == 0:  # ranks only have to keep their order
                rank = np.unique(rank, return_inverse=True)[1]
            if len(own) > most:  # paths that meet again go on as the one with the shorter gaps
                order = np.lexsort((rank, node, at, own))
                own, at, node, rank = own[order], at[order], node[order], rank[order]
                new = np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1]) | (node[1:] != node[:-1]))
                own, at, node, rank = own[new], at[new], node[new], rank[new]
        return best, end

    def candidates(self, points: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, order, end) of the first keyword in order for each start that has any, ascending."""
        number, room, begins = self._prepared(points, closed)
        word, end = self._walk(number, room, begins)
        hit = word != _NO_WORD
        return begins[hit], self.orders[word[hit]], end[hit]

    def matches(self, points: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, order, end) of the matches, none inside another, left to right.

        Starts inside a match are not looked at. Walks along the text begin every few places at once; one that
        comes to a place where another has been goes on as that one did, so the walk from the first place finds all its
        steps known.
        """
        number, room, begins = self._prepared(points, closed)
        n = len(begins)
        word, end, known = np.full(n, _NO_WORD, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
        following = np.arange(1, n + 1)
        now = np.arange(0, n, _STRIDE)
        while len(now):
            word[now], end[now] = self._walk(number, room, begins[now])
            known[now] = True
            hit = now[word[now] != _NO_WORD]
            following[hit] = np.searchsorted(begins, end[hit])
            now = np.unique(following[now])
            now = now[now < n]
            now = now[~known[now]]
        taken, place, onward, hits = [], 0, following.tolist(), (word != _NO_WORD).tolist()
        while place < n:
            if hits[place]:
                taken.append(place)
            place = onward[place]
        taken = np.array(taken, np.int64)
        return begins[taken], self.orders[word[taken]], end[taken]


def leftmost(start: list[int], end: list[int]) -> list[int]:
    """Which of the candidates, in ascending start, are taken: each starts where the one before has ended or later."""
    taken, free = [], -1
    for i, (a, b) in enumerate(zip(start, end)):
        if a >= free:
            taken.append(i)
            free = b
    return taken


def keyword_table(df: DataFrame, keyword: str = "keyword", order: str = "ord") -> DataFrame:
    """(keyword, ord): distinct non-empty keywords, each at its first place."""
    rows = df.select(F.col(keyword).alias("keyword"), F.col(order).cast("long").alias("ord"))
    return rows.where("keyword <> ''").groupBy("keyword").agg(F.min("ord").alias("ord"))


def _size(table: DataFrame) -> tuple[int, int]:
    """Characters of the keywords, and how many different beginnings they have (some more, where tasks share one)."""

    def run(batches):
        chars, nodes, last = 0, 0, ""
        for batch in batches:
            for keyword in batch.column(0).to_pylist():
                chars += len(keyword)
                nodes += len(keyword) - next((i for i, (a, b) in enumerate(zip(keyword, last)) if a != b), min(len(keyword), len(last)))
                last = keyword
        yield pa.RecordBatch.from_arrays([pa.array([chars]), pa.array([nodes])], ["chars", "nodes"])

    sizes = table.select("keyword").repartitionByRange("keyword").sortWithinPartitions("keyword").mapInArrow(run, "chars long, nodes long")
    return tuple(n or 0 for n in sizes.agg(F.sum("chars"), F.sum("nodes")).first())


def _tries(table: DataFrame) -> list:
    """Broadcast tries; each is built by one task, from keywords of a bounded number of characters."""
    chars, nodes = _size(table)
    if not chars:
        return []
    parts = max(-(-(nodes + 1) // PART_ENTRIES), -(-chars // (_PART_CHARS * PART_ENTRIES)))
    # Neighbours in the alphabet share their beginnings, so they share a trie.
    dealt = (table.repartitionByRange(parts, "keyword") if parts > 1 else table.coalesce(1)).withColumn("_part", F.spark_partition_id())

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("keyword")
        return pd.DataFrame({"trie": [pickle.dumps(Trie(pdf["keyword"].tolist(), pdf["ord"].tolist()))]})

    built = dealt.groupBy("_part").applyInPandas(build, "trie binary")
    context = table.sparkSession.sparkContext
    tries = []
    for r in built.toLocalIterator():
        tries.append(context.broadcast(pickle.loads(bytes(r["trie"]))))
        _let_go(tries[-1])
    return tries


def _let_go(trie) -> None:
    """Forget a broadcast trie here; it is read from its file again where it is next asked for."""
    if getattr(trie, "_path", None) is not None:
        vars(trie).pop("_value", None)


def _lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, a line feed after each; which no match may hold; and where lines start.

    Closed are line feeds and the white space at both ends of a line, as matches are looked for in trimmed lines.
    """
    points = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), "<u4")
    feed = points == 10
    space = np.isin(points, np.array(sorted(map(ord, _STRIPPED)), "<u4"))
    ends = np.flatnonzero(feed)
    starts = np.append(0, ends[:-1] + 1) if len(ends) else np.zeros(0, np.int64)
    solid = np.flatnonzero(~space)
    line = np.cumsum(feed) - feed  # the line that each character is in
    closed = space.copy()
    if len(solid):
        first = np.searchsorted(solid, starts)
        last = np.searchsorted(solid, ends) - 1
        low = solid[np.minimum(first, len(solid) - 1)]
        high = solid[np.maximum(last, 0)]
        index = np.arange(len(points))
        closed &= (index < low[line]) | (index > high[line]) | feed
    return points, closed, starts


def _chunked(batch, texts: pa.Array):
    """(rows, texts) of a batch, about _CHUNK characters at a time; a null text as empty."""
    size, some, held = 0, [], []
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if some and size + len(t) > _CHUNK:
            yield some, held
            size, some, held = 0, [], []
        some.append(i)
        held.append(t)
        size += len(t)
    if some:
        yield some, held


def _united(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, order, end) of the matches, left to right, from the candidates of several tries."""
    start, word, end = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((word, start))
    order = order[np.append(True, start[order][1:] != start[order][:-1])[:len(order)]]  # of each start the first in order
    taken = order[leftmost(start[order].tolist(), end[order].tolist())]
    return start[taken], word[taken], end[taken]


def _matched(batches, column: int, tries: list):
    """(batch, rows, texts, starts of lines, start, order, end) of the chunks of the batches, the last three of their matches.

    One trie goes over chunk by chunk. Of several a task has one in memory at a time: each goes over all chunks that are
    held, and what they find at a place meets there, so nothing but matches leaves the task.
    """
    if len(tries) == 1:
        for batch in batches:
            for rows, texts in _chunked(batch, batch.column(column)):
                points, closed, starts = _lines(texts)
                yield (batch, rows, texts, starts, *tries[0].value.matches(points, closed))
        return

    def through(held):
        found = [[] for _ in held]
        for trie in tries:
            for each, (*_, points, closed) in zip(found, held):
                each.append(trie.value.candidates(points, closed))
            _let_go(trie)
        for each, (batch, rows, texts, starts, _, _) in zip(found, held):
            yield (batch, rows, texts, starts, *_united(each))

    held, size = [], 0
    for batch in batches:
        for rows, texts in _chunked(batch, batch.column(column)):
            points, closed, starts = _lines(texts)
            held.append((batch, rows, texts, starts, points, closed))
            size += len(points)
            if size >= _HELD:
                yield from through(held)
                held, size = [], 0
    if held:
        yield from through(held)


_MATCHES = "array<struct<ord:bigint,surface:string>>"
_MATCH_TYPE = pa.list_(pa.struct([("ord", pa.int64()), ("surface", pa.string())]))


def _by_line(batch, others, rows, texts, starts, start, word, stop):
    """A row for each line that holds one of the matches: the other columns, line_no, the trimmed line, and its matches."""
    own = np.searchsorted(starts, start, "right") - 1  # line among all lines
    firsts = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    lines = own[cuts]
    of = np.searchsorted(firsts, lines, "right") - 1
    whole, shown, bases = {}, [], []
    for line, k in zip(lines.tolist(), of.tolist()):
        if k not in whole:
            whole = {k: texts[k].split("\n")}
        raw = whole[k][line - int(firsts[k])]
        shown.append(raw.strip(K.WHITESPACE))
        bases.append(int(starts[line]) + len(raw) - len(raw.lstrip(K.WHITESPACE)))
    sizes = np.diff(np.append(cuts, len(own)))
    base = np.repeat(np.array(bases, np.int64), sizes)
    line_of = np.repeat(np.arange(len(cuts)), sizes).tolist()
    surfaces = [shown[i][a:b] for i, a, b in zip(line_of, (start - base).tolist(), (stop - base).tolist())]
    fields = [pa.array(word, pa.int64()), pa.array(surfaces, pa.string())]
    found = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(own)), pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_MATCH_TYPE.value_type)))
    taken = batch.select(others).take(pa.array([rows[k] for k in of.tolist()]))
    return [*taken.columns, pa.array(lines - firsts[of] + 1, pa.int32()), pa.array(shown, pa.string()), found]


def _counted(df: DataFrame, tries: list, id_col: str, text: str) -> DataFrame:
    """(id, ord, n): how often a keyword matches in a row, without its lines."""

    def run(batches):
        for batch, rows, texts, _, start, word, _ in _matched(batches, 1, tries):
            if not len(start):
                continue
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
            of = np.searchsorted(begins, start, "right") - 1
            words, number = np.unique(word, return_inverse=True)
            pairs, n = np.unique(of * len(words) + number, return_counts=True)
            ids = batch.column(0).take(pa.array(np.array(rows)[pairs // len(words)]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words[pairs % len(words)]), pa.array(n.astype(np.int64))], [id_col, "ord", "n"])

    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, ord long, n long")


def matching_lines(df: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """Lines with a match, as ``line_no``, ``line`` and the array ``matches`` of (ord, surface), left to right.

    ``table`` comes from ``keyword_table``. One pass over the texts, without a shuffle: a trie is within PART_ENTRIES, and of
    more keywords one trie after the other goes over the texts that a task holds.
    """
    others, kinds, tries = [c for c in df.columns if c != text], dict(df.dtypes), _tries(table)
    if not tries:
        return df.where(F.lit(False)).drop(text).withColumns({"line_no": F.lit(0), "line": F.lit(""), "matches": F.lit(None).cast(_MATCHES)})

    def run(batches):
        for batch, rows, texts, starts, start, word, stop in _matched(batches, len(others), tries):
            if len(start):
                yield pa.RecordBatch.from_arrays(_by_line(batch, others, rows, texts, starts, start, word, stop), [*others, "line_no", "line", "matches"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "line_no int", "line string", f"matches {_MATCHES}"])
    return df.select(*others, text).mapInArrow(run, schema)


def line_findings(df: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """``line_no``, ``content`` and the joined distinct surface texts of every matching line, as ``keyword_scan`` has them."""
    found = matching_lines(df, table, text)
    surfaces = F.col("matches")["surface"]
    keep = [c for c in found.columns if c not in ("line_no", "line", "matches")]
    return found.select(*keep, "line_no", K.context(F.col("line"), F.get(surfaces, F.lit(0))).alias("content"),
                        K.joined_forms(surfaces).alias("keyword"))


def keyword_counts(df: DataFrame, id_col: str, table: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences and distinct documents of every keyword of the table, zero for those that aren't found."""
    tries, rows = _tries(table), df.select(id_col, text)
    each = _counted(rows, tries, id_col, text) if tries else rows.where(F.lit(False)).select(id_col, F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("n"))
    per_doc = each.groupBy("ord", id_col).agg(F.sum("n").alias("n"))
    counts = per_doc.groupBy("ord").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))
    zero = F.lit(0).cast("long")
    return table.join(counts, "ord", "left").select(
        "keyword", F.coalesce("occurrences", zero).alias("occurrences"), F.coalesce("documents", zero).alias("documents"))
