"""Removal of passages that occur earlier in the corpus: every byte of a 100-byte string that also starts earlier.

Comparing all suffixes of all shards would be quadratic in the shards. Two equal strings of 100 bytes hold an
equal anchor at the same place, though: the 32 bytes with the smallest hash of all 32 in it. So

1.  anchors of all documents meet by their hash. One that is nowhere else rules its strings out. Most
    others have the same bytes around them as an earlier one, as far as a string with the anchor reaches: all
    those strings are repeats. What is left are anchors in different surroundings: the edges of passages.
2.  The surroundings of these anchors are the shards. Each gets a suffix array by doubling (Larsson and
    Sadakane: only groups that aren't sorted yet are refined, by the ranks of what follows), and common prefixes
    in text order (Kasai). Neighbours with 100 bytes in common are repeats of the earliest of them.
3.  Surroundings of one anchor that are too many for a shard are dealt out to several. Each shard hands on the
    first of its equal strings, sorted by content; runs of different shards are merged by binary search.

All verdicts are places in documents, joined to the texts at the end.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.llm.common import chunks, mix64, written
from lineward.operators.numbering import number_rows

#: Bytes of a string and of an anchor, and surroundings in one shard.
LENGTH, ANCHOR, SHARD = 100, 32, 16_384
#: Up to so many frequent anchors are sent to all tasks; more are joined by a shuffle, with equal results.
_SENT_KEYS = 100_000
_SIDE = LENGTH - ANCHOR
_CHUNK_BYTES, _SHARD_BYTES = 1 << 21, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, _CHUNK_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)])) for b in (_BASE, _INVERSE)]
    return _powers


def anchors(raw: list[bytes]):
    """(document, place, hash of the anchor, hash of its surroundings) of all anchors of all strings."""
    sizes = np.array([len(r) for r in raw])
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(raw), np.uint8)
    if len(b) < LENGTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    up, down = _power(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * up[:len(b)])])
    gram = mix64((total[ANCHOR:] - total[:-ANCHOR]) * down[:len(b) - ANCHOR + 1])
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, reach = LENGTH - ANCHOR + 1, 1
    while reach * 2 <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    if width > reach:
        low = np.minimum(low[:reach - width], low[width - reach:])
    inside = np.ones(len(low), bool)  # strings that don't leave their document
    for end in ends[:-1].tolist():
        inside[max(0, end - LENGTH + 1):end] = False
    low = low[inside]
    at = (low[np.append(True, low[1:] != low[:-1])] & np.uint64(0xFFFFFFFF)).astype(np.int64) if len(low) else np.zeros(0, np.int64)
    doc = np.searchsorted(ends, at, "right")
    start = ends[doc] - sizes[doc]
    lo, hi = np.maximum(start, at - _SIDE), np.minimum(ends[doc], at + LENGTH)
    around = mix64((total[hi] - total[lo]) * down[lo] + (at - lo).astype(np.uint64) * _BASE + (hi - lo).astype(np.uint64))
    return doc, at - start, gram[at], around


def _firsts(key, around, order_a, order_b):
    """Order of rows by key, surroundings and place, and in it where keys and surroundings begin."""
    order = np.lexsort((order_b, order_a, around, key))
    key, around = key[order], around[order]
    new_key = np.append(True, key[1:] != key[:-1])
    return order, new_key, new_key | np.append(True, around[1:] != around[:-1])


_ROW = np.dtype([("key", "<u8"), ("around", "<u8"), ("ord", "<i8"), ("at", "<u4"), ("mixed", "u1")])
_DEALT = "target int, ord long, covered binary, edges binary"


def _verdicts(target: int, ords, ats, keys, edge) -> list[pa.RecordBatch]:
    """A row for each document: places covered and places to look at closer with their anchors."""
    if not len(ords):
        return []
    order = np.lexsort((ats, ords))
    ords, ats, keys, edge = ords[order], ats[order].astype("<u4"), keys[order].astype("<u8"), edge[order]
    cut = np.flatnonzero(np.append(True, ords[1:] != ords[:-1])).tolist()
    rows = {"target": [], "ord": [], "covered": [], "edges": []}
    for a, b in zip(cut, [*cut[1:], len(ords)]):
        e = edge[a:b]
        rows["target"].append(target)
        rows["ord"].append(int(ords[a]))
        rows["covered"].append(ats[a:b][~e].tobytes())
        rows["edges"].append(ats[a:b][e].tobytes() + keys[a:b][e].tobytes())
    return [pa.RecordBatch.from_pydict(rows, pa.schema([("target", pa.int32()), ("ord", pa.int64()), ("covered", pa.binary()), ("edges", pa.binary())]))]


def _scan(parts: int):
    """Deals the anchors of a few megabytes of text out by their hash, equal ones once; verdicts that are known stay."""

    def run(batches):
        for batch in batches:
            ids, raw = batch.column("ord").to_numpy(), batch.column("content").to_pylist()
            for a, b in chunks([len(r) for r in raw], _CHUNK_BYTES):
                doc, at, key, around = anchors(raw[a:b])
                if not len(doc):
                    continue
                ords = ids[a:b][doc]
                order, new_key, new = _firsts(key, around, ords, at)
                ords, at, key, around = ords[order], at[order], key[order], around[order]
                group = np.cumsum(new_key) - 1
                mixed = np.bincount(group, weights=new)[group] > 1  # known to have different surroundings
                known = ~new | mixed
                yield from _verdicts(-1, ords[known], at[known], key[known], new[known])
                sent = np.flatnonzero((new & ~mixed) | (new_key & mixed))
                rows = np.zeros(len(sent), _ROW)
                for name, values in (("key", key), ("around", around), ("ord", ords), ("at", at), ("mixed", mixed)):
                    rows[name] = values[sent]
                target = (rows["key"] % np.uint64(parts)).astype(np.int64)
                rows = rows[np.argsort(target, kind="stable")]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(target, minlength=parts))]).tolist()
                # Column by column: what is alike compresses.
                blobs = [b"".join(np.ascontiguousarray(rows[x:y][n]).tobytes() for n in _ROW.names) for x, y in zip(cuts, cuts[1:])]
                own = [i for i, blob in enumerate(blobs) if blob]
                yield pa.RecordBatch.from_pydict(
                    {"target": own, "ord": [None] * len(own), "covered": [blobs[i] for i in own], "edges": [None] * len(own)},
                    pa.schema([("target", pa.int32()), ("ord", pa.int64()), ("covered", pa.binary()), ("edges", pa.binary())]))

    return run


def _unpack(blob: bytes) -> np.ndarray:
    rows = np.zeros(len(blob) // _ROW.itemsize, _ROW)
    at = 0
    for name in _ROW.names:
        size = _ROW[name].itemsize * len(rows)
        rows[name] = np.frombuffer(blob[at:at + size], _ROW[name])
        at += size
    return rows


def _judge(batches):
    """Anchors that met: those alone are dropped, others covered or edges."""
    held = []
    for batch in batches:
        done = batch.filter(pc.equal(batch.column("target"), -1))
        if done.num_rows:
            yield done
        held += [_unpack(x) for x, t in zip(batch.column("covered").to_pylist(), batch.column("target").to_pylist()) if t >= 0]
    if not held:
        return
    rows = np.concatenate(held)
    held.clear()
    order, new_key, new = _firsts(rows["key"], rows["around"], rows["ord"], rows["at"])
    rows = rows[order]
    group = np.cumsum(new_key) - 1
    alone = np.bincount(group)[group] == 1
    mixed = (np.bincount(group, weights=new)[group] > 1) | (np.bincount(group, weights=rows["mixed"])[group] > 0)
    own = ~alone & (~new | mixed)
    rows, new = rows[own], new[own]
    for a in range(0, len(rows), 1 << 20):
        yield from _verdicts(-1, rows["ord"][a:a + (1 << 20)], rows["at"][a:a + (1 << 20)], rows["key"][a:a + (1 << 20)], new[a:a + (1 << 20)])


def _sorted(group: np.ndarray, follow: np.ndarray, n: int) -> np.ndarray:
    """Order by group and then by what follows, a rank from -1 up to n; equal ones stay in order.

    Both and the place are one number if they fit into 64 bits, as numbers sort faster than rows of them.
    """
    bits, places = (n + 1).bit_length(), len(group).bit_length()
    groups = np.cumsum(np.append(False, group[1:] != group[:-1]))  # equal ones stand together, in ascending order
    if len(group) == 0 or int(groups[-1]).bit_length() + bits + places > 64:
        return np.lexsort((follow, group))
    packed = (groups.astype(np.uint64) << np.uint64(bits + places)) | ((follow.astype(np.int64) + 1).astype(np.uint64) << np.uint64(places))
    packed |= np.arange(len(group), dtype=np.uint64)
    packed.sort()
    return (packed & np.uint64((1 << places) - 1)).astype(np.int64)


def suffix_array(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of strings that follow each other in order, equal ones by place.

    Larsson and Sadakane: ranks of the first 8 bytes, then of twice as many each round; a suffix that has a
    rank of its own takes no further part. A suffix ends with its string; ``ends`` are the strings' ends.
    """
    n = len(b)
    small = np.int32 if n < 1 << 30 else np.int64
    left = (np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n)).astype(small)  # bytes to the end of the string
    key = np.zeros(n + 8, np.uint64)
    key[:n] = b
    for width in (1, 2, 4):
        key[:-width] = (key[:-width] << np.uint64(8 * width)) | key[width:]
    size = np.minimum(left, 8)
    key = key[:n] & np.append(np.uint64(0), ~np.uint64(0) << np.arange(56, -8, -8, np.int64).astype(np.uint64))[size]
    # A string's end sorts before any byte, a zero byte included.
    order = (np.lexsort((size, key)) if (b == 0).any() else np.argsort(key, kind="stable")).astype(small)
    key, size = key[order], size[order]
    same = (key[1:] == key[:-1]) & (size[1:] == size[:-1])
    where = np.flatnonzero(np.append(True, ~same))  # first place of each group
    rank = np.empty(n + 1, small)
    rank[order] = np.repeat(where, np.diff(np.append(where, n)))
    rank[n] = -1
    reach = 8
    open_ = np.flatnonzero(np.append(False, same) | np.append(same, False))  # places in groups of two or more
    longest = int(left.max(initial=0))
    while reach < longest and len(open_):
        some = order[open_]
        follow = np.where(left[some] > reach, rank[np.minimum(some + reach, n)], -1)
        group = rank[some]
        sort = _sorted(group, follow, n)
        some, follow, group = some[sort], follow[sort], group[sort]
        order[open_] = some
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        first = np.flatnonzero(new)
        rank[some] = np.repeat(open_[first], np.diff(np.append(first, len(some))))
        alone = new & np.append(new[1:], True)
        open_, reach = open_[~alone], reach * 2
    return order.astype(np.int64)


def common_prefixes(b: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of the suffix array the bytes in common with the place before, counted up to ``most``.

    Kasai: in text order a suffix has at most one byte less in common with its predecessor than the suffix
    before it. All strings are walked side by side.
    """
    n = len(b)
    sizes = np.diff(np.append(0, ends))
    left = np.repeat(ends, sizes) - np.arange(n)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    common = np.zeros(n, np.int16)
    lanes = ends - sizes
    lanes, sizes = lanes[sizes > 0], sizes[sizes > 0]
    by_size = np.argsort(-sizes, kind="stable")
    lanes, sizes = lanes[by_size], sizes[by_size]
    have = np.zeros(len(lanes), np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step, "left"))  # strings with more than ``step`` bytes
        here = lanes[:live] + step
        other = before[here]
        limit = np.where(other < 0, 0, np.minimum(np.minimum(left[here], left[other]), most))
        h = np.minimum(np.maximum(have[:live] - 1, 0), limit)
        go = np.flatnonzero(h < limit)
        while len(go):
            go = go[b[here[go] + h[go]] == b[other[go] + h[go]]]
            h[go] += 1
            go = go[h[go] < limit[go]]
        common[here] = h
        have[:live] = h
    return common[order]


def repeats(snippets: list[bytes], places: np.ndarray, ords: np.ndarray, starts: np.ndarray, salted: np.ndarray):
    """Strings of LENGTH bytes in the snippets: (ord, start, first of its equals, snippet, offset, in a salted one), one each.

    ``places``: where the anchor is in each snippet; ``ords`` and ``starts``: document, and the snippet's place in it;
    ``salted``: whether the snippet's anchor has others elsewhere. Only strings that hold their snippet's anchor
    count. The last result is decided by all snippets that hold an equal string, whichever stands for them.
    """
    sizes = np.array([len(s) for s in snippets])
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(snippets), np.uint8)
    order = suffix_array(b, ends)
    common = common_prefixes(b, ends, order, LENGTH)
    # Offsets from which a string has LENGTH bytes and holds the anchor: from lo up to hi in each snippet.
    lo, hi = np.maximum(0, places + ANCHOR - LENGTH), np.minimum(places, sizes - LENGTH)
    change = np.zeros(len(b) + 1, np.int8)
    some = hi >= lo
    change[(ends - sizes + lo)[some]] += 1
    change[(ends - sizes + hi + 1)[some]] -= 1
    fits = np.cumsum(change[:-1], dtype=np.int8).astype(bool)[order]
    group, order = np.cumsum(common < LENGTH)[fits], order[fits]
    owner = np.repeat(np.arange(len(sizes)), sizes)[order]
    offset = order - (ends - sizes)[owner]
    ord_, start = ords[owner], starts[owner] + offset
    elsewhere = np.bincount(group, salted[owner])[group] > 0 if len(group) else np.zeros(0, bool)
    sort = np.lexsort((start, ord_, group))
    group, owner, offset, ord_, start, elsewhere = (x[sort] for x in (group, owner, offset, ord_, start, elsewhere))
    # A string may be in several snippets of its document: it is one.
    new_group = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    again = ~new_group & np.append(False, (ord_[1:] == ord_[:-1]) & (start[1:] == start[:-1])) if len(group) else new_group
    kept = ~again
    return ord_[kept], start[kept], new_group[kept], owner[kept], offset[kept], elsewhere[kept]


def _starts(ords: np.ndarray, starts: np.ndarray):
    """Rows (ord, places) of strings that are repeats."""
    order = np.lexsort((starts, ords))
    ords, starts = ords[order], starts[order].astype("<u4")
    cut = np.flatnonzero(np.append(True, ords[1:] != ords[:-1])).tolist() if len(ords) else []
    return [int(ords[a]) for a in cut], [starts[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(ords)])]


_HEAD = np.dtype([("w0", "<u8"), ("w1", "<u8"), ("ord", "<i8"), ("at", "<i8")])
_FOUND = "ord long, starts binary, target int, run binary"
_FOUND_SCHEMA = pa.schema([("ord", pa.int64()), ("starts", pa.binary()), ("target", pa.int32()), ("run", pa.binary())])


def _sort_shards(parts: int):
    """Repeats within each shard; of an anchor in several shards also runs with the first of each, by a digest of its bytes."""

    def shard(rows: dict):
        snippets = rows["snippet"]
        ords, starts = np.array(rows["ord"]), np.array(rows["start"])
        ord_, start, first, owner, offset, elsewhere = repeats(snippets, np.array(rows["place"]), ords, starts, np.array(rows["salt"]) >= 0)
        a, b = _starts(ord_[~first], start[~first])
        handed = first & elsewhere
        heads = np.zeros(int(handed.sum()), _HEAD)
        digests = b"".join(hashlib.blake2b(snippets[w][x:x + LENGTH], digest_size=16).digest()
                           for w, x in zip(owner[handed].tolist(), offset[handed].tolist()))
        words = np.frombuffer(digests, "<u8").reshape(-1, 2)
        heads["w0"], heads["w1"], heads["ord"], heads["at"] = words[:, 0], words[:, 1], ord_[handed], start[handed]
        target = (heads["w0"] % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((heads["w1"], heads["w0"], target))
        heads, target = heads[order], target[order]
        runs = np.unique(target)
        cuts = [*np.searchsorted(target, runs).tolist(), len(heads)]
        no = [None] * len(runs)
        return pa.RecordBatch.from_pydict({
            "ord": a + no, "starts": b + no, "target": [None] * len(a) + runs.tolist(),
            "run": [None] * len(a) + [heads[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]}, _FOUND_SCHEMA)

    def run(batches):
        held: dict = {}
        size, last = 0, None
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            keys, salts = (batch.column(name).to_numpy() for name in ("key", "salt"))
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (salts[1:] != salts[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                now = (columns["key"][a], columns["salt"][a]) if b > a else last
                if held and now != last and size >= _SHARD_BYTES:
                    yield shard(held)
                    held, size = {}, 0
                last = now
                for name, values in columns.items():
                    held.setdefault(name, []).extend(values[a:b])
                size += sum(map(len, columns["snippet"][a:b]))
        if held:
            yield shard(held)

    return run


def _words(run: np.ndarray) -> np.ndarray:
    """The digests of a run, which order it."""
    out = np.zeros(len(run), [("w0", "<u8"), ("w1", "<u8")])
    out["w0"], out["w1"] = run["w0"], run["w1"]
    return out


def _merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs as one that holds the first of each string, and the strings that aren't first."""
    known, wanted = _words(x), _words(y)
    place = np.searchsorted(known, wanted)
    hit = place < len(known)
    hit[hit] = known[place[hit]] == wanted[hit]
    old, new = x[place[hit]], y[hit]
    same = (old["ord"] == new["ord"]) & (old["at"] == new["at"])
    earlier = (old["ord"] < new["ord"]) | ((old["ord"] == new["ord"]) & (old["at"] <= new["at"]))
    first = x.copy()
    first[place[hit]] = np.where(earlier, old, new)
    return np.insert(first, place[~hit], y[~hit]), np.concatenate([new[earlier & ~same], old[~earlier]])


def _merge_runs(batches):
    """Sorted runs of different shards: a string that another run has earlier is a repeat.

    Runs are merged by binary search, the two shortest first, so that a string is moved a logarithmic number of times.
    """
    runs = [(len(x), i, np.frombuffer(x, _HEAD)) for i, x in enumerate(x for batch in batches for x in batch.column(0).to_pylist())]
    if not runs:
        return
    heapq.heapify(runs)
    gone, n = [np.zeros(0, _HEAD)], len(runs)
    while len(runs) > 1:
        (_, _, x), (_, _, y) = heapq.heappop(runs), heapq.heappop(runs)
        both, late = _merged(y, x)
        gone.append(late)
        n += 1
        heapq.heappush(runs, (len(both), n, both))
    found = np.concatenate(gone)
    # A string that came third or later may have been put behind several: it is one.
    found = np.unique(found[["ord", "at"]])
    a, b = _starts(found["ord"], found["at"])
    yield pa.RecordBatch.from_pydict({"ord": pa.array(a, pa.int64()), "starts": pa.array(b, pa.binary())})


def _snippets(batches):
    """The surroundings of a document's edges."""
    for batch in batches:
        out = {"key": [], "ord": [], "start": [], "place": [], "snippet": []}
        for ord_, raw, blobs in zip(*(batch.column(c).to_pylist() for c in ("ord", "content", "edges"))):
            seen = set()
            for blob in blobs:
                n = len(blob) // 12
                seen.update(zip(np.frombuffer(blob[:4 * n], "<u4").tolist(), np.frombuffer(blob[4 * n:], "<i8").tolist()))
            for at, key in seen:
                lo = max(0, at - _SIDE)
                out["key"].append(key)
                out["ord"].append(ord_)
                out["start"].append(lo)
                out["place"].append(at - lo)
                out["snippet"].append(raw[lo:at + LENGTH])
        yield pa.RecordBatch.from_pydict(out, pa.schema([("key", pa.int64()), ("ord", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("snippet", pa.binary())]))


def removed(n: int, covered: list[bytes], starts: list[bytes]) -> np.ndarray:
    """Which of a document's n bytes go."""
    change = np.zeros(n + 1, np.int32)
    at = np.frombuffer(b"".join(covered), "<u4").astype(np.int64)
    lo, hi = np.maximum(0, at - _SIDE), np.minimum(n, at + LENGTH)
    more = np.frombuffer(b"".join(starts), "<u4").astype(np.int64)
    np.add.at(change, np.concatenate([lo, more]), 1)
    np.add.at(change, np.concatenate([hi, more + LENGTH]), -1)
    return np.cumsum(change[:-1]) > 0


def _finish(batches):
    for batch in batches:
        n_removed, n_spans, digests = [], [], []
        for raw, covered, starts in zip(*(batch.column(c).to_pylist() for c in ("content", "covered", "starts"))):
            if covered or starts:
                gone = removed(len(raw), covered or [], starts or [])
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                n_removed.append(0)
                n_spans.append(0)
            digests.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": [len(x) for x in batch.column("content").to_pylist()],
            "n_removed": n_removed, "n_spans": n_spans, "kept_sha256": digests})


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, content (bytes, null as empty) and ``ord``, by which documents are earlier or later.

    ord is the doc_id if all are there and different. Else documents are numbered by doc_id, null ids last,
    equal ids by a hash of the text; rows that repeat both are one document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    n, own = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == own:
        return rows.withColumn("ord", F.col("doc_id"))
    rows = rows.withColumn("_key", F.xxhash64("content"))
    numbered = number_rows(rows.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).distinct(),
                           [F.col("_id").asc_nulls_last(), "_k"], "ord")
    return rows.join(numbered, rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))).select("doc_id", "content", "ord")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs(doc_id, text)``.

    A byte goes if a string of 100 bytes with it also starts earlier: in a document of smaller doc_id (null
    ids are last, equal ids go by a hash of the text), or in the same one. Null texts are empty. Rows that
    repeat id and text are one document and have equal results. A text of less than 100 bytes stays as it is.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _ordered(docs)
    dealt = rows.select("ord", "content").mapInArrow(_scan(parts), _DEALT)
    dealt = dealt.withColumn("to", F.when(F.col("target") >= 0, F.col("target")).otherwise(F.pmod(F.xxhash64("ord"), F.lit(parts)).cast("int")))
    judged = dealt.repartitionById(parts, "to").drop("to").mapInArrow(_judge, _DEALT).drop("target")
    judged = written(judged, "anchors")

    edges = judged.where(F.length("edges") > 0).groupBy("ord").agg(F.collect_list("edges").alias("edges"))
    snippets = rows.select("ord", "content").join(edges.hint("shuffle_hash"), "ord").mapInArrow(
        _snippets, "key long, ord long, start long, place long, snippet binary")
    snippets = written(snippets, "snippets")
    many = written(snippets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD), "many")
    if many.count() <= _SENT_KEYS:
        many = F.broadcast(many)  # so that snippets of one anchor don't meet in one task before they are dealt out
    shards = snippets.join(many, "key", "left").withColumn(
        "salt", F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("ord"), F.ceil(F.col("n") / SHARD))).cast("int"))
    shards = shards.select("key", "salt", "ord", "start", "place", "snippet").repartition(parts, "key", "salt").sortWithinPartitions("key", "salt")
    found = written(shards.mapInArrow(_sort_shards(parts), _FOUND), "repeats")
    runs = found.where("run is not null").repartitionById(parts, "target").select("run")
    merged = runs.mapInArrow(_merge_runs, "ord long, starts binary")
    strings = found.where("run is null").select("ord", "starts").union(merged)

    covered = judged.where(F.length("covered") > 0).select("ord", "covered", F.lit(None).cast("binary").alias("starts"))
    verdicts = covered.union(strings.select("ord", F.lit(None).cast("binary").alias("covered"), "starts")).groupBy("ord").agg(
        F.collect_list("covered").alias("covered"), F.collect_list("starts").alias("starts"))
    return rows.join(verdicts.hint("shuffle_hash"), "ord", "left").select("doc_id", "content", "covered", "starts").mapInArrow(
        _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
