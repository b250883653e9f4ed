"""Keyword tables against the alternation of a regular expression."""

import random
import re

import numpy as np
import pytest

from lineward.functions import keywords as K
from lineward.operators import keyword_scan as S
from lineward.operators import keyword_tables as T


def plain(text, keywords):
    """(line_no, line, matches) of the combined pattern."""
    pattern = re.compile(K.combined_pattern(keywords))
    out = []
    for i, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if found := [m.group() for m in pattern.finditer(line)]:
            out.append((i, line, found))
    return out


def by_trie(text, keywords):
    trie = T.Trie(keywords, list(range(len(keywords))))
    points, closed, starts = T._lines([text])
    start, word, end = trie.candidates(points, closed)
    out = {}
    whole = text + "\n"
    for i in T.leftmost(start.tolist(), end.tolist()):
        line = int(np.searchsorted(starts, start[i], "right"))
        out.setdefault(line, []).append(whole[start[i]:end[i]])
    return [(n, text.split("\n")[n - 1].strip(), m) for n, m in sorted(out.items())]


def test_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        letters = rng.choice(["ab", "abc", "aAbBé ", "涉秘密机 x", "a.*[("])
        keywords = [k for k in ("".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))) if k]
        text = "".join(rng.choices(letters + "xyz \n\t\r ", k=rng.randint(0, 120)))
        assert by_trie(text, keywords) == plain(text, keywords), (keywords, text)


def test_edges():
    for keywords, text in [
            (["秘密", "涉密"], "秘涉x密"), (["abc"], "a12b34c a123bc ab\nc"), (["ss"], "ſs ſſ"), (["k"], "K K"), (["İ"], "i I ı"),
            (["a" * 70], "a" * 300), (["ab" * 40], "axb" * 90), (["a b"], "  a b  \na b"), ([" a"], " a\nx a"), (["aa", "a"], "aaa a"),
            (["word"], "")]:
        assert by_trie(text, keywords) == plain(text, keywords), keywords


def test_long_runs_stay_bounded():
    """Every gap fits everywhere: paths that meet again are one."""
    text, keywords = "a" * 3000, ["a" * 25, "a" * 24 + "b"]
    assert by_trie(text, keywords) == plain(text, keywords)


@pytest.mark.parametrize("entries", [1 << 24, 60])
def test_rows(spark, monkeypatch, entries):
    """One trie, and many that meet line by line; repeated rows, null and empty texts, null keywords."""
    monkeypatch.setattr(T, "PART_ENTRIES", entries)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcde", k=rng.randint(3, 7))) for _ in range(60)]
    rows = [(i % 50, "\n".join(" ".join(rng.choices(words, k=6)) for _ in range(5))) for i in range(60)] + [(90, None), (91, ""), (3, "same"), (3, "same")]
    keywords = [w for w in dict.fromkeys(words[:20])] + ["same"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, line string").drop("line")
    table = T.keyword_table(spark.createDataFrame([(k, i) for i, k in enumerate([*keywords, "", None, keywords[0]])], "keyword string, ord int"))
    found = T.line_findings(frame, table)
    expected = S.line_findings(frame, keywords)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect())) and expected.count() > 20
    counts = {r["keyword"]: (r["occurrences"], r["documents"]) for r in T.keyword_counts(frame, "id", table).collect()}
    hits = [(i, m) for i, t in rows if t for _, _, ms in plain(t, keywords) for m in ms]
    assert set(counts) == set(keywords) and sum(n for n, _ in counts.values()) == len(hits) and counts["same"] == (2, 1)


def test_no_keywords(spark):
    frame = spark.createDataFrame([(1, "a")], "id long, text string")
    table = T.keyword_table(spark.createDataFrame([], "keyword string, ord int"))
    assert T.line_findings(frame, table).collect() == []


def test_matches_are_the_taken_candidates():
    """Walks that begin in the middle of a match come together with the walk from the start; more than 64 classes as well."""
    rng = random.Random(5)
    for letters in ("abcdef", "".join(map(chr, range(0x4e00, 0x4e00 + 150)))):
        keywords = list(dict.fromkeys("".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(3000)))
        rng.shuffle(keywords)
        text = "".join(rng.choices(letters + "\n", k=4000))
        trie = T.Trie(keywords, [7 * i for i in range(len(keywords))])
        points, closed, _ = T._lines([text])
        start, word, end = (x.tolist() for x in trie.candidates(points, closed))
        some = T.leftmost(start, end)
        got = list(zip(*(x.tolist() for x in trie.matches(points, closed))))
        assert got == [(start[i], word[i], end[i]) for i in some] and len(got) > 100


def test_one_trie_for_many_keywords(spark, monkeypatch):
    """The size of a trie grows with its nodes, not with nodes times classes: no pass and no shuffle for every few keywords."""
    monkeypatch.setattr(T, "PART_ENTRIES", 4000)
    rows = [("".join(chr(97 + (i // 26 ** j) % 26) for j in range(4)), i) for i in range(900)]
    table = T.keyword_table(spark.createDataFrame(rows, "keyword string, ord int"))
    frame = spark.createDataFrame([(1, "xx abaa"), (2, "none")], "id long, text string")
    plan = T.matching_lines(frame, table)._jdf.queryExecution().toString()
    assert len(T._tries(table)) == 1 and "Exchange" not in plan


def test_many_tries_take_one_pass(spark, monkeypatch):
    """Texts and what single tries find in them are not shuffled and not checkpointed, however many tries there are."""
    monkeypatch.setattr(T, "PART_ENTRIES", 40)
    words = ["".join(chr(97 + (i // 26 ** j) % 26) for j in range(4)) for i in range(300)]
    table = T.keyword_table(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "keyword string, ord int"))
    frame = spark.createDataFrame([(1, "xx abaa"), (2, "none")], "id long, text string")
    assert len(T._tries(table)) > 3
    plan = T.matching_lines(frame, table)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_tries_are_in_memory_one_at_a_time(monkeypatch):
    """Each of several tries goes over the chunks that are held; together they find what one trie finds."""
    import pyarrow as pa

    monkeypatch.setattr(T, "_CHUNK", 50)
    monkeypatch.setattr(T, "_HELD", 200)
    held = []

    class Sent:
        _path = "file"

        def __init__(self, trie):
            self.trie = trie

        @property
        def value(self):
            if "_value" not in vars(self):
                held.append(sum("_value" in vars(t) for t in sent))
                self._value = self.trie
            return self._value

    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcd", k=rng.randint(2, 5))) for _ in range(80)})
    orders = rng.sample(range(1000), len(words))
    sent = [Sent(T.Trie(words[i::4], orders[i::4])) for i in range(4)]
    texts = ["".join(rng.choices("abcdxy \n", k=rng.randint(0, 90))) for _ in range(40)]
    batches = pa.table({"id": list(range(40)), "text": texts}).to_batches(max_chunksize=7)

    def found(tries):
        return [(batch.column(0)[rows[0]].as_py(), *(x.tolist() for x in found)) for batch, rows, _, _, *found in T._matched(batches, 1, tries)]

    several = found(sent)
    assert several == found([Sent(T.Trie(words, orders))]) and sum(len(x[1]) for x in several) > 100
    assert len(held) > 8 and not any(held) and not any("_value" in vars(t) for t in sent)


@pytest.mark.parametrize("letters", ["abc", "".join(map(chr, range(97, 123))) + "0123456789абвгд", "".join(map(chr, range(0x4e00, 0x4e00 + 150)))])
def test_what_is_sent_is_completed(letters):
    """A trie is sent without what follows from the rest: few, more than 32 and more than 64 classes."""
    import pickle

    rng = random.Random(1)
    words = list({"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(700)})
    trie = T.Trie(words, list(range(len(words))))
    sent = pickle.dumps(trie)
    back = pickle.loads(sent)
    assert len(trie.words) == 1 + len({w[:i] for w in words for i in range(1, len(w) + 1)}) and b"least" not in sent
    for name in ("first", "least", "words", "bits"):
        assert (getattr(trie, name) == getattr(back, name)).all()

    def least(word):
        return min([i for i, w in enumerate(words) if w.startswith(word)])

    at = {"": 0}
    for word in sorted({w[:i] for w in words for i in range(1, len(w) + 1)}, key=len)[:60]:
        at[word] = int(trie._children(np.array([at[word[:-1]]], np.int32), trie._codes[np.array([ord(word[-1])])].astype(np.int32))[1][0])
        assert trie.least[at[word]] == least(word)


def test_beginnings_are_counted(spark):
    """The parts follow from the nodes: beginnings that keywords share count once."""
    words = ["秘密", "秘", "abc", "abd", "abd😀", "b"]
    table = T.keyword_table(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "keyword string, ord int"))
    assert T._size(table.coalesce(1)) == (14, 8) or T._size(table)[0] == 14 and 8 <= T._size(table)[1] <= 14
