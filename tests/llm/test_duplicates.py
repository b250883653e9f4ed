"""Near-duplicates, repeated passages, fingerprints and vectors against all-pairs comparison."""

import random

import numpy as np
import pytest
from helpers import awkward_rows, near_duplicates, sha, shingle_set, without_repeats

from lineward.llm import common, fingerprints, minhash, suffixes, vectors


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert found == {x: root(x) for x in parent}


def test_shingles_equal_sets():
    texts = [t or "" for _, t, *_ in awkward_rows()]
    values, counts = minhash.shingles(texts)
    assert counts.tolist() == [len(shingle_set(t)) for t in texts]
    upper = minhash.shingles([t.upper() if t.isascii() else t for t in texts])
    assert (upper[0] == values).all()


def test_minhash_awkward(docs, no_docs):
    rows = [(i, t) for i, t, *_ in awkward_rows()]
    found = minhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    # Rows without id belong to the component of their links, but stand for none.
    named = {tuple(r) for r in found if r["doc_id"] is not None}
    assert named == near_duplicates([r for r in rows if r[0] is not None])
    assert not any(r["kept"] for r in found if r["doc_id"] is None)
    assert minhash.near_duplicates(no_docs).count() == 0
    assert minhash.deduplicated(docs).columns == docs.columns


def test_minhash_group_around_a_base(spark):
    """Copies that link to their base only: the centre of a bucket must not decide."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(3000)]
    rows = []
    for group in range(6):
        base = rng.choices(words, k=rng.choice([40, 120, 200]))
        for i in range(25):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((group * 100 + rng.randint(0, 49) * 2 + i % 2, " ".join(text)))
    rows = list({i: (i, t) for i, t in rows}.values())
    found = {tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == near_duplicates(rows)


def test_minhash_keeps_the_distinct_text_of_a_repeated_id(spark):
    rng = random.Random(12)
    one, other = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(2))
    rows = [(1, one), (2, one + " more"), (2, other), (3, None), (4, other), (None, one)]
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, one), (2, other), (3, None), (None, one)]))


def test_rows_without_partner_are_told_where_they_are(spark):
    """Both sides together are all rows, none with a partner is told apart, nearly all others are; only the filter is shuffled."""
    rows = spark.range(3000).selectExpr("if(id % 7 = 0, null, id) as k", "id % 3 as j", "repeat(cast(id as string), 50) as text").cache()
    partners = rows.where("k < 300 or k is null").select("k", "j").union(spark.sql("select 5000L, 1L"))
    may, none = (common.with_partner(rows, partners, ["k", "j"], how) for how in ("left_semi", "left_anti"))
    assert may.columns == none.columns == rows.columns
    assert sorted(map(tuple, may.union(none).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert not none.where("k < 300 or k is null").count() and may.where("k >= 300").count() < 10
    assert common.with_partner(rows, partners.limit(0), ["k", "j"]).count() == 0
    plan = none._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(_word" in plan and plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_only_named_texts_are_shuffled(spark):
    """The last step of the near-duplicates stage moved all texts four times."""
    rows = [(i, f"w{i} " * 30, "x") for i in range(40)] + [(50, "w1 " * 30, "x"), (3, "other words of its own", "y"), (3, "w3 " * 30, "x"), (None, "w1 " * 30, "x")]
    kept = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 2 and "Union" in plan
    got = sorted(map(tuple, kept.collect()), key=str)
    assert got == sorted([(i, f"w{i} " * 30, "x") for i in range(40)] + [(3, "other words of its own", "y"), (None, "w1 " * 30, "x")], key=str)


def test_groups_and_ranks_are_sorted_as_one_number(monkeypatch):
    rng = np.random.default_rng(6)
    group = np.sort(rng.integers(0, 50, 4000))
    follow = rng.integers(-1, 300, 4000)
    expected = np.lexsort((follow, group))
    assert (suffixes._sorted(group, follow, 1 << 60) == expected).all()  # too large for one number
    monkeypatch.setattr(np, "lexsort", None)
    assert (suffixes._sorted(group.astype(np.int32), follow.astype(np.int32), 4000) == expected).all()
    words = [b"one two three four five six seven"] * 40
    order = suffixes.suffix_array(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
    assert sorted(order.tolist()) == list(range(len(b"".join(words))))


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(15):
        strings = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 200))) for _ in range(30)]
        strings += [strings[3] + b"x"] * 3
        ends, b = np.cumsum([len(s) for s in strings]), np.frombuffer(b"".join(strings), np.uint8)
        order = suffixes.suffix_array(b, ends)
        common_ = suffixes.common_prefixes(b, ends, order, 100)
        found = [b.tobytes()[x:ends[k]] for x, k in zip(order, np.searchsorted(ends, order, "right"))]
        assert found == sorted(found)
        for i in range(1, len(found)):
            n = next((k for k, (x, y) in enumerate(zip(found[i], found[i - 1])) if x != y), min(len(found[i]), len(found[i - 1])))
            assert common_[i] == min(n, 100)


def _passages(rng) -> list[tuple[int, str]]:
    base = ["".join(rng.choices("ab ", k=400)) for _ in range(3)] + ["x" * 500, "xy" * 300]
    rows = []
    for i in range(200):
        parts = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 200)
            parts += [rng.choice(base)[a:a + rng.randint(20, 300)], "".join(rng.choices("cde", k=rng.choice([1, 2, 3, 50])))]
        rows.append((i, "".join(parts)))
    return rows


def test_repeated_passages(spark, docs, no_docs, monkeypatch):
    rows = _passages(random.Random(4))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = without_repeats([(i, t.encode()) for i, t in rows])
    assert sorted(map(tuple, suffixes.without_repeats(frame).collect())) == expected
    monkeypatch.setattr(suffixes, "SHARD", 20)  # anchors in several shards, merged by binary search
    assert sorted(map(tuple, suffixes.without_repeats(frame).collect())) == expected
    assert suffixes.without_repeats(no_docs).count() == 0


@pytest.mark.parametrize("shard", [8, 25, 60])
def test_repeated_passages_of_many_corpora(spark, monkeypatch, shard):
    """Forty corpora that share no character, so that each is removed from as if it were alone; many runs to merge."""
    monkeypatch.setattr(suffixes, "SHARD", shard)
    monkeypatch.setattr(suffixes, "_SHARD_BYTES", 1 << 14)
    rows = []
    for seed in range(40):
        own = {ord(c): 0x100 + 16 * seed + k for k, c in enumerate("ab cdexy")}
        rows += [(1000 * seed + i, t.translate(own)) for i, t in _passages(random.Random(seed))[:120]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, suffixes.without_repeats(frame).collect())) == without_repeats([(i, t.encode()) for i, t in rows])


def test_repeated_passages_awkward(docs):
    rows = awkward_rows()
    found = suffixes.without_repeats(docs).collect()
    assert len(found) == len(rows)
    # Rows that repeat id and text have equal results; rows without id are after all others.
    assert len({tuple(r) for r in found if r["doc_id"] == 3}) == 2
    assert all(r["n_removed"] == r["n_bytes"] for r in found if r["doc_id"] is None and r["n_bytes"] > 1000)
    single = sorted((i, (t or "").encode()) for i, t, *_ in rows if i not in (3, None))
    some = docs.where("doc_id is not null and doc_id <> 3")
    assert sorted(map(tuple, suffixes.without_repeats(some).collect())) == without_repeats(single)


def test_fingerprints_do_not_depend_on_company():
    texts = [t or "" for _, t, *_ in awkward_rows()]
    together = fingerprints.fingerprints(texts)
    assert together == [fingerprints.fingerprints([t])[0] for t in texts]
    assert together[texts.index("")] == "0" * 4 * fingerprints.VALUES
    prose = texts[0]
    assert fingerprints.likeness(together[0], fingerprints.fingerprints(["zzz qq " + prose])[0]) > 0.9
    assert fingerprints.likeness(together[0], fingerprints.fingerprints([texts[9]])[0]) < 0.3


def test_fingerprint_rows(spark, docs, no_docs):
    key = lambda r: (r[0] is None, -(r[0] or 0), r[1] or "")
    rows = sorted([(i, t) for i, t, *_ in awkward_rows()], key=key)
    expected = set()
    for k, (i, t) in enumerate(rows):
        text, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        f, e, a = fingerprints.fingerprints([text, edited, after])
        expected.add((i, len(text), sha(edited.encode()), f, e, fingerprints.likeness(f, e), fingerprints.likeness(f, a)))
    found = fingerprints.compare_fingerprints(docs).collect()
    assert len(found) == len(rows) and {tuple(r) for r in found} == expected
    assert fingerprints.compare_fingerprints(no_docs).count() == 0
    alone = fingerprints.compare_fingerprints(docs.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 20))
    rows = [(i, (base[i % 12] + rng.normal(size=20) * rng.choice([0.0, 0.15, 0.3])).astype(float).tolist(), int(i % 3) if i % 17 else None) for i in range(240)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 20, 1), (303, [None] + [1.0] * 19, 1), (304, [float("nan")] * 20, 1),
             (305, [1.0, 2.0], 1), (306, [2.0, 4.0], 1), (307, [float("inf")] * 20, 1)]
    monkeypatch.setattr(vectors, "BLOCK", 16)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted(map(tuple, vectors.near_duplicates(frame).collect()))

    def linked(a, b):
        x, y = rows[a], rows[b]
        if a == b or x[2] is None or x[2] != y[2] or not x[1] or not y[1] or len(x[1]) != len(y[1]):
            return False
        if any(v is None or not np.isfinite(v) for v in x[1] + y[1]) or not any(x[1]) or not any(y[1]):
            return False
        return np.dot(x[1], y[1]) / np.sqrt(np.dot(x[1], x[1]) * np.dot(y[1], y[1])) >= 0.93

    link = [[b for b in range(len(rows)) if linked(a, b)] for a in range(len(rows))]
    low = list(range(len(rows)))
    for _ in rows:
        low = [min([low[a], *(low[b] for b in link[a])]) for a in range(len(rows))]
    expected = sorted((rows[a][0], len(link[a]), rows[low[a]][0], low[a] == a) for a in range(len(rows)))
    assert found == expected and sum(r[1] for r in found) > 50
    assert vectors.near_duplicates(frame.limit(0)).count() == 0
