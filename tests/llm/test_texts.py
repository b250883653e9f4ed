"""Secrets, personal data, quality and mixing."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import WORD, awkward_rows, sha

from lineward.llm import mixing, privacy, quality, secrets
from lineward.llm.queries import table

SF_DIR = "/root/testdata/sf0.01"


def _spans(text, forms):
    return [(k, m.start(), m.end()) for k, p, ok in forms for m in re.finditer(p, text, re.A | (re.I if k == "assign" else 0)) if ok(m)]


SECRET_FORMS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24)]


def luhn(digits):
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _digits(m):
    return re.sub("[^0-9]", "", m.group())


PRIVATE_FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(_digits(m)) <= 15)]

TRICKY = ["token=token:abcdef secret==abcdefg api_key 'x'", "TOKEN = aaaaaa;PassWord:'zzzzzz", "ſecret=abcdefg Key", "AKIAAKIA" + "A" * 20,
          "a@b a@b.c@d.e x@@y.z ..@a.b-.c", "1.2.3.4.5.6.7.8 1.2.3 999.1.1.1.1 1..2.3.4 00255.1.1.1", "4111-1111 1111 1111 4111  11", "+1+12 34567(8)9+ +1234567890123456",
          "+49 30 1234567 . -5", "0" * 14, "deadbeef" * 3 + "g" + "0" * 23]


@pytest.mark.parametrize("texts", [TRICKY, [t or "" for _, t, *_ in awkward_rows()]])
def test_fixed_forms(texts):
    for text in texts:
        assert secrets.base_spans(text) == _spans(text, SECRET_FORMS)
        assert privacy.base_spans(text) == _spans(text, PRIVATE_FORMS)


def test_secret_rows(spark, docs, no_docs):
    more = spark.createDataFrame([(900, "see qX7pL2vR9tKs8wYz3nBm5cDf6gHj1k and the_ordinary_name_of_a_thing_here"), (901, "-" * 40)], "doc_id long, text string")
    rows = secrets.scan(docs.select("doc_id", "text").union(more)).collect()
    text = {i: t or "" for i, t, *_ in awkward_rows()}
    by_id = {r["doc_id"]: r for r in rows}
    order = {"assign": 0, "access": 1, "hex": 2}
    for i in (7, 8, 9, 4, 5):
        spans = sorted(_spans(text[i], SECRET_FORMS), key=lambda s: (s[1], order[s[0]]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert by_id[i]["base_sha256"] == sha(joined.encode())
        assert set(joined.split(",")) <= set(by_id[i]["spans"].split(","))
        assert by_id[i]["n_assign"] == sum(s[0] == "assign" for s in spans)
    assert by_id[900]["spans"] == "random:4:34" and by_id[901]["spans"] == ""
    assert secrets.scan(no_docs).count() == 0


def test_randomness_model_on_held_out_strings():
    keys, words = secrets.labelled_strings(["ordinary words make identifiers that people can read and say aloud " * 5])
    model = secrets.fit(keys[::2], words[::2])
    long_keys, names = [k for k in keys[1::2] if len(k) >= 20], [w for w in words[1::2] if len(w) >= 20]
    assert (model.scores(long_keys) >= secrets.PER_CHARACTER).mean() > 0.95
    assert (model.scores(names) >= secrets.PER_CHARACTER).mean() < 0.02


def test_secrets_of_a_long_text():
    """Base spans and runs are walked once: 40,000 of each take about as long per span as 4,000."""
    import time

    def seconds(n):
        text = " ".join(f"{k:024x} Name{k}OfSomething_long" for k in range(n))
        own = secrets.base_spans(text)
        start = time.process_time()
        left = secrets._uncovered(secrets.CANDIDATE.finditer(text), own)
        assert len(own) == n and all("Name" in m.group() for m in left) and len(left) == n
        return time.process_time() - start

    assert seconds(40_000) < 2


def test_uncovered_runs_equal_all_pairs():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choices("ab  ", k=60))
        runs = list(re.finditer("[ab]+", text))
        spans = [("x", a, a + rng.randint(0, 9)) for a in (rng.randrange(60) for _ in range(rng.randint(0, 9)))]
        plain = [m.span() for m in runs if not any(a <= m.start() and m.end() <= b for _, a, b in spans)]
        assert [m.span() for m in secrets._uncovered(runs, spans)] == plain


def plain_ratio(random_strings, ordinary):
    """Both Markov models spelled out, a dictionary of transitions each."""
    def model(strings):
        pairs, alone, total = {}, {}, 0
        for s in strings:
            for a, b in zip(s, s[1:]):
                pairs[a, b] = pairs.get((a, b), 0) + 1
                alone[b] = alone.get(b, 0) + 1
                total += 1
        after = {}
        for (a, _), n in pairs.items():
            after[a] = after.get(a, 0) + n
        return lambda a, b: (pairs.get((a, b), 0) + 5.0 * (alone.get(b, 0) + 1) / (total + 96)) / (after.get(a, 0) + 5.0)
    p, q = model(random_strings), model(ordinary)
    return lambda s: sum(math.log(p(a, b) / q(a, b)) for a, b in zip(s, s[1:])) / (len(s) - 1)


def test_randomness_equals_plain_models():
    keys, words = secrets.labelled_strings(["ordinary words make identifiers that people can read and say aloud " * 5])
    keys, words = keys[:600], words[:600]
    model, plain = secrets.fit(keys, words), plain_ratio(keys, words)
    strings = [s for s in keys[:80] + words[-80:] if len(s) > 1]
    assert np.allclose(model.scores(strings), [plain(s) for s in strings])
    enough = [plain(s) * len(s) >= 0.7 * max(len(s), 20) for s in strings]
    assert model.is_random(strings).tolist() == enough


def test_short_runs_are_judged():
    keys, words = secrets.labelled_strings(["ordinary words make identifiers that people can read and say aloud " * 5])
    model = secrets.fit(keys[::2], words[::2])
    short_keys, names = ([s[:k % 4 + 16] for k, s in enumerate(x) if len(s) >= 20] for x in (keys[1::2], words[1::2]))
    assert model.is_random(short_keys).mean() > 0.85
    assert model.is_random(names).mean() < 0.02


def test_randomness_model_counts_all_documents(spark):
    """Identifiers of a small source count, however many documents the others have; parts and order don't matter."""
    rng = random.Random(8)
    odd = ["".join(rng.choices("QXZJ", k=2)) + "".join(rng.choices("vkwq", k=3)) for _ in range(60)]
    rows = [(i, "ordinary words make a letter that people can read aloud") for i in range(6000)]
    rows += [(10_000 + i, " ".join(rng.choices(odd, k=4000))) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.train(frame.repartition(5))
    assert (model.ratio == secrets.train(frame.coalesce(1)).ratio).all()
    values, ordinary = secrets._all_counts(frame, 2)
    words = [w for _, t in rows for w in re.findall("[A-Za-z0-9]{2,}", t)]
    pair = [ord("v") - 31, ord("k") - 31]
    assert ordinary[tuple(pair)] >= sum(w.count("vk") for w in words) > 0 and not values.any()
    names = ["_".join(rng.choices(odd, k=5)) for _ in range(200)]
    assert (model.scores(names) >= secrets.PER_CHARACTER).mean() < 0.05


def test_private_rows(spark, docs, no_docs):
    rows = privacy.find(docs).collect()
    assert len(rows) == len(awkward_rows())
    text = {i: t or "" for i, t, *_ in awkward_rows()}
    by_id = {r["doc_id"]: r for r in rows}
    for i in (7, 8, 9, 4):
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in _spans(text[i], PRIVATE_FORMS))
        assert by_id[i]["base_sha256"] == sha(joined.encode()) and by_id[i]["spans"].startswith(joined)
    assert (by_id[7]["n_email"], by_id[7]["n_ip"], by_id[7]["n_card"], by_id[7]["n_phone"]) == (1, 1, 1, 1)
    assert privacy.find(no_docs).count() == 0


def test_terms_that_give_an_entity_away(spark):
    """One word always stands by the same address, the others anywhere."""
    rows = [(i, f"the clerk Wolfgangus writes from w@mail.example.com on day {i}" if i % 200 == 0 else f"the clerk writes a letter on day {i}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in privacy.find(frame).collect()}
    assert "term:10:20" in found[200]
    assert "term:4:9" not in found[200] and found[201] == ""
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(frame).collect()}
    assert "Wolfgangus" not in clean[200] and "<email>" in clean[200] and "clerk" in clean[200] and clean[201] == rows[201][1]


def test_terms_of_an_entity_in_one_document(spark):
    """Against a plain version: whole documents, entities of one document, short names, every occurrence."""
    rng = random.Random(4)
    common = ["clerk", "writes", "letter", "on", "a", "day", "of", "rain"]
    rows = [(i, " ".join(rng.choices(common, k=40))) for i in range(300)]
    rows[7] = (7, "Ngo spoke.\n" + "the clerk " * 60 + "write to n.x@mail.example.com\n" + "a day " * 60 + "and so NGO left")
    rows[8] = (8, "Ada and Bo share ada@mail.example.com and bo@mail.example.com on a day of rain, says Ada")
    rows[9] = (9, "Bo has bo@mail.example.com again")
    rows.append(rows[9])
    found = [(i, r["spans"]) for r in privacy.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect() for i in [r["doc_id"]]]

    entities = [{t[a:b] for _, a, b in privacy.base_spans(t)} for _, t in rows]
    words = [[(m.group().lower(), *m.span()) for m in re.finditer(r"\w+", re.sub(r"\S+@[\w.]+", lambda m: " " * len(m.group()), t))] for _, t in rows]
    expected = []
    for k, (i, t) in enumerate(rows):
        spans = [(a, b) for w, a, b in words[k] for e in sorted(entities[k])
                 for n_t in [sum(w in {x for x, _, _ in own} for own in words)] for n_e in [sum(e in own for own in entities)]
                 for both in [sum(e in own and w in {x for x, _, _ in ws} for own, ws in zip(entities, words))]
                 if both >= 0.9 * n_t and both * len(rows) >= 64 * n_t * n_e]
        base = [f"{kind}:{a}:{b}" for kind, a, b in privacy.base_spans(t)]
        expected.append((i, ",".join(base + [f"term:{a}:{b}" for a, b in sorted(set(spans))])))
    assert sorted(found) == sorted(expected)
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "ngo" not in clean[7].lower() and "Ada" not in clean[8] and "Bo" not in clean[9] and "clerk" in clean[7]


def test_sanitised_rows_keep_their_columns(docs, no_docs):
    out = privacy.sanitise(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not [r for r in privacy.find(out).collect() if r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]]
    assert privacy.sanitise(no_docs).count() == 0


def test_quality_on_held_out_rows(spark):
    docs = table(spark, SF_DIR, "documents")
    labels = table(spark, SF_DIR, "labels")
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    # Labels of held-out rows are not read: turned around, they change nothing.
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end quality")
    again = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, turned)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in rows}


def test_quality_features_do_not_depend_on_company():
    """A text's first word isn't compared with the last one of the text before it."""
    texts = ["one two end", "end", "end of it", "", "end end", "end", "it it", "\n", "it"]
    alone = [sorted(quality.features([t])[0].tolist()) for t in texts]
    for some in (texts, texts[::-1], texts[2:5]):
        ids, sizes = quality.features(some)
        together = [sorted(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert together == [alone[texts.index(t)] for t in some]
    model = quality.QualityModel(np.random.default_rng(3).normal(size=quality.BUCKETS).astype(np.float32), 0.0)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-6)


def test_quality_fits_four_thousand_documents(spark, monkeypatch):
    rows = [(i, f"text {i} " + "again " * (70_000 if i == 1 else i % 300), i % 2) for i in range(5200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda ids, counts, labels: seen.append((ids, counts, labels)))
    quality.train(frame.select("doc_id", "text"), frame.select("doc_id", "quality").where("doc_id <> 5"))
    ids, counts, labels = seen[0]
    assert 0.9 * 4000 <= len(labels) <= 4000
    for n in ([1, 255], [1, 256], [65_535, 3], [65_536, 3]):
        assert quality._widened(quality._narrow(np.array(n)), 2).tolist() == n
    assert all(len(a) == len(b) for a, b in zip(ids, counts))


def test_quality_sends_a_byte_or_two_a_feature_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(60)] + ["again " * 300]
    frame = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    gathered, seen = quality._gathered, []
    monkeypatch.setattr(quality, "_gathered", lambda rows: seen.append(rows) or gathered(rows))
    monkeypatch.setattr(quality, "fit", lambda ids, counts, labels: seen.append((ids, counts)))
    quality.train(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    rows, (ids, counts) = seen
    for r, own, n in zip(rows, ids, counts):
        values, times = np.unique(quality.features([texts[r["doc_id"]]])[0], return_counts=True)
        assert own.tolist() == values.tolist() and n.tolist() == times.tolist()
    assert sum(len(r["gaps"]) + len(r["counts"]) for r in rows) < 2 * sum(map(len, ids))


def test_quality_awkward(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (3, 5)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    model = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0
    assert quality.accepted(docs, model).columns == docs.columns


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        left, whole = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: left * weight[s] / whole for s in free}}
        fixed.update({s: 2.0 * sizes[s] for s in over})
        free -= set(over)
    return fixed


@pytest.mark.parametrize("cut_last", [True, False])
def test_mix(spark, docs, cut_last):
    for frame in (table(spark, "/root/testdata/sf0.001", "documents"), docs):
        given = frame.select("doc_id", "text", "source").collect()
        rows = mixing.mix(frame, cut_last=cut_last).collect()
        assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r["doc_id"] or -1, len(WORD.findall(r["text"] or ""))) for r in given)
        sizes, taken, most = {}, {}, {}
        for r in rows:
            s = r["source"]
            sizes[s] = sizes.get(s, 0) + r["size"]
            taken[s] = taken.get(s, 0) + r["taken"]
            most[s] = max(most.get(s, 0), r["size"])
            assert 0 <= r["taken"] <= 2 * r["size"]
            assert r["taken"] >= r["size"] * (r["target"] // r["source_size"]) if r["source_size"] else r["taken"] == 0
        for s, target in plain_targets(sizes).items():
            assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sizes[s] for r in rows if r["source"] == s)
            assert abs(taken[s] - target) <= (1 if cut_last else most[s] / 2 + 1)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(frame, cut_last=cut_last).collect()))


def test_mixed_documents_keep_their_source(spark):
    """Rows in several sources, some repeated: every source comes out with the copies that were planned for it."""
    rng = random.Random(31)
    texts = [" ".join(rng.choices(["aa", "bb", "cc"], k=rng.randint(5, 60))) for _ in range(40)]
    rows = [(i % 30, texts[i % 40], rng.choice(["s1", "s2", "s3", None])) for i in range(400)] + [(7, "all the same words", s) for s in ("s1", "s3") * 60]
    rows += [(8, None, "x"), (8, "x", None), (8, "x", "x")] * 4
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    planned, got = Counter(), Counter()
    for r in mixing.mix(frame, cut_last=False).collect():
        planned[r["doc_id"], r["size"], r["source"]] += r["copies"]
    for r in mixing.mixed_documents(frame).collect():
        got[r["doc_id"], len((r["text"] or "").split()), r["source"]] += 1
    assert got == Counter({k: n for k, n in planned.items() if n})


def test_mixed_documents(docs, no_docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    expected = sum(r["taken"] for r in mixing.mix(docs, cut_last=False).collect())
    assert words == expected
    assert mixing.mixed_documents(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
