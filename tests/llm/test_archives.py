import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict
from glob import glob
from itertools import permutations

import pytest
from helpers import WORD, awkward_rows, sha
from pyspark.sql import functions as F

from lineward.llm import alignment, filters, queries, warc
from lineward.llm.common import joined_to_groups

SF_DIR = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, n_bytes long, digest string, file string, target string, n long, first string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def page_rows():
    texts = ["<p>a</p>", "", None, "é漢\U0001F600", "<p>a</p>", "x" * 300_000, "\0\r\n\r\n", "<p>a</p>"]
    rows = [(k, f"http://h/{k}", texts[k % len(texts)]) for k in range(60)]
    rows += [(None, "http://h/none", "<p>a</p>"), (None, None, "alone"), (7, "http://h/\r\nWARC-Type: x y", "twice"), (7, "u", "twice")]
    return [(*r, 1, "x", "y", "z", 2, "w") for r in rows]


def expected_records(rows, least=0):
    best = {}
    for i, (page, _, html, *_) in enumerate(rows):
        key = html or ""
        if key not in best or (page is not None and (best[key][0] is None or page > best[key][0])):
            best[key] = (page, i)
    out = Counter()
    for i, (page, _, html, *_) in enumerate(rows):
        first, at = best[html or ""]
        n = len((html or "").encode())
        again = n >= least and i != at
        out[page, n, digest(html), "revisit" if again else "response", first if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 1, 9, 1 << 40])
def test_archive_rows(spark, least):
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    found = warc.archived(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, found.collect())) == expected_records(rows, least)


def test_archive_is_empty_without_pages(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).collect() == []


def test_archive_files(spark, scratch):
    """Small files, read by plain code: payloads come back, revisits name a response of equal payload."""
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    headers = warc.write_archives(pages, f"{scratch}/a", "2024-01-01T00:00:00Z", file_bytes=1500)
    assert headers.select("file").distinct().count() > 8
    files = warc.deduplicate(warc.resolve(headers), f"{scratch}/a", f"{scratch}/b", file_bytes=1500)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    records = {}
    for path in glob(f"{scratch}/b/*.warc.gz"):
        with gzip.open(path) as f:
            raw = f.read()
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            n = int(fields["Content-Length"])
            block, end, raw = raw[:n], raw[n:n + 4], raw[n + 4:]
            assert version == "WARC/1.1" and end == b"\r\n\r\n"
            if fields["WARC-Type"] != "warcinfo":
                assert fields["WARC-Record-ID"] not in records
                records[fields["WARC-Record-ID"]] = fields, block.partition(b"\r\n\r\n")[2]
    assert len(records) == len(rows)
    whole = Counter()
    for fields, payload in records.values():
        if fields["WARC-Type"] == "revisit":
            target, payload_ = records[fields["WARC-Refers-To"]]
            assert payload == b"" and target["WARC-Type"] == "response"
            assert target["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            assert target.get("WARC-Target-URI") == fields.get("WARC-Refers-To-Target-URI")
            payload = payload_
        whole[int(fields["Page-ID"]) if "Page-ID" in fields else None, payload.decode()] += 1
    assert whole == Counter((r[0], r[2] or "") for r in rows)
    read = warc.read_archives(files, f"{scratch}/b")
    assert read.where("not intact").count() == 0
    assert {r["payload"].decode() for r in read.where("payload is not null").collect()} == {r[2] or "" for r in rows}


def test_damage_is_seen(spark, scratch):
    headers = warc.write_archives(spark.createDataFrame(page_rows()[:3], PAGES).coalesce(1), f"{scratch}/a")
    (name,) = {r["file"] for r in headers.collect()}
    members = list(warc._members(open(f"{scratch}/a/{name}", "rb")))
    with open(f"{scratch}/a/{name}", "wb") as f:
        f.write(b"".join(gzip.compress(m.replace(b"<p>a", b"<p>b")) for m in members))
    assert warc.read_archives(headers.select("file").distinct(), f"{scratch}/a").where("not intact").count() == 1
    with open(f"{scratch}/a/{name}", "rb") as f:
        whole = f.read()
    with open(f"{scratch}/a/{name}", "wb") as f:
        f.write(whole[:-20])
    with pytest.raises(Exception, match="within a record"):
        warc.read_archives(headers.select("file").distinct(), f"{scratch}/a").collect()


def test_joined_to_groups(spark):
    """A key with half of the rows and many small ones, both sides of the limit."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 1999).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")).where("k < 1500")
    found = joined_to_groups(rows, groups, ["k"], "n", 4000)
    both = rows.join(groups, "k", "left")
    assert found.exceptAll(both.select(found.columns)).count() == 0 and found.count() == 4000
    assert groups.where("n * 1000 >= 4000").count() == 1 and groups.where("n * 1000 < 4000").count() > 500


# Alignment ---------------------------------------------------------------------------------------


def plain_alignment(rows):
    """The contract, token by token, with the libraries' own encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def ends(pieces):
        out = [0]
        for p in pieces:
            out.append(out[-1] + len(p))
        return out

    def piece(i):
        name = sp.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode()

    kept, counts = [], Counter()
    for doc, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            raw = (" " + text).encode()
            a = tok.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            pa_ = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
            pb = [piece(i) for i in b]
            if b"".join(pa_) != raw or b"".join(pb) != raw:
                a, b = [], []
            else:
                ea, eb = ends(pa_), ends(pb)
                j = 0
                for i in range(len(a)):
                    while eb[j + 1] <= ea[i]:
                        j += 1
                    k = j
                    while k < len(b) and eb[k] < ea[i + 1]:
                        links.append((a[i], b[k]))
                        k += 1
                cuts = sorted(set(ea) & set(eb))
                at_a, at_b = ({e: i for i, e in enumerate(es)} for es in (ea, eb))
                for x, y in zip(cuts, cuts[1:]):
                    groups.append("|".join(",".join(map(str, ids[at[x]:at[y]])) for ids, at in ((a, at_a), (b, at_b))))
        counts.update(links)
        kept.append((doc, a, b, groups, links))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return Counter((doc, len(a), len(b), len(groups), len(links), sha(";".join(groups).encode()) if groups else "",
                    sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)) for doc, a, b, groups, links in kept)


def odd_texts():
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 5000 else r[1][:5000]) for r in awkward_rows()]
    more = ["<|endoftext|> and <s> </s> <unk> <0x41>", "one ▁ two", "▁", " ", "  ", "\n", " lead", "tail  ", "naïve café", "日本語テキスト", "\U0001F468‍\U0001F469‍\U0001F467",
            "a" * 4000, " " * 3000, "1234567890" * 50, "don't we'll I'M", "́́x", "ab\x00cd", "Ġword Ċ"]
    return rows + [(100 + i, t) for i, t in enumerate(more)] + [(200, "the same words"), (201, "the same words"), (201, "the same words")]


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, block long, pairs string, n_a int").repartition(3)


@pytest.mark.parametrize("small", [False, True])
def test_alignment(spark, monkeypatch, small):
    if small:  # many blocks and many chunks
        for name, value in (("BLOCK_CHARS", 9000), ("BLOCK_DOCS", 7), ("_CHUNK", 4000)):
            monkeypatch.setattr(alignment, name, value)
    rows = odd_texts()
    found = alignment.link_statistics(as_docs(spark, rows), queries.BYTE_TOKENIZER, queries.PIECES)
    if small:
        blocks = alignment._blocks(as_docs(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text")), queries.BYTE_TOKENIZER, queries.PIECES)
        assert blocks.select("block").distinct().count() in (3, *range(6, 40))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(map(tuple, found.select(columns).collect())) == plain_alignment(rows)


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(map(tuple, queries.op12_alignment(spark, SF_DIR).select(columns).collect())) == plain_alignment(rows)


def test_alignment_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_statistics(none, queries.BYTE_TOKENIZER, queries.PIECES).collect() == []
    assert alignment.align(none, queries.BYTE_TOKENIZER, queries.PIECES).collect() == []


def test_both_encoders_agree():
    """The encoding by ranks and the tokenizer's own, code points between and beside others."""
    side = alignment.tokenizer(queries.BYTE_TOKENIZER)
    assert side.fast is not None
    points = [i for i in (*range(1, 0x3100), *range(0x3100, 0x20000, 5)) if not 0xD800 <= i < 0xE000]
    texts = [f" a{chr(i)}b 1{chr(i)}2 {chr(i)}!{chr(i)} {chr(i)}\n{chr(i)}'{chr(i)}s" for i in points]
    own = side.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, own) if e.ids != side.fast.encode_ordinary(t)] == []


def test_alignment_itself(spark):
    rows = [(1, "naïve tokenisers"), (2, None), (3, "one ▁ two"), (None, "plain words here")]
    found = {r["doc_id"]: r for r in alignment.align(as_docs(spark, rows), queries.BYTE_TOKENIZER, queries.PIECES).collect()}
    for key, text in rows:
        r = found[key]
        if text is None or "▁" in text:
            assert not r["a_ids"] and not r["b_ids"] and not r["links"]
            continue
        n = len((" " + text).encode())
        assert r["a_ends"][-1] == r["b_ends"][-1] == n and r["a_groups"][-1] == r["b_groups"][-1]
        a, b = ([0, *r[c]] for c in ("a_ends", "b_ends"))
        every = [(i, j) for i in range(len(a) - 1) for j in range(len(b) - 1) if a[i] < b[j + 1] and b[j] < a[i + 1]]
        assert [tuple(x) for x in r["links"]] == every


def test_very_long_runs():
    """Runs that a pattern would try at every length, and words without end."""
    side = alignment.tokenizer(queries.BYTE_TOKENIZER)
    for text in (" " * 200_000, "ab" * 100_000, "\n \n" * 60_000 + "x"):
        (ids,) = side.encode([text])
        assert b"".join(side.names[i] for i in ids) == (" " + text).encode()


# Filters -----------------------------------------------------------------------------------------


def plain_failures(rows):
    texts = defaultdict(list)
    for i, text, *_ in rows:
        if i is not None:
            texts[text or ""].append(i)
    out = []
    for i, text, lang in rows:
        text = text or ""
        w = WORD.findall(text)
        bad = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
               bool(re.search("[#$%&*|]", text)), i is not None and any(j < i for j in texts[text]))
        out.append((i, lang or "", "".join(c for c, b in zip("ABCDE", bad) if b)))
    return out


def plain_audit(failed, labels):
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    for part in {p for _, p, _ in failed}:
        rows = [(i, f) for i, p, f in failed if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, c in enumerate(order, 1):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                shapley[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(c in f for _, f in rows) - len(gone), sum(f == c for _, f in rows),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {(*k, *v) for k, v in out.items()}


def filter_rows():
    rows = [(r[0], r[1]) for r in awkward_rows()]
    words = [f"w{i}" for i in range(200)]
    rows += [(50, " ".join(words[:99])), (51, " ".join(words[:100])), (52, " ".join(words[:80] + words[:20])), (53, " ".join(words[:79] + words[:21])),
             (54, "A" + "b" * 9), (55, "AA" + "b" * 9), (56, "#"), (57, "a|b"), (58, "same"), (59, "same"), (58, "same"), (None, "same"), (60, "Same"),
             (61, "x\x1cy\x85z q"), (62, "\x0b\x0c".join(words)), (63, ""), (64, None)]
    langs = [None, "", "en", "de"]
    return [(i, t, langs[k % 4]) for k, (i, t) in enumerate(rows)]


LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, None, None), (58, None, 1), (58, 1, None), (59, 0, 0), (None, 1, 1), (99, 1, 1), (6, 1, 0)]


@pytest.mark.parametrize("small", [False, True])
def test_filters(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_CHARS", 3000), ("BLOCK_DOCS", 3), ("_SLICE", 64)):
            monkeypatch.setattr(filters, name, value)
    rows = filter_rows()
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows],
                                 "doc_id long, text string, lang string, key string, n int, part string, block int, word string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    failed = filters.failures(docs)
    assert Counter(map(tuple, failed.collect())) == Counter(plain_failures(rows))
    found = filters.audit(failed, labels).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()
    assert len(found) == 600 * 3 and {tuple(r) for r in found} == plain_audit(plain_failures(rows), LABELS)


def test_filters_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(filters.failures(none), labels).collect() == []
    some = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    assert filters.audit(filters.failures(some), labels).where("removed > 0").count() == 120


def test_term_matrix(spark):
    rows = filter_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    matrix, dictionary = filters.term_matrix(docs)
    words = {r["term"]: bytes(r["word"]) for r in dictionary.collect()}
    assert sorted(words) == list(range(len(words))) and len(set(words.values())) == len(words) == dictionary.count()
    found = Counter()
    for r in matrix.collect():
        assert r["indices"] == sorted(set(r["indices"]))
        found[r["doc_id"], tuple(sorted((words[i], n) for i, n in zip(r["indices"], r["data"])))] += 1
    assert found == Counter((i, tuple(sorted((w.encode(), n) for w, n in Counter(WORD.findall(t or "")).items()))) for i, t, _ in rows)


def test_words_of_long_texts(monkeypatch):
    text = " \n".join(["word", "x" * 500, "", "é" * 40, "y"] * 30) + "\t"
    whole = filters.word_counts(text)
    for size in (1, 7, 64, 501):
        monkeypatch.setattr(filters, "_SLICE", size)
        assert filters.word_counts(text) == whole
