"""The pipeline's stages, each on what the one before it kept, and the registered queries."""

import base64
import random
import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from helpers import WORD, lowest_reachable, near_duplicates, sha

import __spark_entry__ as entry
from lineward.llm import common, minhash, mixing, privacy, quality
from lineward.llm.queries import BYTE_RANKS, table

SF_DIR = "/root/testdata/sf0.001"


def test_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    kept = docs
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF_DIR).cache()
        seen.append(kept)
    good, distinct, clean, mixed, encoded = seen
    assert all(f.columns == docs.columns for f in seen[:-1])

    model = quality.train(docs, table(spark, SF_DIR, "labels"))
    accepted = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"]}
    assert {r["doc_id"] for r in good.collect()} == accepted and good.count() < docs.count()

    one_each = {i for i, _, _, kept_ in near_duplicates([(r["doc_id"], r["text"]) for r in good.collect()], corpus_pipeline.SHINGLE) if kept_}
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(one_each)

    private = {r["doc_id"]: r for r in privacy.find(distinct).collect()}
    before = {r["doc_id"]: r["text"] for r in distinct.collect()}
    for r in clean.collect():
        assert private[r["doc_id"]]["spans"] or r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert not [r for r in privacy.find(clean).collect() if r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]]

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean, cut_last=False).collect()}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in copies.items() if n}
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) > 0

    with open(BYTE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in mixed.collect():
        ids = library.encode_ordinary(r["text"])
        expected.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r["text"].encode())))
    assert sorted(map(tuple, encoded.collect())) == sorted(expected)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(expected)


def test_near_duplicates_stage_takes_five_words(spark):
    """Substitutions between n/45 and n/36 part a 5-word pair that four words link."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(4000)]
    rows = []
    for group in range(12):
        base = rng.choices(words, k=180)
        for k, changes in enumerate((0, 2, 4, 5)):
            text = list(base)
            for at in range(changes):
                text[10 + at * 33 + 7 * k] = f"new{group}x{k}x{at}"
            rows.append((group * 10 + k, " ".join(text)))

    def kept(size):
        sets = [frozenset(tuple(w[j:j + size]) for j in range(len(w) - size + 1)) for w in (t.split() for _, t in rows)]
        low = lowest_reachable(len(rows), [(a, b) for a in range(len(rows)) for b in range(a)
                                           if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
        return [rows[k][0] for k in range(len(rows)) if low[k] == k]

    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r["doc_id"] for r in corpus_pipeline.keep_distinct(spark, frame, SF_DIR).collect())
    assert found == kept(5) != kept(4)


def test_workers_get_small_batches(spark):
    """3,000 texts of 8,000 characters in one partition come as batches of a few MB, whole and in order; a longer text comes too."""
    frame = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat(char(97 + id % 26), if(id = 5, 9000000, 8000)) as text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes], "first": [batch.column(0)[0].as_py()]})

    found = common.in_batches(frame, run, "rows long, bytes long, first long").collect()
    assert sum(r["rows"] for r in found) == 3000 and [r["first"] for r in found] == sorted(r["first"] for r in found)
    assert max(r["bytes"] for r in found if not r["first"] <= 5 < r["first"] + r["rows"]) < 1.5 * common.BATCH_BYTES
    assert max(r["bytes"] for r in found) < 9_000_000 + 1.5 * common.BATCH_BYTES


def test_chunks_take_little_memory():
    """What scoring and sketching hold of the characters that they take at once."""
    rng = random.Random(4)
    for module, work in ((quality, quality.features), (minhash, lambda t: minhash.sketches(*minhash.shingles(t, 5)))):
        texts = ["".join(rng.choices("abcdefgh    ", k=2048)) for _ in range(module._CHUNK // 2048)]
        tracemalloc.start()
        work(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 40e6
