"""Skip index and lines of large files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lineward.operators.keyword_scan import explode_lines, line_findings
from lineward.sources import line_files as N
from lineward.sources import skip_index as K


@pytest.fixture()
def indexed(spark, scratch):
    rng = random.Random(2)
    letters = ["abcdefg ", "hijklmn ", "опрст ", "秘涉密机保 ", "ſßİıK "]
    rows = [(100 * k + i, "\n".join("".join(rng.choices(a, k=30)) for _ in range(3)), k) for k, a in enumerate(letters) for i in range(20)]
    rows += [(900, None, 0), (901, "", 1)]
    docs = spark.createDataFrame(rows, "id long, text string, k int")
    docs.repartition(5, "k").write.partitionBy("k").parquet(f"{scratch}/d")
    K.build_index(spark, f"{scratch}/d")
    return docs, f"{scratch}/d"


@pytest.mark.parametrize("keywords", [["abc"], ["机密"], ["HIJ", "ОП"], ["abh"], ["s"], ["ss"], ["k"], ["i", "опр"], ["zzz"], [""], ["a g"]])
def test_skipped_files_hold_no_match(spark, indexed, keywords):
    docs, path = indexed
    keywords = [k for k in keywords if k]
    expected = sorted(map(tuple, line_findings(docs.select("id", "text"), keywords).collect()))
    assert sorted(map(tuple, K.indexed_findings(spark, path, ["id"], keywords).collect())) == expected


def test_files_are_skipped(spark, indexed):
    _, path = indexed
    every = len(spark.read.parquet(path).inputFiles())
    for keyword, most in (("机密", 1), ("abc", 1), ("abh", 0), ("zzz", 0)):
        assert len(K.pruned_read(spark, path, [keyword]).inputFiles()) <= most or most == 0 and K.pruned_read(spark, path, [keyword]).isEmpty()
    assert every >= 5


def test_a_file_the_index_does_not_know_is_read(spark, indexed):
    docs, path = indexed
    spark.createDataFrame([(5000, "zzz here")], "id long, text string").write.parquet(f"{path}/k=9")
    assert [r["id"] for r in K.indexed_findings(spark, path, ["id"], ["zzz"]).collect()] == [5000]


def test_lines_of_files_in_blocks(spark, scratch):
    """Small splits: a file of many blocks, with blank lines, long lines and carriage returns."""
    rng = random.Random(4)
    texts = {}
    for name in ("one", "two", "empty"):
        lines = ["".join(rng.choices("token \té", k=rng.choice([0, 1, 5, 40, 700]))) + rng.choice(["", "\r", " "]) for _ in range(0 if name == "empty" else 400)]
        texts[name] = "\n".join(lines)
        with open(f"{scratch}/{name}.txt", "w", newline="", encoding="utf-8") as f:
            f.write(texts[name])
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "900")
        lines = N.file_lines(spark, [scratch])
        found = N.file_findings(spark, [scratch], ["token"])
        assert N._placed(spark, [scratch]).select("path", "block").distinct().count() > 40 and lines.rdd.getNumPartitions() > 1
        name = F.regexp_extract("path", "([a-z]+)[.]txt$", 1).alias("name")
        docs = spark.createDataFrame(list(texts.items()), "name string, text string")
        assert sorted(map(tuple, lines.select(name, "line_no", "line").collect())) == sorted(map(tuple, explode_lines(docs).collect()))
        expected = sorted(map(tuple, line_findings(docs, ["token"]).collect()))
        assert sorted(map(tuple, found.select(name, "line_no", "content", "keyword").collect())) == expected and len(expected) > 50
        assert N.file_findings(spark, [scratch], []).count() == 0
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert os.path.getsize(f"{scratch}/one.txt") > 900


def test_bits_of_a_file_are_distinct_before_bitmaps(spark, scratch):
    """Only the different bits of a file are sorted for the aggregate of bitmaps, not every pair of its lines."""
    from lineward.sources import skip_index as I

    spark.createDataFrame([(i, "ab ab\nab") for i in range(50)], "doc_id long, text string").coalesce(1).write.parquet(scratch + "/in")
    index = I.build_index(spark, scratch + "/in")
    assert index.select("file").distinct().count() == 1
    assert I.possible_files(index, ["ab"]).count() == 1 and I.possible_files(index, ["xy"]).count() == 0


def test_tasks_hand_on_bitmaps_and_not_pairs(spark, scratch, monkeypatch):
    """The flags of a file are those of the pairs of its lines, whatever pieces it is looked at in, and no row is made for a pair."""
    import pyarrow as pa

    monkeypatch.setattr(K, "_CHUNK", 7)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abÄßİ秘密😀 \n", k=n)) for n in (0, 1, 2, 3, 40, 200)] + [None]
    of = ["x", "x", "x", "x", "x", "y", "z"]
    batches = [pa.table({"file": of[a:b], "size": [1] * (b - a), "changed": [0] * (b - a), "_text": pa.array([t and t.encode() for t in texts[a:b]], pa.binary())}
                        ).to_batches()[0] for a, b in ((0, 3), (3, 7))]
    rows = [r for out in K._bitmaps(iter(batches)) for r in out.to_pylist()]
    for name in "xyz":
        lines = [line for f, t in zip(of, texts) if f == name for line in (t or "").split("\n")]
        wanted = {K._bit(c, "") for line in lines for c in line}
        wanted |= {K._bit(a, line[i + d]) for line in lines for i, a in enumerate(line) for d in (1, 2, 3) if i + d < len(line)}
        got = {32768 * r["bucket"] + 8 * i + k for r in rows if r["file"] == name for i, x in enumerate(r["bits"]) for k in range(8) if x >> k & 1}
        assert wanted <= got and len(got - wanted) <= 50 and all(len(r["bits"]) == 4096 for r in rows)  # besides, pairs of which one is a line feed
        assert sum(r["file"] == name for r in rows) <= max(1, len(got))
    docs = spark.createDataFrame([(i, "秘密 ab") for i in range(50)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(scratch + "/in")
    made = []
    frame = type(docs)
    monkeypatch.setattr(frame, "groupBy", lambda self, *a, f=frame.groupBy: made.append(self) or f(self, *a))
    K.build_index(spark, scratch + "/in")
    monkeypatch.undo()
    assert [m.count() for m in made] and all(m.count() <= K.BITS // 32768 for m in made)


def test_invalid_bytes_are_indexed(spark, scratch):
    """Bytes that are no text count as a replacement character, and those around them are found."""
    docs = spark.sql("SELECT 1L AS id, cast(concat(encode('to', 'utf-8'), X'ff', encode('ken', 'utf-8')) AS string) AS text")
    docs.write.parquet(scratch + "/in")
    K.build_index(spark, scratch + "/in")
    assert [r["id"] for r in K.pruned_read(spark, scratch + "/in", ["token"]).select("id").collect()] == [1]
