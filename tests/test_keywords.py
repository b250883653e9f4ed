import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineward.functions import keywords as K
from lineward.operators import keyword_scan as S

KWZ = K.DEFAULT_KEYWORDS


def expected(text, keywords):
    """The rule in plain Python: up to two characters between neighbours, any case, per line."""
    rx = re.compile("|".join("(?:" + ".{0,2}?".join(map(re.escape, k)) + ")" for k in keywords), re.IGNORECASE)
    out = []
    for n, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        found = [m for m in rx.finditer(line) if m.group()]
        if not found:
            continue
        a, b = max(0, found[0].start() - 40), min(len(line), found[0].end() + 40)
        cut = ("..." if a else "") + line[a:b] + ("..." if b < len(line) else "")
        out.append((n, line if len(line) <= 120 else cut, ", ".join(sorted({m.group() for m in found}))))
    return out


def scan(spark, texts, keywords):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = S.line_findings(df, keywords).collect()
    return {i: sorted((r.line_no, r.content, r.keyword) for r in rows if r.id == i) for i in range(len(texts))}


def check(spark, texts, keywords):
    got = scan(spark, texts, keywords)
    for i, text in enumerate(texts):
        assert got[i] == sorted(expected(text, keywords)), repr(text)


def test_variants(spark):
    texts = ["机 密", "机@密", "秘~密", "机xx密", "机xxx密", "机\n密", "机\r密", "机 密", "秘涉x密", "", "机密机 密"]
    check(spark, texts, KWZ)
    got = scan(spark, texts, KWZ)
    assert got[4] == [] and got[5] == [] and got[6] and got[7]
    assert got[8] == [(1, "秘涉x密", "秘涉x密")]


def test_letter_case(spark):
    check(spark, ["École ÉCOLE école", "toKen TO-KEN", "STRASSE straße", "ſecret SECRET", "Σίσυφος ΣΊΣΥΦΟΣ", "İx ıx"],
          ["école", "token", "straße", "secret", "ς", "ix"])


def test_special_characters(spark):
    check(spark, ["a.b", "axb", "[x]", "c++", "c +  +", "^$", "a\\b", "x|y", "{1}", "-&~#"],
          ["a.b", "[x]", "c++", "^$", "a\\b", "x|y", "{1}", "-&~#"])


def test_context_boundaries(spark):
    for size in (119, 120, 121, 200):
        pad = "x" * (size - 5)
        check(spark, ["token" + pad, pad + "token", pad[:60] + "token" + pad[60:], "😀" * 50 + "token" + "😀" * (size - 55)],
              ["token"])


def test_numbering_and_white_space(spark):
    check(spark, ["\n\n token \n\n", " 　token \n\x1ctoken\x1f", "\ttoken", "a\n\ntoken\n"], ["token"])


def test_keywords_with_blanks(spark):
    check(spark, ["x top secret", "top", " a", "b a ", "topxxsecret"], ["top secret", " a"])


def test_no_keywords(spark):
    assert scan(spark, ["token"], [])[0] == []
    assert scan(spark, ["token"], [""])[0] == []
    assert K.parse_keywords(" a, ,b ,") == ["a", "b"]


def test_random_texts(spark):
    alphabet = "机密涉秘 tToOkKeEnN.\r \u0085K😀é　\n|*"
    cases = []

    @settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck), database=None)
    @given(st.text(alphabet=alphabet, max_size=200))
    def gather(text):
        cases.append(text)

    gather()
    for keywords in (["机密", "涉密", "秘密"], ["token", "Ek"], ["o.", "é|"]):
        check(spark, cases, keywords)


def test_prefilter_loses_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    kws = ["token", "thing", "nicht"]
    assert S.prefiltered_findings(df, kws).exceptAll(S.line_findings(df, kws)).isEmpty()
    assert S.line_findings(df, kws).exceptAll(S.prefiltered_findings(df, kws)).isEmpty()


def test_coarse_filter_is_pushed_down(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = S.candidates(part, ["p_name"], ["red"], ignore_case=False).select("p_name")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(p_name,red)" in text and "ReadSchema: struct<p_name:string>" in text


def test_findings_need_no_shuffle(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = S.line_findings(df, ["token"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_scorer_has_the_columns_of_the_pattern(spark):
    from lineward.operators.scoring import python_scorer

    df = spark.createDataFrame([(1, "a\nmy token here\nb")], "id int, text string")
    answer = '{"has_sensitive": true, "matches": [{"keyword": "token", "context": "my token here"}]}'
    by_model = S.scan(df, "id", ["token"], method=python_scorer(lambda: lambda prompt: answer))
    assert [tuple(r) for r in by_model.select("id", "line_no", "content", "keyword").collect()] == [
        tuple(r) for r in S.scan(df, "id", ["token"]).select("id", "line_no", "content", "keyword").collect()]


def test_surface_counts(spark):
    df = spark.createDataFrame([(1, "token token"), (1, "TOKEN"), (2, "token")], "id int, text string")
    got = {r.surface: (r.occurrences, r.documents) for r in S.surface_counts(df, "id", ["token"]).collect()}
    assert got == {"token": (3, 2), "TOKEN": (1, 1)}
    assert F is not None
