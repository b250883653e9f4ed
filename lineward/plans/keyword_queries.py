"""Keyword matching core over the document and conversation texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineward.functions import keywords as K
from lineward.operators import keyword_scan as S
from lineward.operators import keyword_tables as T
from lineward.operators.numbering import number_rows
from lineward.plans import sqltext as Q
from lineward.plans.registry import query

# Keyword sets of the checked queries.
KW = ["token", "thing", "nicht", "erble", "mail"]
KW6 = ["password", "secret", "token", "key", "mail", "licen"]
KWT = ["red", "bolt", "urgent", "machinery"]


def contains_sql(cols: list[str], keywords: list[str]) -> str:
    return " OR ".join(f"contains(lower({c}), '{k}')" for c in cols for k in keywords)


@query("kw_parse", """
SELECT p_partkey, array_to_string([trim(x) FOR x IN string_split(p_name, ' ') IF x <> ''], '|') AS keywords,
       len([x FOR x IN string_split(p_name, ' ') IF x <> '']) AS n
FROM part""")
def kw_parse(t):
    parsed = K.parse_keywords_col(F.replace("p_name", F.lit(" "), F.lit(" ,, ")))
    return t.part.select("p_partkey", parsed.alias("kws")).select(
        "p_partkey", F.array_join("kws", "|").alias("keywords"),
        F.size("kws").cast("long").alias("n"))


@query("kw_pattern", f"""
SELECT item_id, regexp_extract_all(text, {Q.pattern(KW)})[1] AS first_match,
       regexp_matches(text, {Q.pattern(KW)}) AS hit
FROM benchmark""")
def kw_pattern(t):
    found = K.all_matches(F.col("text"), K.combined_pattern(KW))
    return t.benchmark.select(
        "item_id", F.get(found, F.lit(0)).alias("first_match"),
        K.has_match(F.col("text"), K.search_pattern(KW)).alias("hit"))


@query("lines_explode", f"SELECT doc_id, line_no, line FROM {Q.lines('documents', 'doc_id')}")
def lines_explode(t):
    return S.explode_lines(t.documents.select("doc_id", "text"))


@query("kw_rlike", f"SELECT doc_id, lang FROM documents WHERE regexp_matches(text, {Q.pattern(KW)})")
def kw_rlike(t):
    return S.matching_rows(t.documents, "text", KW).select("doc_id", "lang")


@query("kw_find_all", f"""
SELECT doc_id, line_no, array_to_string(ms, '|') AS matches
FROM {Q.matches('documents', 'doc_id', KW)}""")
def kw_find_all(t):
    found = S.matching_lines(t.documents.select("doc_id", "text"), KW)
    return found.select("doc_id", "line_no", F.array_join("matches", "|").alias("matches"))


@query("kw_match_explode", f"""
SELECT doc_id, line_no, CAST(generate_subscripts(ms, 1) AS INTEGER) AS ordinal, unnest(ms) AS surface
FROM {Q.matches('documents', 'doc_id', KW)}""")
def kw_match_explode(t):
    return S.explode_matches(t.documents.select("doc_id", "text"), KW)


@query("kw_surface_counts", f"""
SELECT surface, count(*) AS occurrences, count(DISTINCT doc_id) AS documents
FROM (SELECT doc_id, unnest(ms) AS surface FROM {Q.matches('documents', 'doc_id', KW)})
GROUP BY surface""")
def kw_surface_counts(t):
    return S.surface_counts(t.documents, "doc_id", KW)


@query("kw_context", f"""
SELECT doc_id, line_no, {Q.context(KW)} AS content FROM {Q.matches('documents', 'doc_id', KW)}""")
def kw_context(t):
    found = S.matching_lines(t.documents.select("doc_id", "text"), KW)
    return found.select("doc_id", "line_no",
                        K.context(F.col("line"), F.get("matches", F.lit(0))).alias("content"))


@query("kw_line_findings", f"""
SELECT doc_id, source, line_no, content, keyword FROM {Q.findings('documents', 'doc_id, source', KW)}""")
def kw_line_findings(t):
    return S.line_findings(t.documents.select("doc_id", "source", "text"), KW)


@query("kw_line_findings_sparse", f"""
SELECT doc_id, source, line_no, content, keyword FROM {Q.findings('documents', 'doc_id, source', KW6)}""")
def kw_line_findings_sparse(t):
    return S.line_findings(t.documents.select("doc_id", "source", "text"), KW6)


@query("kw_scan", f"""
SELECT 'd' || doc_id AS id, line_no, content, keyword FROM {Q.findings('documents', 'doc_id', KW)}
UNION ALL
SELECT 'c' || conv_id || '-' || turn, line_no, content, keyword
FROM {Q.findings('conversations', 'conv_id, turn', KW)}""")
def kw_scan(t):
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "text")
    turns = t.conversations.select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), "text")
    return S.scan(docs.unionByName(turns), "id", KW)


@query("kw_contains_any", f"""
SELECT 'part' AS tbl, p_partkey AS id FROM part WHERE {contains_sql(['p_name', 'p_brand', 'p_type'], KWT)}
UNION ALL
SELECT 'orders', o_orderkey FROM orders
WHERE {contains_sql(['o_orderstatus', 'o_orderpriority'], KWT)}""")
def kw_contains_any(t):
    parts = S.candidates(t.part, ["p_name", "p_brand", "p_type"], KWT)
    orders = S.candidates(t.orders, ["o_orderstatus", "o_orderpriority"], KWT)
    return parts.select(F.lit("part").alias("tbl"), F.col("p_partkey").alias("id")).unionAll(
        orders.select(F.lit("orders"), "o_orderkey"))


@query("kw_contains_pushed", """
SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') OR contains(p_name, 'bolt')""")
def kw_contains_pushed(t):
    return S.candidates(t.part, ["p_name"], ["red", "bolt"], ignore_case=False).select(
        "p_partkey", "p_name")


@query("kw_scan_two_stage", f"""
SELECT doc_id, line_no, content, keyword FROM {Q.findings(
    f"(SELECT doc_id, text FROM documents WHERE {contains_sql(['text'], KW)})", 'doc_id', KW)}""")
def kw_scan_two_stage(t):
    return S.two_stage_findings(t.documents.select("doc_id", "text"), KW)


@query("kw_fuzzy_prefilter", f"""
SELECT doc_id, line_no, content, keyword FROM {Q.findings('documents', 'doc_id', KW)}""")
def kw_fuzzy_prefilter(t):
    return S.prefiltered_findings(t.documents.select("doc_id", "text"), KW)


@query("kw_matched_containers", f"""
SELECT source, count(DISTINCT doc_id) AS matched FROM {Q.matches('documents', 'doc_id, source', KW)}
GROUP BY source""")
def kw_matched_containers(t):
    found = S.line_findings(t.documents.select("doc_id", "source", "text"), KW)
    return S.matched_containers(found, "doc_id", ["source"])


# Keyword tables: all words of six letters or more in the conversations, 13,000 at the scale of the SQL check.
_WORD_TABLE = "SELECT w AS keyword, row_number() OVER (ORDER BY w) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM conversations)"

#: Matches of all keywords, position by position over a trie of their beginnings; characters are numbered
#: through all lines, with breaks between lines that no gap bridges. Gaps are digits, so the least code has
#: the shortest gaps from left to right.
_TRIE_SQL = f"""
WITH RECURSIVE kw AS MATERIALIZED ({_WORD_TABLE}),
prefixes AS (SELECT p, substr(p, 1, length(p) - 1) AS parent, substr(p, length(p), 1) AS ch, row_number() OVER (ORDER BY p) AS node
             FROM (SELECT DISTINCT substr(keyword, 1, i) AS p FROM kw, unnest(range(1, length(keyword) + 1)) AS t(i))),
nodes AS MATERIALIZED (SELECT x.node, coalesce(y.node, 0) * 128 + ascii(x.ch) AS step, kw.ord FROM prefixes x LEFT JOIN prefixes y ON y.p = x.parent LEFT JOIN kw ON kw.keyword = x.p),
numbered AS MATERIALIZED (SELECT *, sum(length(line) + 4) OVER (ORDER BY doc_id, line_no) - length(line) - 4 AS base FROM {Q.lines('documents', 'doc_id')}),
chars AS MATERIALIZED (SELECT CAST(base + i AS BIGINT) AS pos, ascii(ch) AS ch FROM (
    SELECT base, generate_subscripts(string_split(lower(line), ''), 1) AS i, unnest(string_split(lower(line), '')) AS ch FROM numbered)
    WHERE ch BETWEEN 'a' AND 'z'),
nexts AS MATERIALIZED (SELECT pos - gap AS pos, gap, ch FROM chars, unnest([1, 2, 3]) AS g(gap)),
path AS (
    SELECT pos AS start, pos, node, '' AS code FROM chars JOIN nodes ON step = ch
    UNION ALL
    SELECT p.start, p.pos + x.gap, n.node, p.code || x.gap FROM path p JOIN nexts x ON x.pos = p.pos JOIN nodes n ON n.step = p.node * 128 + x.ch),
first AS MATERIALIZED (SELECT start, unnest(min({{'ord': ord, 'code': code, 'stop': pos + 1}})) FROM path JOIN nodes USING (node) WHERE ord IS NOT NULL GROUP BY start),
placed AS MATERIALIZED (SELECT doc_id, line_no, line, base, start, stop, ord FROM first ASOF JOIN numbered ON start > base),
following AS MATERIALIZED (SELECT a.doc_id, a.line_no, a.start, b.start AS next FROM placed a ASOF LEFT JOIN placed b
                           ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.start >= a.stop),
taken AS (
    SELECT doc_id, line_no, min(start) AS start FROM placed GROUP BY ALL
    UNION ALL
    SELECT f.doc_id, f.line_no, f.next FROM taken t JOIN following f USING (doc_id, line_no, start) WHERE f.next IS NOT NULL),
matches AS (SELECT doc_id, line_no, line, start - base AS place, ord, substr(line, CAST(start - base AS BIGINT), CAST(stop - start AS BIGINT)) AS surface
            FROM taken JOIN placed USING (doc_id, line_no, start))"""


def _word_table(t):
    words = t.conversations.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("keyword")).distinct()
    return T.keyword_table(number_rows(words, ["keyword"], "ord"))


@query("kw_table_findings", _TRIE_SQL + f"""
SELECT doc_id, line_no, CASE WHEN length(line) <= 120 THEN line ELSE
        CASE WHEN pre > 40 THEN '...' ELSE '' END || substring(line, greatest(0, pre - 40) + 1,
            least(length(line), pre + length(ms[1]) + 40) - greatest(0, pre - 40))
        || CASE WHEN pre + length(ms[1]) + 40 < length(line) THEN '...' ELSE '' END END AS content, {Q.joined('ms')} AS keyword
FROM (SELECT doc_id, line_no, line, list(surface ORDER BY place) AS ms, CAST(min(place) - 1 AS BIGINT) AS pre FROM matches GROUP BY doc_id, line_no, line)""")
def kw_table_findings(t):
    return T.line_findings(t.documents.select("doc_id", "text"), _word_table(t))


@query("kw_table_counts", _TRIE_SQL + """
SELECT keyword, count(doc_id) AS occurrences, count(DISTINCT doc_id) AS documents FROM kw LEFT JOIN matches USING (ord) GROUP BY keyword""")
def kw_table_counts(t):
    return T.keyword_counts(t.documents, "doc_id", _word_table(t))
