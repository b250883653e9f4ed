"""Model-assisted scan, with a scorer that can be written in SQL as well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lineward.functions import scoring as S
from lineward.operators import scoring as M
from lineward.operators import tables as T
from lineward.plans import fixtures as X
from lineward.plans import sqltext as Q
from lineward.plans.keyword_queries import KW, KWT, contains_sql
from lineward.plans.registry import query
from lineward.plans.table_queries import cells_sql, keys_of

_BATCHES = f"""(SELECT doc_id, batch_no, batch_no * 10 AS start, lines, array_to_string(lines, chr(10)) AS batch_text
    FROM (SELECT doc_id, CAST(b AS INTEGER) AS batch_no, ls[b * 10 + 1 : b * 10 + 10] AS lines
          FROM (SELECT doc_id, ls, unnest(range((len(ls) + 9) // 10)) AS b
                FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
    WHERE {Q.strip("array_to_string(lines, chr(10))")} <> '')"""


def _docs(t):
    return t.documents.select("doc_id", "text")


def contains_scorer(keywords: list[str]):
    """Deterministic scorer: a keyword found as written in the prompt's text is a match with its surroundings."""
    begin = len(S.instruction(keywords)) + 1

    def apply(df):
        text = F.col("_asked")
        found = [
            F.when(F.lower(text).contains(k), F.struct(
                F.lit(k).alias("keyword"),
                F.substring(text, F.greatest(F.instr(F.lower(text), F.lit(k)) - 5, F.lit(1)), F.lit(130)).alias("context"),
                F.lit("as written").alias("reason"))) for k in keywords]
        hit = reduce(lambda a, b: a | b, [F.lower(text).contains(k) for k in keywords])
        answer = F.to_json(F.struct(hit.alias("has_sensitive"), F.array_compact(F.array(*found)).alias("matches")))
        asked = df.withColumn("_asked", F.expr(f"substring(prompt, {begin})"))
        return asked.withColumns({"response": answer, "error": F.lit(None).cast("string")}).drop("_asked")

    return apply


@query("llm_batches", f"SELECT doc_id, batch_no, start, batch_text FROM {_BATCHES}")
def llm_batches(t):
    return M.line_batches(_docs(t)).select("doc_id", "batch_no", "start", "batch_text")


_STEP = S.MAX_CHARS - S.OVERLAP_CHARS


def windows_sql(src: str, text: str) -> str:
    """Rows of ``src`` for each window of a text, with its number ``w`` and ``part``."""
    return f"""(SELECT *, substring({text}, 1 + w * {_STEP}, {S.MAX_CHARS}) AS part FROM (
        SELECT *, CAST(unnest(range(1 + greatest(0, CAST(ceil((length({text}) - {S.MAX_CHARS}) / {_STEP}.0) AS INTEGER)))) AS INTEGER) AS w
        FROM {src}))"""


@query("llm_truncate", f"SELECT doc_id, w AS window_no, part AS text FROM {windows_sql('documents', 'text')}")
def llm_truncate(t):
    """Texts too long for a request are not cut off but asked about in windows."""
    return t.documents.select("doc_id", F.inline(S.windows(F.col("text")))).withColumnRenamed("part", "text")


@query("llm_prompt", f"""
SELECT doc_id, w AS window_no, {Q.lit(S.instruction(KW))} || part AS prompt FROM {windows_sql('documents', 'text')}""")
def llm_prompt(t):
    return M.prompts(_docs(t), KW, "text").select("doc_id", "window_no", "prompt")


_WORDS = "regexp_replace(text, '[^a-zA-Z ]', '', 'g')"


@query("llm_parse", f"""
SELECT doc_id, doc_id % 5 IN (0, 1, 3) AS has_sensitive,
       CASE WHEN doc_id % 5 < 3 THEN 'json' ELSE 'inferred' END AS parse_status,
       CASE WHEN doc_id % 5 < 2 THEN 'k' || doc_id WHEN doc_id % 5 > 2 THEN 'unknown' END AS keyword,
       CASE WHEN doc_id % 5 < 2 THEN {_WORDS} WHEN doc_id % 5 = 3 THEN 'yes, true'
            WHEN doc_id % 5 = 4 THEN 'no {{broken}} x' END AS context
FROM documents
UNION ALL
SELECT 1000000 + event_id, FALSE, 'json', NULL, NULL FROM events""")
def llm_parse(t):
    props = t.events.select((F.col("event_id") + 1000000).alias("doc_id"), F.col("props").alias("response"))
    parsed = X.responses(t).unionByName(props).select("doc_id", S.parse(F.col("response")).alias("v"))
    first = F.get("v.matches", F.lit(0))
    return parsed.select("doc_id", "v.has_sensitive", "v.parse_status",
                         first["keyword"].alias("keyword"), first["context"].alias("context"))


def _context_sql(kw: str, text: str = "batch_text") -> str:
    return f"substring({text}, greatest(strpos(lower({text}), '{kw}') - 5, 1), 130)"


def _located_sql(context: str) -> str:
    def place(part: str) -> str:
        return f"nullif(list_position([contains(x, {part}) FOR x IN lines], TRUE), 0)"

    line = Q.strip(f"split_part({Q.strip(context)}, chr(10), 1)")
    short = Q.strip(f"substring({context}, 1, 30)")
    return f"""CAST(start + coalesce(CASE WHEN {line} <> '' THEN {place(line)} END,
        CASE WHEN {line} <> '' AND {short} <> '' THEN {place(short)} END, 1) AS INTEGER)"""


@query("llm_locate_line", f"""
SELECT doc_id, batch_no, i, {_located_sql('context')} AS line_no
FROM (SELECT *, CAST(generate_subscripts(lines, 1) AS INTEGER) AS i, unnest(lines) AS context FROM {_BATCHES})""")
def llm_locate_line(t):
    """Every line of every batch as a context."""
    asked = M.line_batches(_docs(t)).select("*", F.posexplode("lines").alias("_i", "_context"))
    return asked.select("doc_id", "batch_no", (F.col("_i") + 1).alias("i"), S.locate(F.col("lines"), F.col("start"), F.col("_context")).alias("line_no"))


_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, batch_no, w, start, lines, {i} AS pos, '{k}' AS keyword, {_context_sql(k, 'part')} AS context"
    f" FROM {windows_sql(_BATCHES, 'batch_text')} WHERE contains(lower(part), '{k}')" for i, k in enumerate(KW))


@query("llm_findings", f"""
SELECT doc_id, line_no, substring(context, 1, 120) AS content, keyword FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, keyword ORDER BY batch_no, w, pos) AS n
    FROM (SELECT *, {_located_sql('context')} AS line_no FROM ({_MATCHES})))
WHERE n = 1""")
def llm_findings(t):
    return M.scored_findings(_docs(t), "doc_id", KW, contains_scorer(KW))


_CELL_MATCHES = " UNION ALL ".join(
    f"SELECT tbl, field, record_id, w * 100 + {i} AS pos, '{k}' AS keyword, {_context_sql(k, 'part')} AS context"
    f" FROM {windows_sql(cells_sql('part', KWT), 'value')} WHERE contains(lower(part), '{k}')" for i, k in enumerate(KWT))


@query("llm_table_findings", f"""
SELECT tbl AS "table", field, record_id, string_agg(DISTINCT keyword, ', ' ORDER BY keyword) AS keyword,
       substring(arg_min(context, pos), 1, 120) AS content
FROM ({_CELL_MATCHES}) GROUP BY tbl, field, record_id""")
def llm_table_findings(t):
    part = T.TableSpec("part", t.part, keys_of("part"), unique_key=True)
    return M.table_findings(part, KWT, contains_scorer(KWT))
