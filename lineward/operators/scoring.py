"""Model-assisted scan: batches of lines go to a scorer, its answers become findings.

A scorer is a function from a frame with a ``prompt`` column to the same frame with ``response`` and
``error`` added. ``python_scorer`` makes one from a plain function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineward.functions import scoring as S
from lineward.functions.keywords import strip
from lineward.operators import tables as B

Scorer = Callable[[DataFrame], DataFrame]


def python_scorer(make: Callable[[], Callable[[str], str]]) -> Scorer:
    """Call a function per prompt, built once per task. A failure is a value, not an exception."""

    def apply(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [
            T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()
            for pdf in frames:
                answers, errors = [], []
                for text in pdf["prompt"]:
                    try:
                        answers.append(call(text))
                        errors.append(None)
                    except Exception as e:  # one failing request must not stop the scan
                        answers.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pdf.assign(response=answers, error=errors)

        return df.mapInPandas(run, schema)

    return apply


def line_batches(df: DataFrame, text: str = "text") -> DataFrame:
    """Runs of ten raw lines as ``batch_no, start, lines, batch_text``; blank runs are dropped."""
    others = [c for c in df.columns if c != text]
    split = df.select(*others, F.posexplode(S.batches(F.col(text))).alias("batch_no", "_b"))
    return split.select(
        *others, "batch_no", F.col("_b.start").alias("start"), F.col("_b.lines").alias("lines"),
        F.array_join("_b.lines", "\n").alias("batch_text")
    ).where(strip(F.col("batch_text")) != "")


def stored_scorer(answers: DataFrame) -> Scorer:
    """Answers that were given before, looked up by the md5 of the prompt: ``answers(prompt_key, response)``."""
    known = answers.groupBy("prompt_key").agg(F.min("response").alias("response"))

    def apply(df: DataFrame) -> DataFrame:
        asked = df.withColumn("prompt_key", F.md5("prompt")).join(known, "prompt_key", "left").drop("prompt_key")
        return asked.withColumn("error", F.when(F.col("response").isNull(), "no stored answer"))

    return apply


def prompts(batches: DataFrame, keywords: list[str], text: str = "batch_text") -> DataFrame:
    """A row for each request: long texts are asked about in overlapping windows, ``window_no`` from 0."""
    split = batches.select("*", F.inline(S.windows(F.col(text))))
    return split.withColumn("prompt", S.prompt(F.col("part"), keywords)).drop("part")


def verdicts(scored: DataFrame) -> DataFrame:
    """Answers read; requests that failed are left out."""
    return scored.where(F.col("error").isNull()).withColumn("verdict", S.parse(F.col("response")))


def batch_findings(scored: DataFrame, ids: list[str]) -> DataFrame:
    """Findings of scored batches, the first discovered per line and keyword.

    The first one is found by a minimum, which is taken before rows are shuffled.
    """
    positive = F.when(F.col("verdict.has_sensitive"), F.col("verdict.matches"))
    hits = verdicts(scored).select(
        *ids, "batch_no", "window_no", "start", "lines", F.posexplode(positive).alias("_pos", "_m"))
    placed = hits.select(
        *ids, "batch_no", "window_no", "_pos", S.locate(F.col("lines"), F.col("start"), F.col("_m.context")).alias("line_no"),
        F.left(F.col("_m.context"), F.lit(S.CONTENT_CHARS)).alias("content"), F.col("_m.keyword").alias("keyword"))
    first = F.min(F.struct("batch_no", "window_no", "_pos", "content"))
    return placed.groupBy(*ids, "line_no", "keyword").agg(first.alias("_first")).select(
        *ids, "line_no", F.col("_first.content").alias("content"), "keyword")


def scored_findings(df: DataFrame, id_col: str, keywords: list[str], scorer: Scorer,
                    text: str = "text") -> DataFrame:
    """Scan with a scorer instead of the pattern."""
    asked = prompts(line_batches(df.select(id_col, text), text), keywords)
    return batch_findings(scorer(asked), [id_col])


def table_findings(spec: B.TableSpec, keywords: list[str], scorer: Scorer,
                   ignore_case: bool = True) -> DataFrame:
    """Score every text cell of the candidate rows.

    Per (table, field, record): the distinct keywords, and the first context. A positive answer
    without matches still reports the record.
    """
    rows = B.select_text(B.candidates(spec.df, keywords, ignore_case), spec.keys)
    texts = B.text_columns(spec.df)
    if spec.keys:
        rows = rows.select(B.record_key(spec.keys).alias("_key"),
                           B.record_id(list(spec.keys)).alias("record_id"), *texts)
    else:
        rows = B.with_record_id(rows, []).withColumn("_key", F.array("record_id"))
    asked = prompts(
        B.cells(rows, ["_key", "record_id"], texts).where(strip(F.col("value")) != ""), keywords, "value")
    positive = F.when(F.col("verdict.has_sensitive"), F.array("verdict"))
    said = verdicts(scorer(asked)).select("_key", "record_id", "field", "window_no", F.explode(positive).alias("verdict"))
    contexts = F.filter(F.col("verdict.matches.context"), lambda c: c != "")
    content = F.left(F.get(contexts, F.lit(0)), F.lit(S.CONTENT_CHARS))
    # Windows of a cell, and cells of one key, are merged; what is positive is little.
    found = said.groupBy("_key", "record_id", "field").agg(
        F.flatten(F.collect_set("verdict.matches.keyword")).alias("_kws"),
        F.min(F.when(content.isNotNull(), F.struct("window_no", content.alias("content")))).alias("_first"))
    found = found.withColumn("content", F.coalesce("_first.content", F.lit("")))
    return found.select(
        F.lit(spec.name).alias("table"), "field", "record_id",
        F.array_join(F.array_sort(F.array_distinct("_kws")), ", ").alias("keyword"), "content")
