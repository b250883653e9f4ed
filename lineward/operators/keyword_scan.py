"""Keyword matching over a text column.

Every operator here is row-wise up to its final aggregate: no shuffle is needed to go from texts
to line findings, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.functions import keywords as K

LINE_COLUMNS = ["line_no", "content", "keyword"]


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per non-blank line; numbers count blank lines too."""
    others = [c for c in df.columns if c != text]
    parts = df.select(*others, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_pos", "_raw"))
    return parts.select(
        *others, (F.col("_pos") + 1).alias("line_no"), K.strip(F.col("_raw")).alias("line")
    ).where(F.col("line") != "")


def matching_rows(df: DataFrame, column: str, keywords: list[str]) -> DataFrame:
    """Rows whose text holds a fuzzy match."""
    pattern = K.search_pattern(keywords)
    return df.where(K.has_match(F.col(column), pattern) if pattern else F.lit(False))


def matching_lines(df: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """Lines with a match, as ``line_no``, ``line`` and the array ``matches``.

    A match never spans a line feed, so texts without any match are not split at all, and lines
    are only trimmed once they are known to hold one. The test of the whole text is part of the
    generator and not a filter, which would be pushed down and make a computed text be computed twice.
    """
    pattern = K.search_pattern(keywords)
    others = [c for c in df.columns if c != text]
    if pattern is None:
        pattern, df = "x", df.where(F.lit(False))
    split = F.when(K.has_match(F.col(text), pattern), F.split(F.col(text), "\n", -1))
    raw = df.select(*others, F.posexplode(split).alias("_pos", "_raw")).where(
        K.has_match(F.col("_raw"), pattern))
    lines = raw.select(
        *others, (F.col("_pos") + 1).alias("line_no"), K.strip(F.col("_raw")).alias("line")
    )
    found = lines.withColumn("matches", K.all_matches(F.col("line"), pattern))
    return found.where(F.size("matches") > 0) if K.is_padded(keywords) else found


def explode_matches(df: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """One row per match: ``ordinal`` within the line and the ``surface`` text."""
    found = matching_lines(df, keywords, text)
    keep = [c for c in found.columns if c not in ("line", "matches")]
    return found.select(*keep, F.posexplode("matches").alias("_ord", "surface")).select(
        *keep, (F.col("_ord") + 1).alias("ordinal"), "surface"
    )


def surface_counts(df: DataFrame, id_col: str, keywords: list[str], text: str = "text") -> DataFrame:
    """Occurrences and distinct documents per surface text.

    Counted per (surface, document) first, which spreads even a surface text that most documents
    share; the second, tiny aggregate adds the partial counts up.
    """
    per_doc = (
        explode_matches(df.select(id_col, text), keywords, text)
        .groupBy("surface", id_col).agg(F.count("*").alias("n"))
    )
    return per_doc.groupBy("surface").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("documents")
    )


def line_findings(df: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """``line_no``, ``content`` and the joined distinct surface texts of every matching line."""
    found = matching_lines(df, keywords, text)
    keep = [c for c in found.columns if c not in ("line_no", "line", "matches")]
    return found.select(
        *keep, "line_no",
        K.context(F.col("line"), F.get("matches", F.lit(0))).alias("content"),
        K.joined_forms(F.col("matches")).alias("keyword"),
    )


def scan(df: DataFrame, id_col: str, keywords: list[str], text: str = "text",
         method: str | Callable = "regex") -> DataFrame:
    """Scan with the pattern, or with a scorer given as ``method``; same columns either way."""
    if method == "regex":
        return line_findings(df.select(id_col, text), keywords, text)
    from lineward.operators.scoring import scored_findings

    return scored_findings(df.select(id_col, text), id_col, keywords, method, text)


def candidates(df: DataFrame, columns: list[str], keywords: list[str],
               ignore_case: bool = True) -> DataFrame:
    """Coarse literal filter: some column contains some keyword as written."""
    return df.where(K.contains_any([F.col(c) for c in columns], keywords, ignore_case))


def two_stage_findings(df: DataFrame, keywords: list[str], text: str = "text",
                       ignore_case: bool = True) -> DataFrame:
    """Coarse filter, then the fuzzy match on the survivors.

    Rows with only a spaced-out variant never become candidates.
    """
    return line_findings(candidates(df, [text], keywords, ignore_case), keywords, text)


def prefiltered_findings(df: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """Line findings behind the character-occurrence filter, which loses nothing.

    Pays off for scripts without letter case and for rare characters.
    """
    return line_findings(df.where(K.may_match(F.col(text), keywords)), keywords, text)


def matched_containers(findings: DataFrame, container: str, by: list[str] | None = None) -> DataFrame:
    """Number of distinct containers with a finding."""
    return findings.groupBy(*(by or [])).agg(F.countDistinct(container).alias("matched"))
