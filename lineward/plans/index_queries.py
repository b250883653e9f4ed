"""Documents written as indexed files and as text files, read back with less or in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lineward.plans import sqltext as Q
from lineward.plans.keyword_queries import KW
from lineward.plans.registry import query
from lineward.session import ensure_checkpoint_dir
from lineward.sources import line_files as N
from lineward.sources import skip_index as K

#: Of the languages of the documents only some can hold these.
KW_SKIP = ["nicht", "über", "password"]


def _folder(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{uuid.uuid4().hex}"


def indexed_documents(t) -> str:
    """The documents in files by language and source, with their index."""
    path = _folder(t)
    t.documents.repartition("lang", "source").write.partitionBy("lang", "source").parquet(path)
    K.build_index(t.spark, path)
    return path


@query("kw_skip_index", f"SELECT doc_id, line_no, content, keyword FROM {Q.findings('documents', 'doc_id', KW_SKIP)}")
def kw_skip_index(t):
    return K.indexed_findings(t.spark, indexed_documents(t), ["doc_id"], KW_SKIP)


@query("kw_skip_index_files", f"SELECT DISTINCT lang, source FROM documents WHERE regexp_matches(text, {Q.pattern(KW_SKIP)})")
def kw_skip_index_files(t):
    """Language and source of the files with a finding: none of them is skipped."""
    path = indexed_documents(t)
    return K.pruned_read(t.spark, path, KW_SKIP).select(F.col("text"), F.regexp_extract(F.input_file_name(), "lang=([^/]+)/", 1).alias("lang"), F.regexp_extract(
        F.input_file_name(), "source=([^/]+)/", 1).alias("source")).where(F.col("text").rlike(K.K.search_pattern(KW_SKIP))).select("lang", "source").distinct()


def _text_files(t) -> str:
    """A text file for each source, documents in order."""
    path = _folder(t)
    rows = t.documents.select("source", "doc_id", F.col("text").alias("value"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(path)
    return path


_FILES = "(SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source)"


def _source():
    return F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source")


@query("lines_explode_files", f"SELECT source, CAST(line_no AS BIGINT) AS line_no, line FROM {Q.lines(_FILES, 'source')}")
def lines_explode_files(t):
    return N.file_lines(t.spark, [_text_files(t)]).select(_source(), "line_no", "line")


@query("kw_line_findings_files", f"SELECT source, CAST(line_no AS BIGINT) AS line_no, content, keyword FROM {Q.findings(_FILES, 'source', KW)}")
def kw_line_findings_files(t):
    return N.file_findings(t.spark, [_text_files(t)], KW).select(_source(), "line_no", "content", "keyword")
