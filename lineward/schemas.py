"""Schemas of states and results that have a fixed shape."""

from pyspark.sql import types as T

LINE_FINDING = T.StructType([
    T.StructField("line_no", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("keyword", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("module", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("locator", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("from_cache", T.BooleanType()),
    T.StructField("method", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("etag", T.StringType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

PAGE_STATE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("etag", T.StringType()),
    T.StructField("last_modified", T.StringType()),
    T.StructField("last_checked", T.TimestampType()),
    T.StructField("links", T.ArrayType(T.StringType())),
    T.StructField("findings", T.ArrayType(LINE_FINDING)),
])

OCR_ITEM = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("position", T.StringType()),
])

OCR_CACHE = T.StructType([
    T.StructField("md5", T.StringType()),
    T.StructField("ocr_items", T.ArrayType(OCR_ITEM)),
])

MATCH = T.StructType([
    T.StructField("keyword", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("reason", T.StringType()),
])

ENC_REGISTRY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("matched", T.LongType()),
])
