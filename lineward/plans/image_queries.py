"""Images and recognised text, derived from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineward.functions.images import position
from lineward.operators import images as I
from lineward.plans import fixtures as X
from lineward.plans import sqltext as Q
from lineward.plans.keyword_queries import KW
from lineward.plans.registry import query


def _md5_images(t):
    return I.with_md5(X.images(t)).drop("content")


_KNOWN = f"(SELECT DISTINCT md5 FROM {X.IMAGES_SQL} WHERE conv_id % 2 = 0)"


@query("img_inventory", f"""
SELECT image_path, regexp_extract(image_path, '(\\.[a-z]+)$', 1) AS ext, '/img/' || (conv_id % 7) AS directory,
       split_part(image_path, '/', 4) AS filename FROM {X.IMAGES_SQL}""")
def img_inventory(t):
    return I.inventory(X.images(t)).select("image_path", "ext", "directory", "filename")


@query("img_type_counts", f"""
SELECT regexp_extract(image_path, '(\\.[a-z]+)$', 1) AS ext, count(*) AS n FROM {X.IMAGES_SQL} GROUP BY 1""")
def img_type_counts(t):
    return I.type_counts(I.inventory(X.images(t)))


@query("img_md5", f"SELECT image_path, md5 FROM {X.IMAGES_SQL}")
def img_md5(t):
    return _md5_images(t).select("image_path", "md5")


@query("img_cache_split", f"""
SELECT i.md5, image_path, text AS stored FROM {X.IMAGES_SQL} i WHERE md5 IN {_KNOWN}
UNION ALL
SELECT md5, min(image_path), NULL FROM {X.IMAGES_SQL} WHERE md5 NOT IN {_KNOWN} GROUP BY md5""")
def img_cache_split(t):
    split = I.cache_split(_md5_images(t), X.img_cache(t))
    return split.select("md5", "image_path", F.get("ocr_items", F.lit(0))["text"].alias("stored"))


@query("img_cache_counts", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE md5 IN {_KNOWN}) AS hits,
       count(DISTINCT CASE WHEN md5 NOT IN {_KNOWN} THEN md5 END) AS to_read FROM {X.IMAGES_SQL}""")
def img_cache_counts(t):
    return I.cache_counts(_md5_images(t), X.img_cache(t))


def _items(t):
    placed = position(F.col("y_top"), F.col("y_bottom"), F.col("height"))
    return X.ocr_items(t).select("image_path", "text", "confidence", placed.alias("position"))


@query("img_position", f"SELECT image_path, text, position FROM {X.OCR_SQL}")
def img_position(t):
    return _items(t).select("image_path", "text", "position")


@query("img_conf_filter", f"SELECT image_path, text FROM {X.OCR_SQL} WHERE confidence >= 0.7")
def img_conf_filter(t):
    return I.confident(_items(t)).select("image_path", "text")


_FOUND = Q.findings(f"(SELECT * FROM {X.OCR_SQL} WHERE confidence >= 0.7)", "image_path, position", KW)


@query("img_findings", f"""
SELECT image_path, regexp_extract(image_path, '^(.*)/', 1) AS directory,
       split_part(image_path, '/', 4) AS filename, position, content AS ocr_text, keyword FROM {_FOUND}""")
def img_findings(t):
    return I.findings(_items(t), KW)


@query("img_summary", f"""
SELECT (SELECT count(*) FROM {X.IMAGES_SQL}) AS total_images, count(DISTINCT image_path) AS matched_images
FROM {_FOUND}""")
def img_summary(t):
    return I.summary(I.inventory(X.images(t)), I.findings(_items(t), KW))
