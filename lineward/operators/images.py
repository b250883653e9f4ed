"""Images: inventory, content-keyed recognition cache, findings in recognised text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineward.functions import files as P
from lineward.functions.images import MIN_CONFIDENCE
from lineward.operators.keyword_scan import line_findings
from lineward.session import ensure_checkpoint_dir
from lineward.schemas import OCR_ITEM


def inventory(files: DataFrame, path: str = "image_path") -> DataFrame:
    """Image files with extension, directory and file name."""
    p = F.col(path)
    return files.withColumns({"ext": P.ext(p), "directory": P.directory(p), "filename": P.base_name(p)}
                             ).where(F.col("ext").isin(P.IMAGE_EXTS))


def type_counts(images: DataFrame) -> DataFrame:
    return images.groupBy("ext").agg(F.count("*").alias("n"))


def with_md5(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("md5", F.md5(F.col(content)))


def cache_hits(images: DataFrame, cache: DataFrame) -> DataFrame:
    """Images whose content was recognised before, with the stored items."""
    return images.join(cache.select("md5", "ocr_items"), "md5")


def cache_misses(images: DataFrame, cache: DataFrame, path: str = "image_path") -> DataFrame:
    """One image per distinct unknown content, so that copies are recognised once.

    The copies are merged before the shuffle, however many there are.
    """
    unknown = images.join(cache.select("md5"), "md5", "left_anti")
    return unknown.groupBy("md5").agg(F.min(path).alias(path))


def cache_split(images: DataFrame, cache: DataFrame, path: str = "image_path") -> DataFrame:
    """``md5, path, known, ocr_items``: every image with stored items, and one image for each unknown content.

    One join and one aggregate: known images are groups of their own, unknown ones are merged by their content.
    """
    stored = cache.select("md5", "ocr_items", F.lit(True).alias("known"))
    joined = images.select("md5", path).join(stored, "md5", "left")
    own = F.when(F.col("known"), F.col(path))
    return joined.groupBy("md5", own.alias("_own")).agg(
        F.min(path).alias(path), F.coalesce(F.first("known"), F.lit(False)).alias("known"), F.first("ocr_items").alias("ocr_items")).drop("_own")


def apply_results(images: DataFrame, results: DataFrame) -> DataFrame:
    """``md5, ocr_items, failed`` from recognition results stored by content, ``results(md5, ocr_items)``.

    A content without a result counts as failed and has no items.
    """
    found = images.select("md5").join(results.select("md5", "ocr_items"), "md5", "left")
    empty = F.array().cast(found.schema["ocr_items"].dataType)
    return found.select("md5", F.coalesce("ocr_items", empty).alias("ocr_items"), F.col("ocr_items").isNull().alias("failed"))


def cache_counts(images: DataFrame, cache: DataFrame) -> DataFrame:
    known = cache.select("md5", F.lit(True).alias("_known"))
    return images.join(known, "md5", "left").agg(
        F.count("*").alias("total"), F.count_if("_known").alias("hits"),
        F.countDistinct(F.when(F.col("_known").isNull(), F.col("md5"))).alias("to_read"))


def apply_ocr(images: DataFrame, make_engine: Callable[[], Callable], source: str = "image_path") -> DataFrame:
    """Recognise the text of every row: ``md5, ocr_items, failed``.

    ``make_engine`` builds the recogniser once per task; it takes the ``source`` value (a path or
    the bytes) and returns (text, confidence[, position]) items. A failing image yields no items.
    """
    schema = "md5 string, ocr_items array<struct<text:string,confidence:double,position:string>>, failed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        for pdf in batches:
            items, failed = [], []
            for value in pdf[source]:
                try:
                    found = [(i[0], float(i[1]), i[2] if len(i) > 2 else "") for i in engine(value) or []]
                    failed.append(False)
                except Exception:  # one unreadable image must not stop the others
                    found = []
                    failed.append(True)
                items.append([dict(zip(OCR_ITEM.names, f)) for f in found])
            yield pd.DataFrame({"md5": pdf["md5"], "ocr_items": items, "failed": failed})

    return images.select("md5", source).mapInPandas(run, schema)


def explode_items(images: DataFrame) -> DataFrame:
    """One row per recognised item; entries without a position get an empty one."""
    others = [c for c in images.columns if c != "ocr_items"]
    return images.select(*others, F.inline("ocr_items")).withColumn(
        "position", F.coalesce("position", F.lit("")))


def confident(items: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    return items.where(F.col("confidence") >= threshold)


def findings(items: DataFrame, keywords: list[str], threshold: float = MIN_CONFIDENCE,
             path: str = "image_path") -> DataFrame:
    """Findings per recognised item: path, directory, file name, position, text and keyword."""
    kept = confident(items, threshold).select(
        path, P.directory(F.col(path)).alias("directory"), P.base_name(F.col(path)).alias("filename"),
        "position", "text")
    return line_findings(kept, keywords).drop("line_no").withColumnRenamed("content", "ocr_text")


def summary(images: DataFrame, found: DataFrame, path: str = "image_path") -> DataFrame:
    """Number of images and of images with findings."""
    rows = images.select(path, F.lit(True).alias("_image")).unionAll(
        found.select(path, F.lit(False)))
    return rows.agg(
        F.count_if("_image").alias("total_images"),
        F.countDistinct(F.when(~F.col("_image"), F.col(path))).alias("matched_images"))


def scan(images: DataFrame, cache: DataFrame, make_engine: Callable[[], Callable],
         keywords: list[str], path: str = "image_path") -> tuple[DataFrame, DataFrame]:
    """Findings of all images and the cache entries to add.

    Empty results are stored too, failures are not. What was read is checkpointed, as both results use
    it and a recogniser is costly.
    """
    ensure_checkpoint_dir(images.sparkSession)
    read = apply_ocr(cache_misses(images, cache, path), make_engine, path).checkpoint()
    entries = read.where("not failed").select("md5", "ocr_items")
    items = explode_items(cache_hits(images, cache.select("md5", "ocr_items").unionByName(entries)))
    return findings(items, keywords, path=path), entries
