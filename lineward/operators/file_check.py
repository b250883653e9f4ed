"""Check of a collection of files as one pass: types, statuses, findings and counters together.

Files are read once. What is known of a file afterwards is a short row with its findings as an array, which is written;
counters are observed while that happens, and every other result is read from those rows. Archives are opened in
a second pass over the archives alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lineward.functions import files as P
from lineward.operators import files as L
from lineward.operators import web as W
from lineward.session import ensure_checkpoint_dir


@dataclass
class FileCheck:
    """files: a row for each file with status, reason and findings. members: findings inside archives. counts: the counters."""

    files: DataFrame
    members: DataFrame | None
    counts: dict[str, int]

    def findings(self) -> DataFrame:
        """path, file_type, line_no, content, keyword of documents and of members of archives."""
        own = self.files.select("path", F.col("detected_ext").alias("file_type"), F.inline("findings"))
        return own if self.members is None else own.unionByName(self.members.select(own.columns))

    def summary(self) -> DataFrame:
        """The counters as one row."""
        spark = self.files.sparkSession
        return spark.createDataFrame([tuple(self.counts.values())], ", ".join(f"{c} long" for c in self.counts))

    def registry(self) -> DataFrame:
        """Encrypted documents and archives, all still locked."""
        return L.encryption_registry(self.files, self.files.where("route = 'archive'").select("path", "ext", "status"))

    def type_counts(self) -> DataFrame:
        return L.type_counts(self.files)


def check_files(files: DataFrame, keywords: list[str], expand: bool = False,
                extractors: dict[str, list[Callable]] | None = None) -> FileCheck:
    """Check ``files(path, content, size)``.

    With columns ``text`` and ``extract_status`` the files count as extracted already; without, they are extracted with
    ``extractors`` and the built-in ones. ``expand`` opens archives and scans their members; an archive with a finding
    is a matched file.
    """
    spark = files.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    typed = L.with_types(files)
    archive = F.col("route") == "archive"
    state = F.when(archive, L.archive_status(F.col("ext"), "content"))
    if "text" in files.columns:
        judged = L.with_status(typed.withColumn("archive_status", state))
    else:
        judged = L.with_status(L.extract(typed.withColumn("archive_status", state), extractors))
    document = F.col("route") == "document"
    readable = document & F.col("scanned")
    rows = judged.select(
        "path", "ext", "route", "detected_ext", "is_hidden", F.when(archive, F.col("archive_status")).otherwise(F.col("status")).alias("status"),
        F.when(document, F.col("reason")).alias("reason"),
        F.when(readable, W.finding_array(F.col("text"), keywords)).otherwise(W.finding_array(F.lit(""), keywords)).alias("findings"))
    seen = Observation()
    locked, damaged, hit = F.col("status") == L.ENCRYPTED, F.col("status") == L.DAMAGED, F.size("findings") > 0
    rows.observe(
        seen, F.count_if(document).alias("supported_files"), F.count_if(hit).alias("matched_files"),
        F.count_if(document & locked).alias("encrypted_files"), F.count_if(document & damaged).alias("damaged_files"),
        F.count_if("is_hidden").alias("hidden_files"), F.count_if(archive).alias("archives_scanned"),
        F.count_if(archive & locked).alias("encrypted_archives"), F.sum(F.size("findings")).alias("findings"),
    ).write.parquet(folder)
    counts = {c: n or 0 for c, n in seen.get.items()}
    members = None
    if expand:
        inside, _ = L.expand_archives(files.where(P.route(P.ext(F.col("path"))) == "archive").select("path", "content").checkpoint())
        members = L.member_findings(inside, keywords, extractors).checkpoint()
        more = members.agg(F.count_distinct("path").alias("files"), F.count("*").alias("n")).first()
        counts["matched_files"] += more["files"]
        counts["findings"] += more["n"]
    return FileCheck(spark.read.parquet(folder), members, counts)
