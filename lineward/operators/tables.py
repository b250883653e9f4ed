"""Scan of relational tables: text columns, coarse filter, cell findings and statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineward.functions import keywords as K
from lineward.operators.numbering import number_rows

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_SKIPPED = (T.NumericType, T.BooleanType, T.BinaryType)


@dataclass(frozen=True)
class TableSpec:
    """A table to scan. ``unique_key`` states that ``keys`` identify a row, as a primary key does;
    its findings then need no shuffle."""

    name: str
    df: DataFrame
    keys: tuple[str, ...] = ()
    unique_key: bool = False
    source_id: str = ""


def text_columns(df: DataFrame) -> list[str]:
    """Columns scanned as text: everything but numbers, booleans and binary."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, _SKIPPED)]


def skipped_columns(df: DataFrame) -> list[str]:
    return [f"{f.name}({f.dataType.simpleString()})" for f in df.schema.fields
            if isinstance(f.dataType, _SKIPPED)]


def as_text(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name)
    return F.to_json(name) if isinstance(kind, _NESTED) else F.col(name).cast("string")


def select_text(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """The kept columns and every text column, the latter as strings."""
    texts = text_columns(df)
    kept = [c for c in keep if c not in texts]
    return df.select(*kept, *[as_text(df, c).alias(c) for c in texts])


def _strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def inventory(specs: list[TableSpec]) -> DataFrame:
    """Row count and column lists of every table."""
    return _union(
        s.df.agg(F.count("*").alias("row_count")).select(
            F.lit(s.name).alias("table"), "row_count",
            _strings(s.df.columns).alias("columns"),
            _strings(text_columns(s.df)).alias("text_columns"),
            _strings(skipped_columns(s.df)).alias("skipped_columns"),
            _strings(s.keys).alias("pk_columns"))
        for s in specs)


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _is_candidate(df: DataFrame, keywords: list[str], ignore_case: bool, prefilter: str) -> Column:
    texts = [as_text(df, c) for c in text_columns(df)]
    if prefilter == "fuzzy":
        pattern = K.search_pattern(keywords)
        tests = [K.has_match(c, pattern) for c in texts] if pattern else []
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    return K.contains_any(texts, keywords, ignore_case)


def candidates(df: DataFrame, keywords: list[str], ignore_case: bool = True,
               prefilter: str = "fuzzy") -> DataFrame:
    """Rows where some text column contains some keyword.

    ``prefilter='fuzzy'`` loses nothing. ``'exact'`` looks for keywords as written, which a source can do
    itself, so that spaced-out variants only show up in rows that also hold an exact keyword.
    """
    return df.where(_is_candidate(df, keywords, ignore_case, prefilter))


def record_key(keys: Iterable[str]) -> Column:
    return F.array(*[F.col(k).cast("string") for k in keys])


def record_id(keys: list[str]) -> Column:
    """One key as is; several joined by ``-`` with nulls spelled out."""
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    return F.concat_ws("-", *[F.coalesce(F.col(k).cast("string"), F.lit("None")) for k in keys])


def with_record_id(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Add ``record_id``. Without a key it is the 1-based position in the order of ``order``
    (all columns by default), counted over the whole table without gathering it in one task."""
    if keys:
        return df.withColumn("record_id", record_id(keys))
    numbered = number_rows(df, order or df.columns, "record_id")
    return numbered.withColumn("record_id", F.col("record_id").cast("string"))


def hash_record_id(df: DataFrame) -> DataFrame:
    """Content hash as id, for keyless tables where a number would cost a sort."""
    return df.withColumn("record_id", F.md5(F.to_json(F.struct("*"))))


def cells(df: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per non-null text cell: the ids, ``field`` and ``value``."""
    columns = columns or [c for c in text_columns(df) if c not in ids]
    flat = df.select(*ids, *[as_text(df, c).alias(f"_v{i}") for i, c in enumerate(columns)])
    pairs = [F.struct(F.lit(c).alias("field"), F.col(f"_v{i}").alias("value"))
             for i, c in enumerate(columns)]
    return flat.select(*ids, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def cell_keywords(value: Column, pattern: str) -> Column:
    """Array of the joined surface texts of each matching line of a cell."""
    lines = F.filter(F.split(value, "\n", -1), lambda x: K.has_match(x, pattern))
    per_line = F.transform(lines, lambda x: K.joined_forms(K.all_matches(K.strip(x), pattern)))
    return F.array_distinct(F.filter(per_line, lambda x: x != ""))


_FINDING = "table string, field string, record_id string, keyword string"


def findings(spec: TableSpec, keywords: list[str], ignore_case: bool = True,
             prefilter: str = "fuzzy") -> DataFrame:
    """Findings per (table, field, record id), surface texts of all lines of a cell united.

    Equal ids of a key that is not unique are merged after a map-side ``distinct``.
    """
    pattern, texts = K.search_pattern(keywords), text_columns(spec.df)
    if pattern is None or not texts:
        return spec.df.sparkSession.createDataFrame([], _FINDING)
    rows = candidates(spec.df, keywords, ignore_case, prefilter)
    values = select_text(rows, spec.keys)
    if spec.keys:
        values = values.select(
            record_key(spec.keys).alias("_key"), record_id(list(spec.keys)).alias("record_id"), *texts)
    else:
        values = with_record_id(values, []).withColumn("_key", F.array("record_id"))
    found = (
        cells(values, ["_key", "record_id"], texts)
        .where(K.has_match(F.col("value"), pattern))
        .select("_key", "record_id", "field", cell_keywords(F.col("value"), pattern).alias("_kws"))
    )
    if K.is_padded(keywords):
        found = found.where(F.size("_kws") > 0)
    if not (spec.unique_key or not spec.keys):
        found = (
            found.select("_key", "record_id", "field", F.explode("_kws").alias("_kw")).distinct()
            .groupBy("_key", "record_id", "field").agg(F.collect_list("_kw").alias("_kws"))
        )
    return found.select(
        F.lit(spec.name).alias("table"), "field", "record_id",
        F.array_join(F.array_sort("_kws"), ", ").alias("keyword"))


def database_findings(specs: list[TableSpec], keywords: list[str], **how) -> DataFrame:
    """Findings of several tables as one plan."""
    return _union(findings(s, keywords, **how) for s in specs)


def matched_records(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    return found.groupBy(*(by or ["table"])).agg(
        F.countDistinct("record_id").alias("matched_records"))


def table_stats(spec: TableSpec, keywords: list[str], ignore_case: bool = True,
                prefilter: str = "fuzzy") -> DataFrame:
    """Total, candidate and matched records of a table in one pass over its text columns.

    A table without text columns reports zero records, an empty one zero matches.
    """
    df, pattern, texts = spec.df, K.search_pattern(keywords), text_columns(spec.df)
    fixed = [F.lit(spec.source_id).alias("source_id"), F.lit(spec.name).alias("table")]
    sizes = [F.lit(len(df.columns)).cast("int").alias("n_columns"),
             F.lit(len(texts)).cast("int").alias("n_text_columns")]
    if not texts or pattern is None:
        total = F.count("*") if texts else F.count_if(F.lit(False))
        return df.agg(total.alias("total_records")).select(
            *fixed, "total_records", F.lit(0).cast("long").alias("candidate_records"),
            F.lit(0).cast("long").alias("matched_records"), *sizes)
    hit = reduce(lambda a, b: a | b,
                 [F.size(cell_keywords(as_text(df, c), pattern)) > 0
                  if K.is_padded(keywords)
                  else K.has_match(as_text(df, c), pattern) for c in texts])
    flagged = df.select(
        _is_candidate(df, keywords, ignore_case, prefilter).alias("_cand"), hit.alias("_hit"),
        *([record_key(spec.keys).alias("_key")] if spec.keys else []))
    both = F.coalesce(F.col("_cand"), F.lit(False)) & F.coalesce(F.col("_hit"), F.lit(False))
    matched = (F.count_if(both) if spec.unique_key or not spec.keys
               else F.countDistinct(F.when(both, F.col("_key"))))
    return flagged.agg(
        F.count("*").alias("total_records"),
        F.count_if("_cand").alias("candidate_records"),
        matched.alias("matched_records"),
    ).select(*fixed, "total_records", "candidate_records", "matched_records", *sizes)


def database_stats(specs: list[TableSpec], keywords: list[str], **how) -> DataFrame:
    return _union(table_stats(s, keywords, **how) for s in specs)


def totals(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counters over the per-table statistics."""
    return stats.groupBy(*(by or [])).agg(
        F.count("*").alias("total_tables"),
        F.coalesce(F.sum("total_records"), F.lit(0)).alias("total_records"),
        F.coalesce(F.sum("candidate_records"), F.lit(0)).alias("candidate_records"),
        F.count_if(F.col("matched_records") > 0).alias("matched_tables"))


def open_databases(
    loaders: dict[str, Callable[[], list[TableSpec]]]
) -> tuple[dict[str, list[TableSpec]], dict[str, str]]:
    """Resolve the tables of several databases; one that fails is left out and reported."""
    opened, failed = {}, {}
    for name, load in loaders.items():
        try:
            opened[name] = load()
        except Exception as e:  # an unreachable database must not stop the others
            failed[name] = f"{type(e).__name__}: {e}"
    return opened, failed


def prefixed(databases: dict[str, list[TableSpec]]) -> list[TableSpec]:
    """All tables of all databases under ``database.table`` names."""
    return [TableSpec(f"{db}.{s.name}", s.df, s.keys, s.unique_key, db)
            for db, specs in databases.items() for s in specs]


def rolled_up(stats: DataFrame) -> DataFrame:
    """Counters per table, per database and overall in one pass; null marks the higher levels."""
    return stats.rollup("source_id", "table").agg(
        F.count("*").alias("total_tables"),
        F.sum("total_records").alias("total_records"),
        F.sum("candidate_records").alias("candidate_records"),
        F.sum("matched_records").alias("matched_records"),
        F.count_if(F.col("matched_records") > 0).alias("matched_tables"))


def merge_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of several connections, kept apart by ``source_id``."""
    return _union(df.withColumn("source_id", F.lit(name)) for name, df in parts.items())


def catalog_tables(spark: SparkSession, database: str,
                   keys: dict[str, tuple[str, ...]] | None = None) -> list[TableSpec]:
    """Tables of a catalog database."""
    keys = keys or {}
    return [TableSpec(t.name, spark.table(f"`{database}`.`{t.name}`"), keys.get(t.name, ()))
            for t in spark.catalog.listTables(database)]
