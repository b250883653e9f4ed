"""Relational databases as tables to scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineward.operators.tables import TableSpec

# Databases that belong to the server itself, and the URL and driver per kind.
SYSTEM_DATABASES = {
    "mysql": ["mysql", "information_schema", "performance_schema", "sys"],
    "sqlserver": ["master", "tempdb", "model", "msdb", "resource"],
    "postgresql": ["postgres", "template0", "template1"],
    "sqlite": [],
}
URLS = {
    "mysql": "jdbc:mysql://{host}/{database}",
    "sqlserver": "jdbc:sqlserver://{host};databaseName={database}",
    "postgresql": "jdbc:postgresql://{host}/{database}",
    "sqlite": "jdbc:sqlite:{database}",
}
DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "postgresql": "org.postgresql.Driver",
    "sqlite": "org.sqlite.JDBC",
}


def connection(kind: str, database: str, host: str = "", **options: str) -> dict[str, str]:
    """Reader options for a database of a known kind."""
    if kind not in URLS:
        raise ValueError(f"unknown database kind {kind!r}, expected one of {sorted(URLS)}")
    return {"url": URLS[kind].format(host=host, database=database), "driver": DRIVERS[kind], **options}


def read_table(spark: SparkSession, options: dict[str, str], table: str,
               partition_column: str | None = None, bounds: tuple | None = None,
               num_partitions: int | None = None, predicates: list[str] | None = None,
               fetch_size: int = 10_000) -> DataFrame:
    """One table, read in parallel when a partition column with bounds, or predicates, are given.

    The coarse keyword filter reaches the server when it is case-sensitive.
    """
    if predicates:
        rest = {k: v for k, v in options.items() if k != "url"}
        return spark.read.jdbc(options["url"], table, predicates=predicates,
                               properties={**rest, "fetchsize": str(fetch_size)})
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table).option("fetchsize", fetch_size)
    if partition_column:
        low, high = bounds or key_bounds(spark, options, table, partition_column)
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(low), upperBound=str(high),
                                numPartitions=num_partitions or spark.sparkContext.defaultParallelism)
    return reader.load()


def key_bounds(spark: SparkSession, options: dict[str, str], table: str, column: str) -> tuple:
    """Least and greatest value of a column, asked from the server; they only shape the partitions."""
    query = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"
    row = spark.read.format("jdbc").options(**options).option("query", query).load().first()
    return (row[0] or 0, row[1] or 0)


def list_databases(names: DataFrame, kind: str, column: str = "name") -> DataFrame:
    """User databases: the names without those of the server, whatever their case."""
    return names.where(~F.lower(column).isin(SYSTEM_DATABASES[kind]))


def catalog_databases(spark: SparkSession, exclude: list[str] | None = None) -> list[str]:
    skip = {e.lower() for e in exclude or []}
    return [d.name for d in spark.catalog.listDatabases() if d.name.lower() not in skip]


def tables_of(spark: SparkSession, options: dict[str, str], keys: dict[str, tuple[str, ...]],
              source_id: str = "", **how) -> list[TableSpec]:
    """Tables to scan, by name with their key columns."""
    return [TableSpec(name, read_table(spark, options, name, **how), key, bool(key), source_id)
            for name, key in keys.items()]
