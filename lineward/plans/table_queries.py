"""Table scan over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineward.operators import table_runs as TR
from lineward.operators import tables as T
from lineward.plans import sqltext as Q
from lineward.plans.keyword_queries import KW, KWT, contains_sql
from lineward.plans.registry import query

# Columns of the relational tables and the keys they are scanned with.
LAYOUT = {
    "region": ("r_regionkey", {"r_regionkey": "int", "r_name": None}),
    "nation": ("n_nationkey", {"n_nationkey": "int", "n_name": None, "n_regionkey": "int"}),
    "customer": ("c_custkey", {"c_custkey": "bigint", "c_name": None, "c_nationkey": "int",
                               "c_acctbal": "double", "c_mktsegment": None}),
    "supplier": ("s_suppkey", {"s_suppkey": "bigint", "s_name": None, "s_nationkey": "int",
                               "s_acctbal": "double"}),
    "part": ("p_partkey", {"p_partkey": "bigint", "p_name": None, "p_brand": None, "p_type": None,
                           "p_size": "int", "p_retailprice": "double"}),
    "orders": ("o_orderkey", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": None,
                              "o_totalprice": "double", "o_orderdate": None, "o_orderpriority": None}),
    "lineitem": ("l_orderkey,l_linenumber", {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": None, "l_linestatus": None, "l_shipdate": None}),
}
RELATIONAL = list(LAYOUT)
MASTER = ["region", "nation", "customer", "supplier"]
TRADE = ["part", "orders", "lineitem"]
# Dates are text too; these match parts of them.
KWD = ["1996-0", "2001", "red"]


def keys_of(name: str) -> tuple[str, ...]:
    return tuple(LAYOUT[name][0].split(","))


def texts_of(name: str) -> list[str]:
    return [c for c, kind in LAYOUT[name][1].items() if kind is None]


def specs(t, names, source_id=""):
    return [T.TableSpec(n, getattr(t, n), keys_of(n), unique_key=n != "lineitem", source_id=source_id) for n in names]


def id_sql(name: str) -> str:
    keys = keys_of(name)
    if len(keys) == 1:
        return f"CAST({keys[0]} AS VARCHAR)"
    return " || '-' || ".join(f"coalesce(CAST({k} AS VARCHAR), 'None')" for k in keys)


def text_sql(name: str) -> list[str]:
    return [f"CAST({c} AS VARCHAR)" for c in texts_of(name)]


def candidate_sql(name: str, keywords: list[str]) -> str:
    """Rows with a match in some text column."""
    return "(" + " OR ".join(f"coalesce(regexp_matches({c}, {Q.pattern(keywords)}), FALSE)" for c in text_sql(name)) + ")"


def cells_sql(name: str, keywords: list[str], src: str | None = None, label: str | None = None) -> str:
    """Text cells of the candidate rows of a table."""
    return "(" + " UNION ALL ".join(
        f"SELECT '{label or name}' AS tbl, '{c}' AS field, {id_sql(name)} AS record_id,"
        f" CAST({c} AS VARCHAR) AS value FROM {src or name}"
        f" WHERE {candidate_sql(name, keywords)}" for c in texts_of(name)) + ")"


def findings_group_sql(name: str, keywords: list[str], src=None, label=None) -> str:
    return f"""SELECT tbl AS "table", field, record_id,
        array_to_string(list_sort(list(DISTINCT kw)), ', ') AS keyword
        FROM (SELECT tbl, field, record_id, {Q.joined('ms')} AS kw
              FROM {Q.matches(cells_sql(name, keywords, src, label), 'tbl, field, record_id', keywords, 'value')})
        GROUP BY tbl, field, record_id"""


def stats_sql(name: str, keywords: list[str], src: str | None = None, label: str | None = None,
              source_id: str = "") -> str:
    return f"""SELECT '{source_id}' AS source_id, '{label or name}' AS "table",
        (SELECT count(*) FROM {src or name}) AS total_records,
        (SELECT count(*) FROM {src or name} WHERE {candidate_sql(name, keywords)}) AS candidate_records,
        (SELECT count(DISTINCT record_id) FROM ({findings_group_sql(name, keywords, src)})) AS matched_records,
        CAST({len(LAYOUT[name][1])} AS INTEGER) AS n_columns,
        CAST({len(texts_of(name))} AS INTEGER) AS n_text_columns"""


def union_sql(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _inventory_sql(name: str) -> str:
    cols = LAYOUT[name][1]
    skipped = ",".join(f"{c}({k})" for c, k in cols.items() if k)
    return (f"SELECT '{name}' AS \"table\", count(*) AS row_count, '{','.join(cols)}' AS columns,"
            f" '{','.join(texts_of(name))}' AS text_columns, '{skipped}' AS skipped_columns,"
            f" '{LAYOUT[name][0]}' AS pk_columns FROM {name}")


@query("src_table_inventory", union_sql(_inventory_sql(n) for n in RELATIONAL))
def src_table_inventory(t):
    lists = ["columns", "text_columns", "skipped_columns", "pk_columns"]
    return T.inventory(specs(t, RELATIONAL)).select(
        "table", "row_count", *[F.array_join(c, ",").alias(c) for c in lists])


@query("tbl_text_columns", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def tbl_text_columns(t):
    return T.select_text(t.part, ["p_partkey"])


@query("tbl_candidates", union_sql(
    f"SELECT '{n}' AS \"table\", {id_sql(n)} AS record_id FROM {n} WHERE {contains_sql(text_sql(n), KWT)}"
    for n in ("part", "orders", "customer")))
def tbl_candidates(t):
    return T._union(
        T.candidates(s.df, KWT, prefilter="exact").select(F.lit(s.name).alias("table"), T.record_id(list(s.keys)).alias("record_id"))
        for s in specs(t, ["part", "orders", "customer"]))


@query("tbl_candidates_fuzzy", union_sql(
    f"SELECT '{n}' AS \"table\", {id_sql(n)} AS record_id FROM {n} WHERE {candidate_sql(n, KWT)}"
    for n in ("part", "orders", "customer")))
def tbl_candidates_fuzzy(t):
    return T._union(
        T.candidates(s.df, KWT).select(F.lit(s.name).alias("table"), T.record_id(list(s.keys)).alias("record_id"))
        for s in specs(t, ["part", "orders", "customer"]))


@query("tbl_record_id", f"SELECT {id_sql('lineitem')} AS record_id, l_partkey FROM lineitem")
def tbl_record_id(t):
    return T.with_record_id(t.lineitem, list(keys_of("lineitem"))).select("record_id", "l_partkey")


@query("tbl_record_id_position", f"""
SELECT CAST(row_number() OVER (ORDER BY p_name, p_brand, p_type) AS VARCHAR) AS record_id,
       p_name, p_brand, p_type
FROM part WHERE {contains_sql(text_sql('part'), KWT)}""")
def tbl_record_id_position(t):
    rows = T.candidates(t.part, KWT, prefilter="exact").select("p_name", "p_brand", "p_type")
    return T.with_record_id(rows, [])


@query("tbl_cells", union_sql(
    f"SELECT CAST(p_partkey AS VARCHAR) AS record_id, '{c}' AS field, {c} AS value FROM part"
    for c in texts_of("part")))
def tbl_cells(t):
    keyed = T.with_record_id(t.part, ["p_partkey"])
    return T.cells(keyed, ["record_id"])


@query("tbl_findings", union_sql(
    [findings_group_sql("part", KWT), findings_group_sql("orders", KWT)]
    + [f"""SELECT 'documents' AS "table", 'text' AS field, CAST(doc_id AS VARCHAR) AS record_id,
        array_to_string(list_sort(list(DISTINCT kw)), ', ') AS keyword
        FROM (SELECT doc_id, {Q.joined('ms')} AS kw FROM {Q.matches("documents", 'doc_id', KW)}) GROUP BY doc_id"""]))
def tbl_findings(t):
    docs = T.TableSpec("documents", t.documents, ("doc_id",), unique_key=True)
    return T.database_findings(specs(t, ["part", "orders"]), KWT).unionByName(T.findings(docs, KW))


@query("tbl_findings_composite_key", findings_group_sql("lineitem", KWD))
def tbl_findings_composite_key(t):
    return T.database_findings(specs(t, ["lineitem"]), KWD)


@query("tbl_findings_shared_key", findings_group_sql("orders", KWD).replace(id_sql("orders"), "CAST(o_custkey AS VARCHAR)"))
def tbl_findings_shared_key(t):
    """A key that many rows share: their findings are merged."""
    return T.findings(T.TableSpec("orders", t.orders, ("o_custkey",)), KWD)


@query("tbl_matched_records", f"""
SELECT "table", count(DISTINCT record_id) AS matched_records
FROM ({union_sql([findings_group_sql('part', KWT), findings_group_sql('customer', KWT)])}) GROUP BY "table" """)
def tbl_matched_records(t):
    return T.matched_records(T.database_findings(specs(t, ["part", "customer"]), KWT))


@query("tbl_stats", union_sql(stats_sql(n, KWT) for n in ("part", "orders", "customer", "supplier", "nation", "region")))
def tbl_stats(t):
    return T.database_stats(specs(t, ["part", "orders", "customer", "supplier", "nation", "region"]), KWT)


@query("tbl_scan_database", f"""
SELECT count(*) AS total_tables, CAST(sum(total_records) AS BIGINT) AS total_records,
       CAST(sum(candidate_records) AS BIGINT) AS candidate_records,
       count(*) FILTER (WHERE matched_records > 0) AS matched_tables
FROM ({union_sql(stats_sql(n, KWD) for n in RELATIONAL)})""")
def tbl_scan_database(t):
    return T.totals(T.database_stats(specs(t, RELATIONAL), KWD))


@query("tbl_scan_database_findings", union_sql(findings_group_sql(n, KWD) for n in RELATIONAL))
def tbl_scan_database_findings(t):
    return T.database_findings(specs(t, RELATIONAL), KWD)


_GROUPS = {"master": MASTER, "trade": TRADE}


@query("tbl_scan_all", f"""
SELECT source_id, "table", count(*) AS total_tables, CAST(sum(total_records) AS BIGINT) AS total_records,
       CAST(sum(candidate_records) AS BIGINT) AS candidate_records,
       CAST(sum(matched_records) AS BIGINT) AS matched_records,
       count(*) FILTER (WHERE matched_records > 0) AS matched_tables
FROM ({union_sql(stats_sql(n, KWT, label=f'{db}.{n}', source_id=db) for db, ns in _GROUPS.items() for n in ns)})
GROUP BY ROLLUP (source_id, "table")""")
def tbl_scan_all(t):
    opened, _ = T.open_databases({db: (lambda ns=ns: specs(t, ns)) for db, ns in _GROUPS.items()})
    return T.rolled_up(T.database_stats(T.prefixed(opened), KWT))


def _half(i: int) -> str:
    return f"(SELECT * FROM part WHERE p_partkey % 2 = {i})"


@query("tbl_merge_sources", union_sql(
    f"SELECT *, 's{i}' AS source_id FROM ({findings_group_sql('part', KWT, _half(i))})" for i in (0, 1)))
def tbl_merge_sources(t):
    def half(i):
        return T.TableSpec("part", t.part.where(F.col("p_partkey") % 2 == i), ("p_partkey",), True)

    return T.merge_sources({f"s{i}": T.findings(half(i), KWT) for i in (0, 1)})


@query("tbl_merge_sources_stats", f"""
SELECT count(*) AS total_tables, CAST(sum(total_records) AS BIGINT) AS total_records,
       CAST(sum(candidate_records) AS BIGINT) AS candidate_records,
       count(*) FILTER (WHERE matched_records > 0) AS matched_tables
FROM ({union_sql(stats_sql('part', KWT, _half(i), source_id=f's{i}') for i in (0, 1))})""")
def tbl_merge_sources_stats(t):
    halves = [T.TableSpec("part", t.part.where(F.col("p_partkey") % 2 == i), ("p_partkey",), True, f"s{i}")
              for i in (0, 1)]
    return T.totals(T.database_stats(halves, KWT))


# --- tables that can't be read -------------------------------------------------------------------

def _scan_each(t):
    """All tables, and one more in each group whose rows can't all be read."""
    opened = [s for db, ns in _GROUPS.items() for s in T.prefixed({db: specs(t, ns)})]
    broken = F.when(F.col("o_orderkey") % 500 == 7, F.raise_error(F.lit("block lost")).cast("string")).otherwise(F.col("o_orderpriority"))
    lost = [T.TableSpec(f"{db}.lost", t.orders.withColumn("o_orderpriority", broken), ("o_orderkey",), True, db) for db in ("master", "away")]
    return TR.scan_each(t.spark, opened + lost, KWT)


_EACH = union_sql(stats_sql(n, KWT, label=f"{db}.{n}", source_id=db) for db, ns in _GROUPS.items() for n in ns)


@query("tbl_scan_each", f"""
SELECT source_id, "table", 'done' AS status, CAST(total_records AS BIGINT) AS total_records, CAST(matched_records AS BIGINT) AS matched_records FROM ({_EACH})
UNION ALL SELECT db, db || '.lost', 'failed', NULL, NULL FROM (VALUES ('master'), ('away')) AS v(db)""")
def tbl_scan_each(t):
    run = _scan_each(t)
    return run.status.join(run.stats.select("source_id", "table", "total_records", "matched_records"), ["source_id", "table"], "left").select(
        "source_id", "table", "status", "total_records", "matched_records")


@query("tbl_scan_each_findings", union_sql(
    f"SELECT * REPLACE ('{db}.{n}' AS \"table\") FROM ({findings_group_sql(n, KWT)})" for db, ns in _GROUPS.items() for n in ns))
def tbl_scan_each_findings(t):
    return _scan_each(t).findings


@query("tbl_scan_each_totals", f"""
SELECT count(*) AS total_tables, CAST(sum(total_records) AS BIGINT) AS total_records, CAST(sum(candidate_records) AS BIGINT) AS candidate_records,
       count(*) FILTER (WHERE matched_records > 0) AS matched_tables, count(DISTINCT source_id) AS total_databases, 2 AS failed_tables FROM ({_EACH})""")
def tbl_scan_each_totals(t):
    return _scan_each(t).totals()
