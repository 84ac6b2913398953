"""Spark-versus-oracle comparison used by the tests and ``tools/compare.py``:
same row count, same column names, same multiset of rows (columns sorted by
name, values normalised to text)."""

from __future__ import annotations

import decimal
import math

import duckdb

from ..sources.tables import TABLES


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir.rstrip('/')}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if isinstance(v, dict):
        return str(sorted((k, _norm(x)) for k, x in v.items()))
    return "None" if v is None else str(v)


def canonical_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


# Spark type names and their DuckDB counterparts.
SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                   "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT", "tinyint": "TINYINT"}


def compare(spark_df, con, sql: str, check_types: bool = True) -> tuple[bool, str]:
    scols = spark_df.columns
    stypes = dict(spark_df.dtypes)
    srows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    ocols, orows = rel.columns, rel.fetchall()
    if sorted(scols) != sorted(ocols):
        return False, f"columns differ: spark={sorted(scols)} sql={sorted(ocols)}"
    if check_types:
        otypes = {c: str(t) for c, t in zip(ocols, rel.types)}
        bad = [(c, stypes[c], otypes[c]) for c in scols if SPARK_TO_DUCKDB.get(stypes[c], stypes[c]) != otypes[c]]
        if bad:
            return False, f"column types differ (spark, sql): {bad}"
    a, b = canonical_rows(scols, srows), canonical_rows(ocols, orows)
    if len(a) != len(b):
        return False, f"rows differ: spark={len(a)} sql={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} sql={bad[0][1]}"
    return True, f"{len(a)} rows"
