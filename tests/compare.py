"""Compare a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.10g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def duck(con, sql):
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    return table([d[0] for d in cursor.description], cursor.fetchall()), types


def spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def difference(df, con, sql) -> str | None:
    (names_d, rows_d), types = duck(con, sql)
    names_s, rows_s = spark(df)
    if names_s != names_d:
        return f"columns {names_s} != {names_d}"
    if "HUGEINT" in types.values():
        return f"huge integers in {types}"
    if len(rows_s) != len(rows_d):
        return f"{len(rows_s)} rows != {len(rows_d)}; {rows_s[:2]} / {rows_d[:2]}"
    for a, b in zip(rows_s, rows_d):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{names_s}: {a} != {b}"
    return None
