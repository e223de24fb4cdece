"""Run registered queries next to their SQL oracles and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    """Integers, dates, strings and Booleans as they are; other numbers as floats."""
    if hasattr(x, "isoformat"):
        return x.isoformat().replace("T00:00:00", "").replace(" 00:00:00", "")
    if isinstance(x, (bool, int, str)) or x is None:
        return x
    if isinstance(x, (list, tuple)):
        return str([plain(e) for e in x])
    if hasattr(x, "__float__"):
        return None if math.isnan(float(x)) else float(x) + 0.0
    return str(x)


def place(x, rounded: bool = False):
    """A sort key: integers, strings and Booleans exactly; a number of a column with floats by five digits, so that the last digits do not matter."""
    if x is None or isinstance(x, (bool, str)):
        return (0, str(x))
    return (1, f"{float(f'{x:.5g}'):+.4e}") if rounded else (2, x)


def sorted_rows(rows: list[tuple], floats: set[int]) -> list[tuple]:
    """Rows by their exact columns first, then by the columns that hold a float in either result."""
    return sorted(rows, key=lambda r: [(place(x), i) for i, x in enumerate(r) if i not in floats] + [place(x, True) for i, x in enumerate(r) if i in floats])


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(plain(r[i]) for i in order) for r in rows]


def differ(x, y) -> bool:
    if isinstance(x, float) or isinstance(y, float):
        return not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-5 * max(1, abs(x)))
    return x != y


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    floats = {i for r in got + want for i, x in enumerate(r) if isinstance(x, float)}
    got, want = sorted_rows(got, floats), sorted_rows(want, floats)
    if len(got) != len(want):
        return f"{len(got)} rows, the oracle has {len(want)}"
    for a, b in zip(got, want):
        if any(differ(x, y) for x, y in zip(a, b)):
            return f"{a} is not {b}"
    return None
