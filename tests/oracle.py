"""Compare a Spark result with DuckDB SQL on the same tables."""

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    """Whole numbers as integers, other numbers as floats, all else as it is or as text."""
    if hasattr(value, "item"):
        value = value.item()
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, int)):
        return value
    if isinstance(value, (float, Decimal)):
        return float(value)
    return str(value)


def _key(row: tuple) -> tuple:
    """All of the row: what compares exactly first, then the numbers with a fraction, coarsely."""
    exact = [str(v) for v in row if not isinstance(v, float)]
    return tuple(exact), tuple(float(f"{v:.5g}") for v in row if isinstance(v, float)), tuple(v for v in row if isinstance(v, float))


def rows(names: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=_key)


def _rounded(x: float) -> bool:
    return round(x, 4) == x


def close(a, b) -> bool:
    """Equal; of two numbers of which one has a fraction, those rounded to four places may differ in the last of these."""
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None or isinstance(a, (str, bool)) or isinstance(b, (str, bool)):
            return False
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1.1e-4 if _rounded(a) and _rounded(b) and max(abs(a), abs(b)) > 2e-4 else 1e-9)
    return type(a) is type(b) and a == b


def assert_same(df, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(names, cursor.fetchall())
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(close, g, w))]
    assert not wrong, wrong[:3]
