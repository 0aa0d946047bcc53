"""The driver's contract: importable without a session, and every query equal to its SQL."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_queries_can_be_listed_before_a_session_exists():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def plain(x):
    """A value of either engine in a form that compares: numbers to nine digits, containers as tuples."""
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.9g}")
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.date)):
        return x
    if isinstance(x, int):
        return float(f"{x:.9g}") if abs(x) < 2**53 else x
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    return tuple(map(plain, x)) if hasattr(x, "__iter__") else x


def in_order(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SMALL):
        pytest.skip("the given tables aren't here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    want = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert in_order(df.columns, df.collect()) == in_order(names, want.fetchall())
