"""Every query with SQL agrees with DuckDB on the same tables, row by row."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return out


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n in os.environ.get("ONLY", n).split(",")))
def test_agrees(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    ours = Counter(tuple(plain(v) for _, v in sorted(r.asDict().items())) for r in got.collect())
    theirs = Counter(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall())
    assert sum(theirs.values()) > 0
    assert not (ours - theirs) and not (theirs - ours), (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
