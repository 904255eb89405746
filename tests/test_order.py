"""Quantiles and ranks of groups against numpy and plain sorting, whatever a task may hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import order

WANTED = {"a": ("v", 0.5), "b": ("v", 0.9), "c": ("w", 1 / 3), "d": ("w", 1.0), "e": ("v", 0.0)}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    out = [(["x", "y", None][int(rng.integers(3))], float(rng.normal()), float(rng.integers(4))) for _ in range(4000)]
    out += [("one", 1.5, 2.0), ("none", None, None), ("none", None, 7.0)] + [("same", 3.0, -1.0)] * 300 + [("far", 10.0 ** float(k % 40 - 20), float(k)) for k in range(300)]
    return out


@pytest.mark.parametrize("most", [10**6, 500, 40, 3])
def test_quantiles(spark, rows, most):
    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r["k"]: r for r in order.quantiles(df, ["k"], WANTED, most).collect()}
    assert set(got) == {r[0] for r in rows}
    for k in got:
        for name, (c, q) in WANTED.items():
            own = [r[1 if c == "v" else 2] for r in rows if r[0] == k and r[1 if c == "v" else 2] is not None]
            assert got[k][name] == (pytest.approx(float(np.quantile(own, q)), rel=1e-12) if own else None), (k, name)


def test_quantiles_of_all_rows(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double, w double")
    for most in (10**6, 50):
        r = order.quantiles(df, [], {"m": ("v", 0.25)}, most).collect()
        assert len(r) == 1 and r[0]["m"] == pytest.approx(float(np.quantile([x[1] for x in rows if x[1] is not None], 0.25)), rel=1e-12)
    assert order.quantiles(df.limit(0), [], {"m": ("v", 0.25)}).first()["m"] is None
    assert order.quantiles(df.limit(0), ["k"], {"m": ("v", 0.25)}).count() == 0


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_places_and_tiles(spark, ranges):
    rng = np.random.default_rng(5)
    rows = [(i, ["hot"] * 8 + ["b", "c", None], float(rng.integers(30))) for i in range(2000)]
    rows = [(i, k[int(rng.integers(len(k)))], v) for i, k, v in rows]
    df = spark.createDataFrame(rows, "i int, k string, v double")
    placed = order.numbered(df, ["k"], [F.desc("v"), F.col("i")], ranges)
    got = {r["i"]: (r["place"], r["size"], r["t"], r["u"]) for r in placed.select("*", order.tile(F.col("place"), F.col("size"), 7).alias("t"), order.tile(F.col("place"), F.col("size"), 900).alias("u")).collect()}
    want = {r["i"]: (r["place"], r["size"], r["t"], r["u"]) for r in df.selectExpr("i", "row_number() over (partition by k order by v desc, i) as place", "count(*) over (partition by k) as size", "ntile(7) over (partition by k order by v desc, i) as t", "ntile(900) over (partition by k order by v desc, i) as u").collect()}
    assert got == want
    assert order.numbered(df.limit(0), ["k"], [F.col("v")]).count() == 0


def test_first_rows_of_a_group_are_cut_before_they_move(spark, sf):
    import __spark_entry__

    plan = __spark_entry__.queries()["per_group_cap"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # once in each task, once behind the exchange
