"""Whitening against numpy on the same whole numbers, and its updates one by one."""

import numpy as np
import pytest

from tidemark.llm import whitening
from tidemark.llm.common import Tables
from tidemark.llm.queries import op12_embedding_whitening

KIND = "vec_id bigint, embedding array<float>, x string, component int"


@pytest.mark.parametrize("case", ["plain", "repeated", "whole", "scaled", "one"])
def test_rank_one_updates(case):
    rng = np.random.default_rng(len(case))
    rows = rng.normal(size=(150, 24)) * np.exp(rng.normal(size=24))
    rows = {"plain": rows, "repeated": np.repeat(rows[:9], 6, axis=0), "whole": np.round(rows), "scaled": rows * np.array([1e6, *[1.0] * 23]), "one": rows[:1]}[case]
    values, basis = np.zeros(24), np.eye(24)
    for v in rows:
        values, basis = whitening.updated(values, basis, v)
    total = rows.T @ rows
    assert np.abs(np.sort(values) - np.linalg.eigvalsh(total)).max() <= 1e-12 * np.abs(total).max()
    assert np.abs(basis.T @ basis - np.eye(24)).max() < 1e-12
    assert np.abs(basis @ np.diag(values) @ basis.T - total).max() <= 1e-12 * np.abs(total).max()
    half = [(np.zeros(24), np.eye(24))] * 2
    for k in range(2):
        for v in rows[k::2]:
            half[k] = whitening.updated(*half[k], v)
    values, basis = whitening.combined(*half)
    assert np.abs(basis @ np.diag(values) @ basis.T - total).max() <= 1e-12 * np.abs(total).max()


def expected(rows, components=16):
    x = {k: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for k, v in rows.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > 1e-12 * values.sum()).sum()))
    deviation = {k: sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True)) for k, v in x.items()}
    return n, deviation, {k: (np.array(v) - sums / n) @ vectors[:, :kept] / np.sqrt(values[:kept]) for k, v in x.items()}, values[:kept] / values.sum()


def held(got, rows, components=16):
    n, deviation, whitened, explained = expected(rows, components)
    k = len(explained)
    found = {}
    for r in got:
        key = r["vec_id"] if "vec_id" in r else r["id"]
        assert (r["n"], r["deviation"]) == (n, deviation[key]) and r["identity_error"] < 1e-8
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-9
        found.setdefault(key, {}).setdefault(r["component"], []).append(r["whitened"])
    assert set(found) == set(rows) and all(set(v) == set(range(1, k + 1)) for v in found.values())
    for c in range(1, k + 1):
        ours, theirs = (np.array([f(key) for key in sorted(rows)]) for f in (lambda key, c=c: found[key][c][0], lambda key, c=c: whitened[key][c - 1]))
        sign = np.sign(ours @ theirs)
        assert np.abs(ours - sign * theirs).max() < 1e-6
    return found


def test_query_against_numpy(spark, sf):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    held(op12_embedding_whitening(spark, sf).collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = {k: [float(np.float32(c)) for c in rng.normal(size=5)] for k in range(40)}
    good[40], good[41] = good[3], [1000.0, -1000.0, 0.0, 1e-9, 7.0]
    bad = [(50, None), (51, [1.0, None, 1.0, 1.0, 1.0]), (52, [float("nan")] * 5), (53, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [1e30, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(k, v, "extra", 1) for k, v in [*good.items(), *bad, (7, good[7])]], KIND)
    got = whitening.whiten(frame, components=3).collect()
    found = held(got, good, 3)
    assert all(len(v[1]) == (2 if k == 7 else 1) for k, v in found.items())


def test_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(k, v, None, None) for k, v in rows], KIND)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rows = {1: [1.0, 2.0, 0.0], 2: [3.0, 2.0, 0.0], None: [1.0, 9.0, 0.0]}
    got = whitening.whiten(frame(list(rows.items()))).collect()
    assert sorted((r["id"] is None, r["component"]) for r in got) == [(False, 1)] * 2 + [(False, 2)] * 2 + [(True, 1), (True, 2)]
    equal = frame([(k, [float(k % 2), 0.0]) for k in range(6)])
    assert {abs(round(r["whitened"], 9)) for r in whitening.whiten(equal).collect()} == {1.0}


def test_deviation_is_exact_beyond_floats():
    mean = whitening.Mean(3_000_000, np.array([5, 7]), np.array([1, 2]))
    x = np.array([[5 + 700, 7 - 300], [5, 7]])
    assert mean.deviation(x).tolist() == [(3_000_000 * 700 - 1) ** 2 + (3_000_000 * 300 + 2) ** 2, 5]
    with pytest.raises(ValueError):
        mean.deviation(x * 1000)


def test_tree_of_spectra(spark):
    rng = np.random.default_rng(8)
    rows = [([int(c) for c in rng.integers(0, 50, 6)],) for _ in range(90)]
    fit = spark.createDataFrame(rows, "x array<bigint>").repartition(30)
    mean = whitening.mean_of(fit, 6)
    values, basis = whitening.spectrum_of(fit, mean, Tables(spark), fan_in=2)
    x = np.array([r[0] for r in rows], float)
    x -= x.mean(axis=0)
    assert np.abs(basis @ np.diag(values) @ basis.T - x.T @ x).max() < 1e-8
