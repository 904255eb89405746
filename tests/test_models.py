"""Models that SQL cannot express, against numpy or by what they must keep."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tidemark.operators import boosting, factors, modeling


def test_principal_components(spark, sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    x = np.array([r["embedding"] for r in rows], float)
    _, axes = np.linalg.eigh(np.cov(x.T))
    want = np.abs(x @ axes[:, ::-1][:, :8])
    got = {r["vec_id"]: r["parts"] for r in entry.queries()["embedding_pca"](spark, sf).collect()}
    assert np.abs(np.array([got[r["vec_id"]] for r in rows])) == pytest.approx(want, abs=1e-5)


def test_out_of_fold_scores_and_calibration(spark):
    """Scores come from the other folds only; an isotonic curve never falls and has the mean of the labels."""
    rng = np.random.default_rng(2)
    rows = [(i, float(x), float(rng.normal()), int(rng.random() < 1 / (1 + np.exp(-2 * x)))) for i, x in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, y int")
    scored = modeling.out_of_fold(df, "k", ["a", "b"], "y")
    got = {r["k"]: r for r in scored.collect()}
    assert len(got) == 600 and {r["fold"] for r in got.values()} == {0, 1, 2, 3}
    order = np.argsort([got[i]["score"] for i in range(600)])
    y = np.array([rows[i][3] for i in range(600)])
    ranks = np.empty(600)
    ranks[order] = np.arange(600)
    assert (ranks[y == 1].mean() - ranks[y == 0].mean()) / 600 > 0.25
    for form in ("isotonic", "platt"):
        curve = sorted((r["score"], r["calibrated"], r["label"]) for r in modeling.calibrate(scored, "score", "label", form).collect())
        assert all(a[1] <= b[1] + 1e-9 for a, b in zip(curve, curve[1:])) and all(0 <= c[1] <= 1 for c in curve)
        assert np.mean([c[1] for c in curve]) == pytest.approx(np.mean([c[2] for c in curve]), abs=0.01)


def test_survival(spark):
    """Longer lives are expected where they are longer; censored rows count as lasting longer than they were seen."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(800):
        x = float(i % 2)
        life = float(rng.weibull(1.5) * (10 if x else 30))
        rows.append((i, x, min(life, 25.0), life <= 25))
    df = spark.createDataFrame(rows, "k int, x double, days double, sold boolean")
    got = {r["x"]: r["expected"] for r in modeling.survival(df, df, ["x"], "days", "sold").collect()}
    assert 7 < got[1.0] < 14 and 22 < got[0.0] < 40


def test_text_factors_against_numpy(spark, sf):
    """Vocabulary, weights, singular values and projections are those of the whole matrix."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "?")], "doc_id bigint, text string"))
    model = factors.fit(docs, "doc_id", "text", factors=5, least=3, most=400)
    got = {r["doc_id"]: r["factors"] for r in factors.project(docs, "doc_id", "text", model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lists = {}
    for i, t in texts.items():
        words = regex.findall(r"[\p{L}\p{N}]{2,}", t.lower())
        lists[i] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])
    df = Counter(w for c in lists.values() for w in c)
    top = sorted((w for w in df if df[w] >= 3), key=lambda w: (-df[w], w))[:400]
    ids = sorted(lists)
    x = np.array([[lists[i][w] * (np.log((1 + len(ids)) / (1 + df[w])) + 1) for w in top] for i in ids])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    _, values, rows = np.linalg.svd(x, full_matrices=False)
    assert model.values == pytest.approx(values[:5], rel=1e-3)
    want = np.abs(x @ rows[:5].T)
    assert np.abs(np.array([got[i] for i in ids])) == pytest.approx(want, abs=2e-2)
    assert got[-1] == got[-2] == got[-3] == [0.0] * 5
    empty = factors.fit(docs.limit(0), "doc_id", "text", factors=2)
    assert {tuple(r["factors"]) for r in factors.project(docs, "doc_id", "text", empty).collect()} == {(0.0, 0.0)}


def test_gradients_are_those_of_the_loss(spark):
    rng = np.random.default_rng(1)
    rows = [(float(m), float(t), bool(e)) for m, t, e in zip(rng.normal(0, 3, 40), rng.normal(0, 3, 40), rng.integers(0, 2, 40), strict=True)] + [(50.0, -50.0, True), (-50.0, 50.0, False)]
    df, h = spark.createDataFrame(rows, "m double, t double, e boolean"), 1e-4
    for sigma in (0.5, 1.0, 2.0):
        at = [boosting.loss_terms(F.col("m") + d, F.col("t"), F.col("e"), sigma) for d in (-h, 0.0, h)]
        for r in df.select(*[c.alias(f"{n}{i}") for i, cs in enumerate(at) for n, c in zip("lgh", cs, strict=True)]).collect():
            assert r["g1"] == pytest.approx((r["l2"] - r["l0"]) / (2 * h), abs=1e-6)
            assert r["h1"] == pytest.approx((r["g2"] - r["g0"]) / (2 * h), abs=1e-6) and r["h1"] >= 0


def test_boosted_survival_sees_an_interaction(spark):
    """Durations that depend on whether two features agree, which a linear form cannot follow."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        a, b = float(rng.random() < 0.7), float(rng.random() < 0.65)
        life = float(np.exp((3.5 if a == b else 1.5) + 0.3 * rng.logistic()))
        rows.append((i, a, b if rng.random() > 0.05 else None, min(life, 60.0), life <= 60))
    df = spark.createDataFrame(rows, "k int, a double, b double, days double, sold boolean")
    model = boosting.fit(df, ["a", "b"], "days", "sold", trees=9, depth=3, sigma=0.4)
    boosted = {r["k"]: r["expected"] for r in model.predict(df).collect()}
    linear = {r["k"]: r["expected"] for r in modeling.survival(df, df, ["a", "b"], "days", "sold").collect()}
    known = [r for r in rows if r[2] is not None and r[4]]
    off = lambda found: np.mean([abs(np.log(found[r[0]]) - np.log(r[3])) for r in known])
    assert off(boosted) < 0.6 * off(linear)
    middle = lambda same: np.median([boosted[r[0]] for r in known if (r[1] == r[2]) == same])
    assert 20 < middle(True) < 45 and 3 < middle(False) < 7
    assert boosting.fit(df.limit(0), ["a"], "days", "sold", trees=1).predict(df.limit(2)).count() == 2


def test_isotonic_curve_against_pooling_by_hand(spark):
    """Neighbours that fall are pooled into their weighted mean until none does; between points the curve is linear."""
    rng = np.random.default_rng(11)
    rows = [(i, float(rng.integers(0, 25)), int(rng.random() < 0.5)) for i in range(300)]
    got = {r["i"]: r["calibrated"] for r in modeling.calibrate(spark.createDataFrame(rows, "i int, score double, label int"), "score", "label").collect()}
    pools = []
    for x in sorted({r[1] for r in rows}):
        own = [r[2] for r in rows if r[1] == x]
        pools.append([float(np.mean(own)), len(own), [x]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    curve = {x: v for v, _, xs in pools for x in xs}
    assert all(got[i] == pytest.approx(curve[x], abs=1e-9) for i, x, _ in rows)
