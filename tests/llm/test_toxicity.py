"""The nearest examples against brute-force cosines, the weights against plain counts, and accuracy on held-out labels."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import toxicity
from tidemark.llm.common import fold_of
from tidemark.llm.toxicity import Terms

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\W\d_]+")


@pytest.fixture(scope="module")
def world(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if r["toxic"] is not None and r["doc_id"] in docs}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    index = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet").where(fold_of("doc_id", 5) != 0))
    return docs, labels, table, index


def test_all_examples_and_terms_are_in_the_index(world):
    docs, labels, _, index = world
    mine = {i for i in labels if zlib.crc32(str(i).encode()) % 5}
    assert set(index.ids) == mine
    vocabulary = {t for i in mine for t in TERM.findall(docs[i].lower())}
    assert index.vocabulary.tolist() == sorted(Terms().numbers(list(vocabulary)).tolist())


def test_weights(world):
    docs, labels, _, index = world
    mine = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    prior = (sum(labels[i] for i in mine) + 1) / (len(mine) + 2)
    frequency, contexts = Counter(), defaultdict(lambda: defaultdict(list))
    for text in docs.values():
        frequency.update(set(TERM.findall(text.lower())))
    for i in mine:
        words = TERM.findall(docs[i].lower())
        for w in set(words):
            at = words.index(w)
            contexts[w][" ".join(words[max(0, at - 1) : at + 2])].append(labels[i])
    for w, own in contexts.items():
        share = (sum(sum(v) / len(v) for v in own.values()) + 20 * prior) / (len(own) + 20)
        odds = abs(math.log(share / (1 - share)) - math.log(prior / (1 - prior)))
        want = (math.log((1 + len(docs)) / (1 + frequency[w])) + 1) * (0.05 + odds)
        at = np.searchsorted(index.vocabulary, Terms().numbers([w])[0])
        assert index.weight[at] == pytest.approx(want)


def unit(index, text):
    numbers, counts = Terms().counts(text)
    at, counts = index.known(numbers, counts)
    raw = {int(t): (1 + math.log(n)) * index.weight[t] for t, n in zip(at, counts)}
    length = math.sqrt(sum(w * w for w in raw.values())) or 1
    return {t: w / length for t, w in raw.items()}


def test_nearest_examples(world):
    """The groups and cosines found by blocks are those of comparing with every example; a training row finds itself."""
    docs, labels, _, index = world
    vectors = [unit(index, docs[i]) for i in index.ids]
    for i in list(docs)[::7]:
        q = unit(index, docs[i])
        cosine = np.array([sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors])
        best = np.zeros(len(index.votes))
        np.maximum.at(best, index.groups, cosine)
        _, rows, near = index.votes_of([Terms().counts(docs[i])])[0]
        want = np.sort(best[best > 1e-6])[::-1][: toxicity.NEIGHBOURS]
        assert near == pytest.approx(want, abs=2e-5)
        assert cosine[rows] == pytest.approx(near, abs=2e-5)
        if i in set(index.ids) and q:
            assert near[0] == pytest.approx(1, abs=2e-5)
            assert index.groups[rows[0]] == index.groups[index.ids.index(i)]


def test_held_out_accuracy_and_calibration(spark):
    """On sf0.1: most held-out toxic rows are found, hardly any other is, and scores are near the shares they claim."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.train(docs, labels.where(fold_of("doc_id", 5) != 0))
    held = docs.where(fold_of("doc_id", 5) == 0).join(labels.select("doc_id", "toxic"), "doc_id")
    scores = {r["id"]: r["score"] for r in toxicity.score(held.select("doc_id", "text"), index).collect()}
    rows = [(scores[r["doc_id"]], r["toxic"]) for r in held.select("doc_id", "toxic").where("toxic is not null").collect()]
    found = [s >= 0.5 for s, y in rows if y == 1]
    wrong = [s >= 0.5 for s, y in rows if y == 0]
    assert sum(found) >= 0.85 * len(found) and sum(wrong) <= 0.005 * len(wrong)
    for low, high in ((0.0, 0.1), (0.9, 1.01)):
        part = [(s, y) for s, y in rows if low <= s < high]
        assert abs(sum(s for s, _ in part) - sum(y for _, y in part)) <= 0.05 * len(part)


def test_shares_by_class():
    shares = toxicity.class_shares
    assert shares({0: 10, 1: 5}, 15) == {0: 1.0, 1: 1.0}
    assert shares({0: 1000, 1: 5}, 105) == {0: 0.1, 1: 1.0}
    assert shares({0: 1000, 1: 500}, 300) == {0: 0.15, 1: 0.3}
    assert shares({1: 1000}, 300) == {1: 0.3}
    assert shares({}, 300) == {}


def test_a_class_of_one_in_a_thousand(spark):
    """All rows of a rare class are examples, the others fill the bound, and prior and scores keep to the real shares."""
    rows = [(i, f"plain words number n{i % 97} of {'abcdefgh'[i % 8] * 3} stand here" if i % 1000 else f"vile wretched slur of {'abcdefgh'[i // 1000 % 8] * 3} here") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 1000 == 0)) for i in range(20_000)], "doc_id bigint, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", max_examples=1_000)
    drawn = {r["label"]: (r["n"], r["w"]) for r in sample.selectExpr("label", "weight").groupBy("label").agg({"weight": "sum", "label": "count"}).toDF("label", "w", "n").collect()}
    assert drawn[1] == (20, 20.0)
    assert abs(drawn[0][0] - 980) < 120 and drawn[0][1] == pytest.approx(19_980, rel=0.12)
    index = toxicity.train(docs, labels, max_examples=1_000)
    assert index.prior == pytest.approx(21 / 20_002, rel=0.12)
    asked = spark.createDataFrame([(1, "a vile slur of ccc"), (2, "plain words of ccc stand here"), (3, "")], "doc_id bigint, text string")
    scores = {r["id"]: r["score"] for r in toxicity.score(asked, index).collect()}
    assert scores[1] > 0.5 > 0.01 > scores[2] and scores[3] == index.prior


def test_weighted_curve_is_the_curve_of_repeated_rows():
    votes, labels = np.array([0.1, 0.2, 0.8, 0.9, 0.4]), np.array([0.0, 1.0, 1.0, 1.0, 0.0])
    times = np.array([3, 1, 2, 1, 4])
    got = toxicity.fit_curve(votes, labels, times.astype(float))
    assert got == pytest.approx(toxicity.fit_curve(np.repeat(votes, times), np.repeat(labels, times), np.ones(times.sum())), abs=1e-7)
