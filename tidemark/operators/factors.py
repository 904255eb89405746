"""Text factors: TF-IDF over a vocabulary of words and pairs of words, and its truncated singular value decomposition."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shared import shipped

#: Directions beyond those asked for, and rounds of the power iteration.
MORE, ROUNDS = 12, 7
#: Texts whose terms a task counts together.
TEXTS = 256


def terms(text: Column) -> Column:
    """Words in lower case, and pairs of neighbouring words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


@dataclass
class Factors:
    """The vocabulary (term, place, idf) of at most so many terms, the directions (terms x factors) and singular values."""

    vocabulary: DataFrame
    directions: np.ndarray
    values: np.ndarray


def vocabulary(docs: DataFrame, text: str, least: int, most: int) -> DataFrame:
    """(term, place, idf): the `most` terms in the most documents, `least` at least; idf = ln((1 + n) / (1 + df)) + 1."""
    seen = docs.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    top = seen.orderBy(F.desc("df"), "term").limit(most)
    n = docs.agg(F.count("*").alias("n"))
    numbered = top.join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), (F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).alias("place"))
    return numbered.select("term", "place", "idf")


def weights(docs: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, places, weights): TF-IDF of each document at unit length; one without a known term has empty lists.

    The vocabulary is bounded by a parameter and goes to the tasks, which count the known terms of a text on their own: no term
    of a text moves."""
    rows, kind = known.toPandas(), docs.schema[key].dataType.simpleString()
    order = np.argsort(rows["place"].to_numpy(), kind="stable")
    names, idf = rows["term"].to_numpy()[order], rows["idf"].to_numpy()[order]

    def run(batches):
        vocabulary = pa.array(names, pa.string())
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                said = batch.column(1)
                owner = np.repeat(np.arange(batch.num_rows), said.value_lengths().to_numpy())
                places = pc.index_in(said.flatten(), vocabulary)
                met = places.is_valid().to_numpy(zero_copy_only=False)
                cells, counts = np.unique(owner[met] * len(idf) + places.drop_null().to_numpy(), return_counts=True)
                row, place = np.divmod(cells, max(1, len(idf)))
                found = counts * idf[place]
                found /= np.sqrt(np.bincount(row, found * found, batch.num_rows))[row]
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows)))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(found, pa.float64()))], names=[key, "places", "weights"])

    return docs.select(key, terms(F.col(text)).alias("_terms")).mapInArrow(run, f"{key} {kind}, places array<int>, weights array<double>")


def _sparse(batch: pa.RecordBatch, at: int):
    """(places, weights, where each row begins, row of each entry) of the list columns at and at + 1."""
    places, found = batch.column(at), batch.column(at + 1)
    starts = places.offsets.to_numpy().astype(np.int64) - places.offsets[0].as_py()
    return places.flatten().to_numpy(), found.flatten().to_numpy(), starts, np.repeat(np.arange(batch.num_rows), np.diff(starts))


def _projected(places, found, owner, rows: int, directions: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(owner, found * directions[places, j], rows) for j in range(directions.shape[1])], axis=1).astype(float) if rows else np.zeros((0, directions.shape[1]))


def _both_ways(matrix: DataFrame, basis: np.ndarray) -> np.ndarray:
    """Aᵀ A basis, added up in the cluster: tasks emit a row for each term that they met."""
    size, k = basis.shape

    def run(batches):
        total = np.zeros((size, k))
        for batch in batches:
            places, found, _, owner = _sparse(batch, 0)
            y = _projected(places, found, owner, batch.num_rows, basis)
            for j in range(k):
                total[:, j] += np.bincount(places, found * y[owner, j], size)
        met = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(total[met, j]) for j in range(k)]], names=["place", *[f"c{j}" for j in range(k)]])

    fields = "place int, " + ", ".join(f"c{j} double" for j in range(k))
    summed = matrix.select("places", "weights").mapInArrow(run, fields).groupBy("place").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)]).toPandas()
    out = np.zeros((size, k))
    out[summed["place"].to_numpy()] = summed.drop(columns="place").to_numpy()
    return out


def fit(docs: DataFrame, key: str, text: str, factors: int = 8, least: int = 2, most: int = 20_000, rounds: int = ROUNDS) -> Factors:
    """Truncated singular value decomposition of the TF-IDF matrix by power iteration on a few directions more than asked for.

    The matrix stays in the cluster; the driver holds terms x directions, bounded by `most`. In the end the matrix is taken
    within the space found (Rayleigh-Ritz), which gives singular values and directions. Each direction has its largest entry
    positive."""
    shipped(docs.sparkSession)
    known = vocabulary(docs, text, least, most).persist()
    try:
        rows = known.toPandas()
        size = len(rows)
        if not size:
            return Factors(docs.sparkSession.createDataFrame([], known.schema), np.zeros((0, factors)), np.zeros(factors))
        held = docs.sparkSession.createDataFrame(rows, known.schema)
    finally:
        known.unpersist()
    matrix = weights(docs, key, text, held).persist()
    try:
        basis = np.linalg.qr(np.random.default_rng(7).normal(size=(size, min(size, factors + MORE))))[0]
        for _ in range(rounds):
            basis = np.linalg.qr(_both_ways(matrix, basis))[0]
        values, turn = np.linalg.eigh(basis.T @ _both_ways(matrix, basis))
    finally:
        matrix.unpersist()
    directions = (basis @ turn)[:, ::-1][:, :factors]
    directions = directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    pad = factors - directions.shape[1]
    return Factors(held, np.pad(directions, ((0, 0), (0, pad))), np.pad(np.sqrt(np.maximum(values[::-1][:factors], 0)), (0, pad)))


def project(docs: DataFrame, key: str, text: str, model: Factors) -> DataFrame:
    """(key, factors): every document in the directions of the model; one without a known term is at the origin."""
    directions, kind = model.directions, docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            places, found, _, owner = _sparse(batch, 1)
            y = _projected(places, found, owner, batch.num_rows, directions)
            offsets = np.arange(len(y) + 1, dtype=np.int32) * directions.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))], names=[key, "factors"])

    return weights(docs, key, text, model.vocabulary).mapInArrow(run, f"{key} {kind}, factors array<double>")
