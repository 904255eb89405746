"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of variable order (bytes after at most three bytes of context). Counts are frozen after
training; a byte costs -log2 of its relative count in the longest known context, with PPM method C escapes to shorter ones
and at last to a uniform code over all 256 bytes. A text's score for a language is its exact code length; the language with
the shortest code wins (the smaller name on ties). Texts are lower-cased; all bytes are symbols of their own.

Training takes at most about `max_rows` rows and `max_chars` characters of each language, chosen by a hash of the id;
everything that is scored is scored whole. A null text, or one without a letter, gives `und` and score 0; so does everything
when nothing was learned. Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_share, mapped, text_batches

ORDER = 3
MAX_ROWS = 400
MAX_CHARS = 2_000_000
UNKNOWN = "und"
#: Bytes of evidence that count in full; longer texts are scaled to as many before the score is formed.
EVIDENCE = 48


def _bytes(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of four bytes occurs; texts begin after three line feeds."""

    def run(batches):
        for part in text_batches(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(b"\n\n\n" + _bytes(text))
            for lang, texts in by_lang.items():
                grams, n = np.unique(np.concatenate([_grams(np.frombuffer(t, np.uint8)) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    counted = mapped(rows, run, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(data: np.ndarray) -> np.ndarray:
    d = data.astype(np.int64)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


class Numbered:
    """Places of keys in a sorted array: a table by hash, and a search for the few keys that share a slot of it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, int(max(1, 8 * len(keys) - 1)).bit_length()))
        slots = self._slot(keys)
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slots] = np.arange(len(keys), dtype=np.int32)
        self.crowded = np.zeros(len(self.table), bool)
        self.crowded[slots[self.table[slots] != np.arange(len(keys))]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that are not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self._slot(keys)
        at = self.table[slot].astype(np.int64)
        at[(at >= 0) & (self.keys[at] != keys)] = -1
        again = np.flatnonzero((at < 0) & self.crowded[slot])
        if len(again):
            found = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            at[again] = np.where(self.keys[found] == keys[again], found, -1)
        return at


class ContextTrees:
    """Frozen code lengths, in bits, of a byte after up to three others, for each language.

    `cost[k]` has a row for each run of k + 1 bytes that any language has seen, `escape[k]` one for each seen context of k
    bytes; a run that no language has seen costs the escape from its context and then what the shorter run costs.
    """

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        every = np.concatenate([counts[k][0] for k in langs]) if langs else np.empty(0, np.int64)
        self.runs = [np.unique(every & ((1 << 8 * (k + 1)) - 1)) for k in range(ORDER + 1)]
        self.contexts = [np.unique(runs >> 8) for runs in self.runs]
        self.cost = [np.zeros((len(r), len(langs)), np.float32) for r in self.runs]
        self.escape = [np.zeros((len(c), len(langs)), np.float32) for c in self.contexts]
        for i, lang in enumerate(langs):
            self._fill(i, *counts[lang])

    def _fill(self, i: int, grams: np.ndarray, n: np.ndarray) -> None:
        for k in range(ORDER + 1):
            runs, contexts = self.runs[k], self.contexts[k]
            seen = np.bincount(np.searchsorted(runs, grams & ((1 << 8 * (k + 1)) - 1)), n, len(runs))
            context = np.searchsorted(contexts, runs >> 8)
            total, kinds = np.bincount(context, seen, len(contexts)), np.bincount(context, seen > 0, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(seen / (total + kinds)[context])
            lower = self.cost[k - 1][np.searchsorted(self.runs[k - 1], runs & ((1 << 8 * k) - 1)), i] if k else 8.0
            self.escape[k][:, i] = escape
            self.cost[k][:, i] = np.where(seen > 0, known, escape[context] + lower)

    def numbered(self) -> "ContextTrees":
        """Prepare the look-up of runs and contexts, once in each task."""
        self.run_at, self.context_at = [Numbered(r) for r in self.runs], [Numbered(c) for c in self.contexts]
        return self

    def code_lengths(self, text: str | None, piece: int = 1 << 18) -> np.ndarray:
        data = np.frombuffer(b"\n\n\n" + _bytes(text), np.uint8)
        bits = np.zeros(len(self.langs))
        for at in range(0, len(data) - 3, piece):
            grams = _grams(data[at : at + piece + 3])
            for k in range(ORDER, -1, -1):
                row = self.run_at[k].of(grams)
                hit = row >= 0
                # equal rows are added up together
                bits += np.bincount(row[hit], minlength=len(self.runs[k])) @ self.cost[k] if hit.sum() > len(self.runs[k]) else self.cost[k][row[hit]].sum(0, dtype=np.float64)
                grams = grams[~hit]
                if not len(grams):
                    break
                context = self.context_at[k].of(grams >> 8)
                bits += self.escape[k][context[context >= 0]].sum(0, dtype=np.float64)
                grams = grams & ((1 << 8 * k) - 1)
            else:
                bits += 8.0 * len(grams)
        return bits


def train(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ContextTrees:
    """Context trees of the languages in docs, from about max_rows rows and max_chars characters of each (all, where there
    are fewer)."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(id_col).alias("id"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()
    chosen = F.lit(False)
    for r in sizes:
        chosen = chosen | ((F.col("lang") == r["lang"]) & hashed_share("id", min(1.0, max_rows / r["n"], max_chars / max(1, r["chars"])), 77))
    counted = gram_counts(usable.where(chosen).select("lang", "text")).toArrow()
    names, grams, n = np.array(counted.column("lang").to_pylist(), object), counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    langs = sorted(set(names.tolist()))
    counts = {}
    for name in langs:
        own = names == name
        order = np.argsort(grams[own])
        counts[name] = grams[own][order], n[own][order]
    return ContextTrees(langs, counts)


def predict(docs: DataFrame, trees: ContextTrees, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        model = shared.value
        model.numbered()
        for part in text_batches(batches):
            langs, scores = [], []
            for t in part.column(1).to_pylist():
                if not model.langs or t is None or not any(c.isalpha() for c in t):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                bits = model.code_lengths(t)
                best = int(np.argmin(bits))
                scaled = (bits - bits[best]) * min(1.0, EVIDENCE / max(1, len(t)))
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp2(-np.minimum(scaled, 500)).sum()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, f"id {kind}, lang_pred string, score double")
