"""Toxicity from the nearest labelled examples.

Every term of every labelled example counts. A term's weight is its TF-IDF, with document frequencies over the whole corpus,
times how far the term speaks for or against the positive class (smoothed log odds over the distinct contexts in which
labelled rows have it, so that copies of one text count once). Vectors are scaled to length one and kept in an inverted
index: rare terms have postings, frequent ones a row in each block of examples, and each block knows its greatest weights. A
text visits the blocks in falling order of the bound that these give, and stops when no further block can reach its k nearest,
so the nearest examples by cosine are exact. Examples that are near copies of each other (shared bands of minimum hashes) have
one vote together, their mean label. Votes are weighted by cosine; a logistic curve, fitted on the votes that the examples
themselves get from all others, turns them into a calibrated score. The nearest examples are returned as evidence.

Training takes at most about `max_examples` labelled rows and `max_chars` characters of them, chosen by a hash of the id within
each class: the smaller class gives all it has up to half of the bound. Rows count by the inverse of their class's share where
the prior and the curve are fitted, so scores keep to the shares of all labelled rows. Labels other than 0 and 1 do not count. Whole texts are scored. A null or empty text, or one without a known term, gets the
smoothed share of the positive class. Repeated rows are scored alike; labels, languages, sources and ids are not inputs of a
score; extra columns are ignored. With no labelled row every score is 0; with one class only it is the smoothed share.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed, hashed_share, mapped, text_batches
from .simhash import bands_of, shingle_hashes

MAX_EXAMPLES = 4_000
MAX_CHARS = 16_000_000
NEIGHBOURS = 15
BLOCK = 128
#: Terms that are kept as rows of blocks: the most frequent ones.
FREQUENT = 256
#: Blocks that every text visits, and texts that are scored side by side.
VISITED = 3
TEXTS = 256
#: Contexts that a term's log odds are smoothed with, and the part of TF-IDF that a neutral term keeps.
SMOOTHING = 20.0
NEUTRAL = 0.05
TERM = re.compile(r"[^\W\d_]+")
#: Terms whose hashes a task remembers.
REMEMBERED = 1 << 17


class Terms:
    """64-bit numbers of the terms of texts; some are remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a text and how often each occurs."""
        found = Counter(TERM.findall((text or "").lower()))
        return self.numbers(found), np.fromiter(found.values(), np.float64, len(found))

    def numbers(self, terms) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for t in terms:
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) - (1 << 63)
        return np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))


def class_shares(sizes: dict[int, float], most: float) -> dict[int, float]:
    """The share of each of two classes that stays, so that about `most` stay in all: the smaller class keeps all it has up to
    half of the bound, the other one fills what is left."""
    if sum(sizes.values()) <= most:
        return dict.fromkeys(sizes, 1.0)
    small = min(sizes, key=lambda k: (sizes[k], k))
    taken = min(sizes[small], most / 2 if len(sizes) > 1 else most)
    return {k: (taken if k == small else most - taken) / n if n else 1.0 for k, n in sizes.items()}


def by_class(shares: dict[int, float], seed: int):
    """True for about the given share of the ids of each class."""
    out = F.lit(False)
    for label, share in shares.items():
        out = out | ((F.col("label") == label) & hashed_share("id", share, seed))
    return out


def inverse_share(shares: dict[int, float]):
    out = F.lit(1.0)
    for label, share in shares.items():
        out = F.when(F.col("label") == label, F.lit(1.0 / share) if share else F.lit(1.0)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(id, text, label, weight) of about max_examples labelled rows at most, drawn by class; the sample of labels is small
    enough to broadcast. The weight is the inverse of the share that was taken of the row's class."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    shares = class_shares({r["label"]: r["count"] for r in known.groupBy("label").count().collect()}, max_examples)
    picked = known.where(by_class(shares, 78)).withColumn("weight", inverse_share(shares))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(picked), "id")


def example_terms(sample: DataFrame) -> DataFrame:
    """(id, label, weight, terms, counts, around, bands) of each example: its terms with their counts and the hash of the words next
    to the first place of each, and its bands of minimum hashes."""

    def run(batches):
        terms = Terms()
        for part in text_batches(batches):
            out = []
            for text in part.column(1).to_pylist():
                words = TERM.findall(text.lower())
                found, first = Counter(words), {}
                for at, w in enumerate(words):
                    first.setdefault(w, at)
                around = [xxhash.xxh64_intdigest(" ".join(words[max(0, first[w] - 1) : first[w] + 2])) >> 1 for w in found]
                out.append((terms.numbers(found), list(found.values()), around, bands_of(np.unique(shingle_hashes(text, 5)))))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), *columns], names=["id", "label", "weight", "terms", "counts", "around", "bands"])

    kind = sample.schema["id"].dataType.simpleString()
    return mapped(sample.select("id", "text", "label", "weight"), run, f"id {kind}, label int, weight double, terms array<bigint>, counts array<int>, around array<bigint>, bands array<bigint>")


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, text: str = "text") -> tuple[int, np.ndarray]:
    """The number of rows of docs, and in how many of them each term of the (sorted) vocabulary occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own, terms, rows = shared.value, Terms(), 0
        seen = np.zeros(len(own), np.int64)
        for part in text_batches(batches):
            for t in part.column(0).to_pylist():
                rows += 1
                if len(own):
                    numbers, _ = terms.counts(t)
                    at = np.minimum(np.searchsorted(own, numbers), len(own) - 1)
                    seen[at[own[at] == numbers]] += 1
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1)), pa.array(np.append(seen[there], rows))], names=["term", "n"])

    counted = mapped(docs.select(F.col(text).alias("text")), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    at, n = (counted.column(k).to_numpy() for k in ("term", "n"))
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[at] = n
    return int(out[-1]), out[:-1]


def near_copies(bands: list[list[int]]) -> np.ndarray:
    """The group of each example: examples that share a band are one group."""
    root, first = list(range(len(bands))), {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, own in enumerate(bands):
        for k, v in enumerate(own):
            a, b = find(first.setdefault((k, v), i)), find(i)
            root[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(len(bands))], return_inverse=True)[1] if bands else np.empty(0, np.int64)


class BlockMaxIndex:
    """Inverted index of unit vectors in blocks of examples, with the greatest weights of each block.

    vectors holds for each example its terms (places in the vocabulary) and their counts.
    """

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, ids: list, labels: np.ndarray, groups: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], prior: float, curve: tuple[float, float] = (0.0, 1.0)):
        self.vocabulary, self.weight, self.prior, self.curve = vocabulary, weight, prior, curve
        vectors = [(t, self.scaled(t, n)) for t, n in vectors]
        # examples whose heaviest terms are the same share blocks, which makes the bounds tight
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (lead[i], str(ids[i])))
        self.ids, self.groups = [ids[i] for i in order], groups[order]
        self.votes = np.bincount(groups, labels) / np.maximum(1, np.bincount(groups))
        vectors = [vectors[i] for i in order]
        row = np.repeat(np.arange(len(order)), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.empty(0, np.int64)
        w = np.concatenate([w for _, w in vectors]) if vectors else np.empty(0)
        often = np.argsort(-np.bincount(term, minlength=len(vocabulary)), kind="stable")[:FREQUENT]
        self.dense_at = np.full(len(vocabulary), -1, np.int32)
        self.dense_at[often] = np.arange(len(often))
        self.dense = np.zeros((len(order), len(often)), np.float32)
        dense = self.dense_at[term] >= 0
        self.dense[row[dense], self.dense_at[term[dense]]] = w[dense]
        self.starts = np.arange(0, len(order), BLOCK)
        self.most = np.maximum.reduceat(self.dense, self.starts) if len(order) else self.dense
        by = np.argsort(term[~dense], kind="stable")
        self.rows, self.held = row[~dense][by].astype(np.int32), w[~dense][by].astype(np.float32)
        self.edges = np.searchsorted(term[~dense][by], np.arange(len(vocabulary) + 1)).astype(np.int32)
        # the examples of each group, one group after the other
        self.by_group = np.argsort(self.groups, kind="stable")
        self.group_at = np.searchsorted(self.groups[self.by_group], np.arange(len(self.votes) + 1))

    def scaled(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        raw = (1 + np.log(counts)) * self.weight[terms]
        length = np.sqrt((raw * raw).sum())
        return raw / length if length else raw

    def known(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.vocabulary):
            return np.empty(0, np.int64), counts[:0]
        at = np.minimum(np.searchsorted(self.vocabulary, numbers), len(self.vocabulary) - 1)
        there = self.vocabulary[at] == numbers
        return at[there], counts[there]

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (known terms, counts) the rows and cosines of the nearest examples of its k nearest groups, best
        first (ties: the smaller group); the group in `without` is left out.

        First each text visits the blocks with its greatest bounds, then those whose bound reaches its k-th group.
        """
        n, k = len(self.ids), min(k, len(self.votes))
        score, dense = np.zeros((len(texts), n), np.float32), np.zeros((len(texts), self.dense.shape[1]), np.float32)
        for i, (terms, counts) in enumerate(texts):
            q, at = self.scaled(terms, counts), self.dense_at[terms]
            dense[i, at[at >= 0]] = q[at >= 0]
            rare, weight = terms[at < 0], q[at < 0]
            size = self.edges[rare + 1] - self.edges[rare]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.edges[rare], size)
            score[i] = np.bincount(self.rows[inside], self.held[inside] * np.repeat(weight, size), n)
        bound = np.maximum.reduceat(score, self.starts, axis=1) + dense @ self.most.T
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :VISITED], True, axis=1)
        self._visit(score, dense, first)
        # rows that are not visited yet have a part of their score only, which is a lower bound as well
        best = self._by_group(score, without)
        reached = np.partition(best, -k, axis=1)[:, -k]
        rest = ~first & (bound >= reached[:, None] - 1e-5)
        if rest.any():
            self._visit(score, dense, rest)
            best = self._by_group(score, without)
        out = []
        for own, held in zip(best, score, strict=True):
            top = np.argpartition(-own, min(k + 8, len(own) - 1))[: k + 8]
            top = top[np.lexsort((top, -np.round(own[top], 5)))][:k]
            top = top[own[top] > 1e-6]
            rows = []
            for g in top.tolist():
                members = self.by_group[self.group_at[g] : self.group_at[g + 1]]
                rows.append(members[0] if len(members) == 1 else members[np.argmax(held[members])])
            out.append((np.array(rows, np.int64), own[top].astype(np.float64)))
        return out

    def _visit(self, score: np.ndarray, dense: np.ndarray, wanted: np.ndarray) -> None:
        """Add the frequent terms' part of the scores in the wanted blocks of each text."""
        for b in np.flatnonzero(wanted.any(axis=0)).tolist():
            texts, rows = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, min(len(self.ids), (b + 1) * BLOCK))
            score[texts, rows] += dense[texts] @ self.dense[rows].T

    def _by_group(self, score: np.ndarray, without: list[int] | None) -> np.ndarray:
        best = np.maximum.reduceat(score[:, self.by_group], self.group_at[:-1], axis=1)
        for i, g in enumerate(without or ()):
            if g >= 0:
                best[i, g] = 0
        return best

    def votes_of(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float | None, np.ndarray, np.ndarray]]:
        """For each text the weighted mean label of its nearest groups (None if there are none), and these."""
        known = [self.known(*t) for t in texts]
        out: list = [(None, np.empty(0, np.int64), np.empty(0))] * len(texts)
        some = [i for i, (terms, _) in enumerate(known) if len(terms)] if self.ids else []
        if some:
            found = self.nearest([known[i] for i in some], without=[without[i] for i in some] if without else None)
            for i, (rows, near) in zip(some, found, strict=True):
                if len(rows):
                    out[i] = float((near * self.votes[self.groups[rows]]).sum() / near.sum()), rows, near
        return out

    def scores(self, terms: Terms, texts: list[str | None]) -> list[tuple[float, list, list[float]]]:
        """The calibrated score of each text, the ids of its nearest examples and their cosines."""
        out = []
        for vote, rows, near in self.votes_of([terms.counts(t) for t in texts]):
            value = self.prior if vote is None else float(calibrated(np.array([vote]), self.curve)[0])
            out.append((value, [self.ids[r] for r in rows], near.tolist()))
        return out


def _logit(vote: np.ndarray) -> np.ndarray:
    v = 0.02 + 0.96 * vote
    return np.log(v / (1 - v))


def calibrated(vote: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * _logit(vote), -30, 30)))


def fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Offset and slope of the logistic curve from votes to labels, by Newton's method with a weak pull to (0, 1); rows count by
    their weights."""
    x, at = np.stack([np.ones(len(votes)), _logit(votes)]), np.array([0.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        slope = x @ (weights * (labels - p)) - 0.5 * (at - (0.0, 1.0))
        bend = (x * (weights * p * (1 - p))) @ x.T + 0.5 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(max(at[1], 0.0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES, max_chars: int = MAX_CHARS) -> BlockMaxIndex | None:
    """The index of the labelled examples; None where there is no labelled row."""
    sample = checkpointed(labelled_sample(docs, labels, label, text, id_col, max_examples))
    chars = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum(F.length("text")).alias("n")).collect()}
    if sum(chars.values()) > max_chars:
        shares = class_shares(chars, max_chars)
        sample = sample.where(by_class(shares, 79)).withColumn("weight", F.col("weight") * inverse_share(shares))
    if not chars:
        return None
    examples = checkpointed(example_terms(sample))
    vocabulary = np.sort(examples.select(F.explode("terms").alias("term")).distinct().toArrow().column(0).to_numpy())
    index, both = fitted(examples, vocabulary, *document_frequencies(docs, vocabulary, text))
    if both:
        index.curve = fit_curve(*own_votes(sample, index))
    return index


def fitted(examples: DataFrame, vocabulary: np.ndarray, rows: int, frequency: np.ndarray) -> tuple[BlockMaxIndex | None, bool]:
    """The index of the examples (None if there are none), and whether they have both labels.

    The sample is bounded, so one task builds it; the driver never holds the examples, which take several times the index.
    """
    shared = examples.sparkSession.sparkContext.broadcast((vocabulary, rows, frequency))

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            data = pickle.dumps(index_of(pa.Table.from_batches(parts), *shared.value), protocol=5)
            for at in range(0, len(data), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([data[at : at + (1 << 20)]], pa.binary())], names=["at", "piece"])

    out = mapped(examples.coalesce(1), run, "at bigint, piece binary").toArrow().sort_by("at")
    shared.destroy()
    return pickle.loads(b"".join(out.column("piece").to_pylist())) if out.num_rows else (None, False)


def index_of(table: pa.Table, vocabulary: np.ndarray, rows: int, frequency: np.ndarray) -> tuple[BlockMaxIndex, bool]:
    """The index of a table of `example_terms`, still without its curve, and whether both labels occur."""
    # in the order of ids, whatever the order of tasks
    table = table.take(pa.array(sorted(range(table.num_rows), key=lambda i, ids=table.column("id").to_pylist(): (str(type(ids[i])), ids[i]))))
    ids, y = table.column("id").to_pylist(), table.column("label").to_numpy().astype(np.float64)
    weights = table.column("weight").to_numpy()
    sizes = pc.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
    flat = {k: table.column(k).combine_chunks().flatten().to_numpy() for k in ("terms", "counts", "around")}
    groups = near_copies(table.column("bands").to_pylist())
    del table
    place = np.searchsorted(vocabulary, flat.pop("terms")).astype(np.int32)
    prior = float((weights @ y + 1) / (weights.sum() + 2))
    # how the classes stand in the sample itself, which is what a term's share is held against
    drawn = float((y.sum() + 1) / (len(y) + 2))
    # the mean label of each context of a term, then the sums over its contexts
    order = np.lexsort((flat["around"], place))
    owner, context, label_of = place[order], flat["around"][order], np.repeat(y, sizes)[order]
    fresh = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(context, prepend=-1)) if len(owner) else np.empty(0, np.int64)
    mean = np.add.reduceat(label_of, fresh) / np.diff(np.append(fresh, len(owner))) if len(fresh) else np.empty(0)
    held, spoke = np.bincount(owner[fresh], minlength=len(vocabulary)), np.bincount(owner[fresh], mean, len(vocabulary))
    share = (spoke + SMOOTHING * drawn) / (held + SMOOTHING)
    odds = np.abs(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    weight = (np.log((1 + rows) / (1 + frequency)) + 1) * (NEUTRAL + odds)
    ends = np.cumsum(sizes)
    vectors = [(place[b - n : b], flat["counts"][b - n : b].astype(np.float64)) for b, n in zip(ends, sizes, strict=True)]
    del order, owner, context, label_of, fresh, mean
    return BlockMaxIndex(vocabulary, weight, ids, y, groups, vectors, prior), bool(0 < y.sum() < len(y))


def own_votes(sample: DataFrame, index: BlockMaxIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vote that each example gets from all others but its near copies, its label and its weight."""
    shared = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        model, terms = shared.value, Terms()
        group = dict(zip(model.ids, model.groups.tolist(), strict=True))
        for part in text_batches(batches, TEXTS):
            own = [group.get(key, -1) for key in part.column(0).to_pylist()]
            votes = [v for v, _, _ in model.votes_of([terms.counts(t) for t in part.column(1).to_pylist()], own)]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), part.column(2), part.column(3)], names=["vote", "label", "weight"])

    out = mapped(sample.select("id", "text", "label", "weight"), run, "vote double, label int, weight double").where("vote is not null").toArrow()
    shared.destroy()
    vote, label, weight = (out.column(k).to_numpy().astype(np.float64) for k in ("vote", "label", "weight"))
    order = np.lexsort((weight, label, vote))
    return vote[order], label[order], weight[order]


def score(docs: DataFrame, index: BlockMaxIndex | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score, evidence, similarity): the calibrated score, and the ids and cosines of the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType
    arrow = to_arrow_type(kind)

    def run(batches):
        model, terms = shared.value, Terms()
        for part in text_batches(batches, TEXTS):
            texts = part.column(1).to_pylist()
            out = model.scores(terms, texts) if model else [(0.0, [], [])] * len(texts)
            kinds = (pa.float64(), pa.list_(arrow), pa.list_(pa.float64()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "score", "evidence", "similarity"])

    name = kind.simpleString()
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), run, f"id {name}, score double, evidence array<{name}>, similarity array<double>")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", id_col: str = "doc_id", examples: DataFrame | None = None) -> DataFrame:
    """docs without the rows that score threshold or more, in one pass over the text; other columns are kept as they are."""
    index = train(examples if examples is not None else docs, labels, text=text, id_col=id_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text)

    def run(batches):
        model, terms = shared.value, Terms()
        for part in text_batches(batches, TEXTS):
            texts = part.column(at).to_pylist()
            keep = [score < threshold for score, _, _ in model.scores(terms, texts)] if model else [True] * len(texts)
            yield part.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
