"""Benchmark decontamination with suffix arrays over the training text.

Words are maximal runs of code points outside ASCII non-alphanumerics, A-Z lowered. The training text is cut into shards of
bounded size inside the tasks; each shard gets a suffix array (its positions in the order of the words that follow, compared
by their first `width` words), and every test suffix is binary-searched in it: the interval it finds holds all verbatim
places, so the whole of it is marked. A test suffix is `width` consecutive words of an item, or the whole of a shorter item.
Matches of neighbouring test suffixes at neighbouring places are chained, which gives the longest verbatim match of each item
and where it stands in text and item, of whatever length. Suffixes that begin with two words that no item has cannot match
and are left out of the arrays. The test set is handled in blocks of at most about `block_words` words, one after the other;
the driver and each task hold one block at a time, and each block reads the corpus once.

A null or empty text has no words, n_hit 0 and is not contaminated; an item without words never occurs. Items without an id
are one item that counts for hit words and is not named. Repeated rows are handled row by row; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Tables, mapped

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
WIDTH = 13
#: Words of one shard, and of one block of test items.
SHARD_WORDS = 1 << 19
BLOCK_WORDS = 1 << 20


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else text.translate(UPPER))


class TestSuffixes:
    """The suffixes of a block of items as rows of word numbers, each with the items and places that hold it."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WIDTH):
        self.width = width
        self.vocabulary: dict[str, int] = {}
        # items of one id count as one; places are told apart by the text
        spans: dict[tuple[int, ...], list[tuple[str | None, int, int]]] = {}
        for number, (item, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - width + 1)) if ids else ():
                spans.setdefault(tuple(ids[at : at + width]), []).append((item, number, at))
        ordered = sorted(spans)
        self.places = [spans[s] for s in ordered]
        self.length = np.array([len(s) for s in ordered], np.int64)
        self.low = keys_of(ordered, width, 0)
        self.high = keys_of(ordered, width, 0xFFFFFFFF)
        first: dict[int, set[int]] = {}
        for s in ordered:
            first.setdefault(s[0], set()).add(s[1] if len(s) > 1 else 0)
        pairs = [(a << 32) | b for a, nexts in first.items() for b in nexts if b]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.single = np.array(sorted(a for a, nexts in first.items() if 0 in nexts), np.int64)

    def longest(self, start: list[int], end: list[int], test: list[int]) -> list[tuple[str | None, int, int, int]]:
        """(item, length, place in the text, place in the item) of the longest match of each item, by chains of suffixes."""
        runs: dict[tuple[int, int], list[int]] = {}
        best: dict[str | None, tuple[int, int, int]] = {}
        for a, b, t in sorted(zip(start, end, test, strict=True)):
            for item, number, at in self.places[t]:
                run = runs.get((number, a - at))
                if run and run[2] == a - 1:
                    run[1:] = [b, a]
                else:
                    run = runs[number, a - at] = [a, b, a]
                own = (run[1] - run[0], -run[0], at - (a - run[0]))
                if item not in best or own[:2] > best[item][:2]:
                    best[item] = own
        return [(item, n, -a, at) for item, (n, a, at) in sorted(best.items(), key=lambda x: (x[0] is not None, x[0] or ""))]


def keys_of(rows: list[tuple[int, ...]], width: int, fill: int) -> np.ndarray:
    out = np.full((len(rows), width), fill, ">u4")
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out.view(f"V{4 * width}").ravel()


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def search(stream: np.ndarray, tests: TestSuffixes, shard: int = SHARD_WORDS):
    """(start, end, test) of every verbatim place of a test suffix in the stream of word numbers (0: no item has the word)."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n, width = len(stream), tests.width
    padded = np.concatenate([stream, np.zeros(width, np.int64)])
    for at in range(0, n, shard):
        here = np.arange(at, min(n, at + shard))
        here = here[padded[here] > 0]
        here = here[member((padded[here] << 32) | padded[here + 1], tests.pairs) | member(padded[here], tests.single)]
        if not len(here):
            continue
        # the suffix array of the shard: its positions in the order of the words that follow
        keys = np.ascontiguousarray(padded[here[:, None] + np.arange(width)], dtype=">u4")
        order = np.lexsort(keys.T[::-1])
        suffixes, keys = here[order], keys[order].view(f"S{4 * width}").ravel()
        left = np.searchsorted(keys, tests.low.view(f"S{4 * width}"), "left")
        right = np.searchsorted(keys, tests.high.view(f"S{4 * width}"), "right")
        hit = np.flatnonzero(right > left)
        counts = right[hit] - left[hit]
        if not len(hit):
            continue
        test = np.repeat(hit, counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = suffixes[np.repeat(left[hit], counts) + inside]
        found.append((start, start + tests.length[test], test))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matches(texts: list[str | None], tests: TestSuffixes):
    """For each text: n_words, and the arrays start, end, test of its matches in word positions of the text."""
    number, streams = tests.vocabulary.get, []
    for t in texts:
        words = words_of(t)
        streams.append(np.fromiter((number(w, 0) for w in words), np.int64, len(words)))
    sizes = np.array([len(s) for s in streams], np.int64)
    # a zero between texts keeps a suffix from running into the next one
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    stream = np.zeros(offsets[-1], np.int64)
    for s, at in zip(streams, offsets, strict=False):
        stream[at : at + len(s)] = s
    start, end, test = search(stream, tests)
    owner = np.searchsorted(offsets, start, "right") - 1
    order = np.argsort(owner, kind="stable")
    start, end, test, owner = start[order], end[order], test[order], owner[order]
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, n in enumerate(sizes):
        a, b = edges[i], edges[i + 1]
        yield int(n), start[a:b] - offsets[i], end[a:b] - offsets[i], test[a:b]


def _grouped(batches, words: int):
    """Rows in groups of bounded text, whatever the size of the batches."""
    for batch in batches:
        rows, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[1] or "") // 6
            if size >= words:
                yield rows
                rows, size = [], 0
        if rows:
            yield rows


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int):
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), text).where(F.col(text).isNotNull())
    for item, words in rows.toLocalIterator():
        # items without an id are one item, which counts for hit words like any other
        block.append((item, words))
        size += len(words) // 6 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCH = "struct<item:string,length:bigint,at:bigint,item_at:bigint>"


def overlaps(docs: DataFrame, items: list[tuple[str | None, str | None]], text: str = "text", row_id: str = "doc_id", width: int = WIDTH):
    """((row_id, n_words, spans, matches), broadcast): merged hit spans in words, and the longest match of each item that
    occurs, for one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    field = docs.schema[row_id]
    kind = to_arrow_type(field.dataType)
    match = pa.struct([("item", pa.string()), ("length", pa.int64()), ("at", pa.int64()), ("item_at", pa.int64())])

    def run(batches):
        tests = TestSuffixes(shared.value, width)
        for rows in _grouped(batches, SHARD_WORDS):
            out = []
            for (key, _), (n, start, end, test) in zip(rows, _matches([r[1] for r in rows], tests), strict=True):
                spans, start, end = [], start.tolist(), end.tolist()
                for a, b in sorted(zip(start, end, strict=True)):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                found = [dict(zip(("item", "length", "at", "item_at"), m, strict=True)) for m in tests.longest(start, end, test.tolist())]
                out.append((key, n, [x for s in spans for x in s], found))
            keys, n, spans, found = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(match))], names=["row_id", "n_words", "spans", "matches"])

    return mapped(docs.select(F.col(row_id), F.col(text)), run, f"row_id {field.dataType.simpleString()}, n_words bigint, spans array<bigint>, matches array<{MATCH}>"), shared


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, matches) for each row of docs.

    matches has the longest verbatim match of each item (item, length, at, item_at), longest is the greatest length. With one
    block of items nothing is shuffled. With more, what the later blocks find is written block by block, and met by the
    rows of the first block by id and text.
    """
    keyed = docs.select(F.struct(F.col(row_id).alias("id"), *[F.xxhash64(F.lit(k), F.col(text)).alias(n) for k, n in ((1, "h"), (2, "h2"))]).alias("key"), F.col(text).alias("text"))
    blocks = item_blocks(benchmark, item_id, item_text, block_words)
    found, _ = overlaps(keyed, next(blocks, []), "text", "key", width)
    later, tables = [], None
    for block in blocks:
        tables = tables or Tables(docs.sparkSession)
        part, shared = overlaps(keyed, block, "text", "key", width)
        later.append(tables.write(part.where("size(matches) > 0").select("row_id", "spans", "matches").dropDuplicates(["row_id"])))
        shared.destroy()
    if later:
        union = later[0]
        for part in later[1:]:
            union = union.unionByName(part)
        more = union.groupBy("row_id").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("matches")).alias("more_matches"))
        # null ids and null texts have hashes as well, but a struct with a null in it is equal to itself only null-safely
        found = found.withColumn("own", F.to_json("row_id")).join(more.withColumn("own", F.to_json("row_id")).drop("row_id"), "own", "left").drop("own")
        found = found.withColumn("spans", F.concat("spans", F.coalesce("more_spans", F.array().cast("array<bigint>")))).withColumn("matches", F.concat("matches", F.coalesce("more_matches", F.expr(f"cast(array() as array<{MATCH}>)")))).drop("more_spans", "more_matches")
        # an item may stand in several blocks; its longest match counts
        found = found.withColumn("matches", F.array_sort(F.transform("matches", lambda m: F.struct(m["item"].alias("item"), (-m["length"]).alias("less"), m["at"].alias("at"), m["item_at"].alias("item_at")))))
        first = F.filter("matches", lambda m, i: (i == 0) | ~F.get("matches", i - 1)["item"].eqNullSafe(m["item"]))
        found = found.withColumn("matches", F.transform(first, lambda m: F.struct(m["item"].alias("item"), (-m["less"]).alias("length"), m["at"].alias("at"), m["item_at"].alias("item_at"))))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    # spans hold start, end, start, end ...; hits are counted over their union
    span = F.array_sort(F.transform(F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", 2 * i).alias("a"), F.get("spans", 2 * i + 1).alias("b"))))
    ordered = F.when(F.size("spans") > 0, span).otherwise(F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"))

    def step(acc, x):
        fresh = F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["upto"]))
        return F.struct((acc["hit"] + fresh).alias("hit"), F.greatest(acc["upto"], x["b"]).alias("upto"))

    hit = F.col("hit")
    return found.withColumn("hit", F.aggregate(ordered, F.expr("struct(0L as hit, 0L as upto)"), step)["hit"]).select(
        F.col("row_id.id").alias(row_id),
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).alias("longest"),
        "matches",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """docs without the rows whose text is contaminated (a null text stays); each row is judged by its own text."""
    marks = contamination(docs.select(F.struct(*[F.xxhash64(F.lit(k), F.col(f"`{text}`")).alias(n) for k, n in ((1, "h"), (2, "h2"))]).alias("_key"), F.col(f"`{text}`").alias("_text")), benchmark, "_text", "_key").where("contaminated")
    marks = marks.select(F.col("_key.h").alias("_bad_h"), F.col("_key.h2").alias("_bad_h2")).distinct()
    inside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()])
    keys = [F.xxhash64(F.lit(k), F.col(inside[text])) for k in (1, 2)]
    left = own.select("*", keys[0].alias("_bad_h"), keys[1].alias("_bad_h2")).join(marks, ["_bad_h", "_bad_h2"], "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in inside.items()])
