"""Removal of repeated lines and passages by winnowing over hashes of lines and words.

A text is a sequence of words (runs of code points outside ASCII white space) in lines (ended by line feeds). Two kinds of
unit are compared across the corpus: whole lines of at least `line_words` words, and windows of gram + window words, which may
begin and end inside lines. A line is its own fingerprint. A window selects as its fingerprint the gram (run of `gram` words)
with the least hash in it, so equal windows select equal grams; the neighbouring windows that select one gram are its match,
extended both ways as far as the gram is selected. Grams that occur once drop out. Of the others, a match that stands earlier
as a whole is deleted as a whole; where one gram has different matches, the windows of the first place of each are compared
one by one. Together this deletes exactly the words of every line and every window that stands earlier, in the order of
document id, then of the text's hash, then of words.

Lines and windows are told apart by 128 bits (two running hashes of 64-bit word hashes); their contents are not compared once
more. A deleted run always has an equal earlier one. Null texts stay null and empty ones empty; a text whose words all go
becomes empty. A null id counts as the smallest. Rows that agree in id and text are one document and get the same result; a
text that repeats under another id goes. White space inside a line does not count. Extra columns are kept, whatever their
names; n_chars, where present, is counted anew. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import Tables, mapped

GRAM = 12
WINDOW = 38
LINE_WORDS = 3
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20
GOLDEN = 0x9E3779B97F4A7C15
#: Odd factors of the running hashes: of bytes in a word, of words (twice).
FACTORS = (0xD1342543DE82EF95, 0xDA942042E4DD58B5, 0xAF251AF3B0F025B5)
LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits that can be undone."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd factor modulo 2**64, and of its inverse."""
    if factor not in _POWERS or len(_POWERS[factor][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length()) if n > 1 else 1 << 16
        both = []
        for f in (factor, pow(factor, -1, 1 << 64)):
            steps = np.full(size, f, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _POWERS[factor] = both[0], both[1]
    return _POWERS[factor][0][:n], _POWERS[factor][1][:n]


class Running:
    """Hashes of runs of values: of the values from a to b (end exclusive), whatever stands around them."""

    def __init__(self, values: np.ndarray, factor: int):
        forth, self.back = powers(factor, len(values) + 1)
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * forth[:-1], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(GOLDEN))


def word_edges(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; no word goes on over a place where a text begins."""
    space = SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0], edge[1:] = True, space[:-1]
    start = np.flatnonzero(~space & (edge | begins))
    edge[-1], edge[:-1] = True, space[1:] | begins[1:]
    return start, np.flatnonzero(~space & edge) + 1


class Words:
    """The words of some texts, one after the other: hash, line and text of each, and where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        hashes, places, at = [], [], 0
        while at < len(data):
            end, piece = min(len(data), at + PIECE), PIECE
            while end < len(data) and not begins[end] and not SPACE[data[end]]:
                # a piece ends where a word does
                cut = np.flatnonzero(SPACE[data[at:end]] | begins[at:end])
                if len(cut) and cut[-1] > 0:
                    end = at + int(cut[-1])
                else:
                    piece *= 2
                    end = min(len(data), at + piece)
            part = data[at:end]
            start, stop = word_edges(part, begins[at:end])
            hashes.append(Running(BYTES[part], FACTORS[0]).of(start, stop))
            places.append(start + at)
            at = end
        self.hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        places = np.concatenate(places) if places else np.empty(0, np.int64)
        self.text = np.searchsorted(offsets, places, "right") - 1
        self.first = np.searchsorted(places, offsets)
        # a line ends with a line feed or a text
        self.line = np.searchsorted(np.flatnonzero(data == 10), places) + self.text
        self.one, self.two = Running(self.hashes, FACTORS[1]), Running(mixed(self.hashes ^ np.uint64(GOLDEN)), FACTORS[2])

    def lines(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of the lines that have `least` words."""
        start = np.flatnonzero(np.diff(self.line, prepend=-1))
        stop = np.append(start[1:], len(self.line))
        long = stop - start >= least
        return start[long], stop[long]

    def matches(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram hash, first word and end of the neighbouring windows that select one gram."""
        least = gram + window
        n = len(self.hashes) - least + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.arange(n + window)
        grams = self.one.of(at, at + gram)
        # half of the hash, then the place counted from behind: of equal ones the last is the least
        ranked = (grams & ~LOW) | (LOW - at.astype(np.uint64))
        picked = (LOW - (least_of(ranked, window + 1) & LOW)).astype(np.int64)
        whole = self.text[:n] == self.text[least - 1 :]
        opens = whole.copy()
        opens[1:] &= ~whole[:-1] | (picked[1:] != picked[:-1])
        closes = whole.copy()
        closes[:-1] &= ~whole[1:] | (picked[1:] != picked[:-1])
        first, last = np.flatnonzero(opens), np.flatnonzero(closes)
        return grams[picked[first]], first, last + least


def least_of(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each run of `window` values."""
    size = 1
    while 2 * size <= window:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (window - size)], values[window - size :])


def words_of(texts: pa.Array) -> Words:
    texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
    return Words(data, edges[:-1] - edges[0])


def slices(batches, column: int, most: int = PIECE):
    """Batches cut into slices of bounded text; a text that is longer has a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def listed(owner: np.ndarray, rows: int, columns: dict[str, np.ndarray]) -> pa.Array:
    """A list of structs for each of the rows; owner names the row of each entry, in order."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    parts = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int32)) for c in columns.values()]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=list(columns)))


def row_key(text: str, id_col: str) -> list:
    """Two hashes of id and text, 128 bits together, under the names _h and _h2."""
    return [F.xxhash64(F.lit(k), F.col(f"`{id_col}`"), F.col(f"`{text}`")).alias(n) for k, n in ((1, "_h"), (2, "_h2"))]


def repeated_words(docs: DataFrame, text: str = "text", id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW, line_words: int | None = LINE_WORDS) -> DataFrame:
    """(_h, _h2, _spans): the spans (a, b) of word numbers to delete, end exclusive, for the documents that have any.

    line_words None compares windows only.
    """
    least = gram + window
    tables = Tables(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(*row_key(text, id_col), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def read(batches):
        for part in slices(batches, 3):
            words = words_of(part.column(3))
            grams, a, b = words.matches(gram, window)
            one, two = words.one.of(a, b), words.two.of(a, b)
            if line_words is not None:
                la, lb = words.lines(line_words)
                l1, l2 = words.one.of(la, lb), words.two.of(la, lb)
                grams, a, b, one, two = (np.concatenate(x) for x in ((grams, mixed(l2 ^ l1)), (a, la), (b, lb), (one, l1), (two, l2)))
            owner = words.text[a]
            order = np.argsort(owner, kind="stable")
            owner, grams, a, b, one, two = owner[order], grams[order], a[order], b[order], one[order], two[order]
            base = words.first[owner]
            marks = listed(owner, part.num_rows, {"gram": grams, "a": a - base, "b": b - base, "one": one, "two": two})
            yield pa.RecordBatch.from_arrays([*part.columns[:3], marks], names=["_h", "_h2", "id", "marks"])

    mark = "struct<gram:bigint,a:int,b:int,one:bigint,two:bigint>"
    read_rows = tables.write(mapped(rows, read, f"_h bigint, _h2 bigint, id {kind}, marks array<{mark}>").select("_h", "_h2", "id", F.inline("marks")))
    shared = tables.write(read_rows.groupBy("gram").count().where("count > 1").select("gram"))
    # written, so that the joins read plain shuffles and very common keys can be split; the smaller side is hashed, so
    # that neither marks nor texts are sorted
    hits = tables.write(read_rows.join(shared.hint("shuffle_hash"), "gram", "left_semi"))
    tables.drop(read_rows)
    tables.drop(shared)
    place = F.struct("id", "_h", "_h2", "a").alias("place")
    known = tables.write(hits.groupBy("gram", "one", "two").agg(F.min(place).alias("origin"), F.count("*").alias("n"), F.first("b").alias("b"), F.first("a").alias("a")))
    later = hits.join(known.where("n > 1").select("gram", "one", "two", "origin").hint("shuffle_hash"), ["gram", "one", "two"]).where(~place.eqNullSafe(F.col("origin"))).select("_h", "_h2", "a", "b")
    # a gram with different matches: the windows of their first places decide
    several = known.groupBy("gram").count().where("count > 1").select("gram")
    unsure = known.join(several.hint("shuffle_hash"), "gram", "left_semi").select("origin._h", "origin._h2", F.struct(F.col("origin.a").alias("a"), (F.col("origin.a") + F.col("b") - F.col("a")).alias("b")).alias("run"))
    unsure = unsure.groupBy("_h", "_h2").agg(F.collect_set("run").alias("runs"))

    def windows(batches):
        for part in slices(batches, 3):
            words = words_of(part.column(3))
            runs = part.column(4)
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(runs).to_numpy(zero_copy_only=False).astype(np.int64))
            flat = runs.flatten()
            a, b = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) + words.first[row] for k in (0, 1))
            count = b - a - least + 1
            at = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
            own = np.repeat(row, count)
            order = np.argsort(own, kind="stable")
            own, at = own[order], at[order]
            marks = listed(own, part.num_rows, {"a": at - words.first[own], "one": words.one.of(at, at + least), "two": words.two.of(at, at + least)})
            yield pa.RecordBatch.from_arrays([*part.columns[:3], marks], names=["_h", "_h2", "id", "marks"])

    single = mapped(rows.join(unsure.hint("shuffle_hash"), ["_h", "_h2"]).select("_h", "_h2", "id", "text", "runs"), windows, f"_h bigint, _h2 bigint, id {kind}, marks array<struct<a:int,one:bigint,two:bigint>>")
    every = tables.write(single.select("_h", "_h2", "id", F.inline("marks")))
    first = tables.write(every.groupBy("one", "two").count().where("count > 1").select("one", "two"))
    single = tables.write(every.join(first.hint("shuffle_hash"), ["one", "two"], "left_semi"))
    tables.drop(every)
    tables.drop(first)
    first = single.groupBy("one", "two").agg(F.min(place).alias("origin"))
    again = single.join(first.hint("shuffle_hash"), ["one", "two"]).where(~place.eqNullSafe(F.col("origin"))).select("_h", "_h2", "a", (F.col("a") + least).alias("b"))
    out = tables.write(later.unionByName(again).groupBy("_h", "_h2").agg(F.collect_set(F.struct("a", "b")).alias("_spans")))
    for t in (hits, known, single):
        tables.drop(t)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Spans from a to b, end exclusive, in order; those that touch become one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    opens = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return list(zip(a[opens].tolist(), b[np.append(opens[1:], len(a)) - 1].tolist(), strict=True))


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words in the merged spans of word numbers.

    Of the white space on both sides of a deleted run one stays: the one with a line feed, else the one before it.
    """
    data = np.frombuffer(text, np.uint8)
    start, stop = word_edges(data, np.zeros(len(data), bool))
    if sum(b - a for a, b in spans) == len(start):
        return b""
    out, at = [], 0
    for a, b in spans:
        lead = int(stop[a - 1]) if a else 0
        follow = int(start[b]) if b < len(start) else len(text)
        before, after = text[lead : int(start[a])], text[int(stop[b - 1]) : follow]
        after_stays = a > 0 and (b == len(start) or (b"\n" in after and b"\n" not in before))
        out += [text[at:lead], after if after_stays else before]
        at = follow
    return b"".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW, line_words: int | None = LINE_WORDS, report: str | None = None) -> DataFrame:
    """docs with repeated lines and passages deleted from the text; `report` names a column for the merged spans of deleted
    words (numbers from 0, as a-b, comma-joined)."""
    spans = repeated_words(docs, text, id_col, gram, window, line_words)
    inside = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    joined = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()], *row_key(text, id_col)).join(spans.hint("shuffle_hash"), ["_h", "_h2"], "left").select(*inside.values(), "_spans")
    column, end = docs.columns.index(text), len(docs.columns)
    names = [*inside.values(), *["_report"] * bool(report)]

    def cut(batches):
        for part in slices(batches, column, 8 * PIECE):
            texts, gone = part.column(column), part.column(end)
            told = [""] * part.num_rows
            touched = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if touched:
                own, spans_of = texts.cast(pa.binary()).to_pylist(), gone.flatten()
                a, b = (spans_of.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                ends = np.cumsum(pc.list_value_length(gone).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                for i in touched:
                    at, to = (ends[i - 1] if i else 0), ends[i]
                    runs = merged(a[at:to], b[at:to])
                    own[i] = without_words(own[i], runs)
                    told[i] = ",".join(f"{a}-{b - 1}" for a, b in runs)
                texts = pa.array(own, pa.binary()).cast(texts.type)
            columns = [texts if k == column else part.column(k) for k in range(end)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(told)] * bool(report), names=names)

    schema = StructType(list(joined.drop("_spans").schema.fields))
    out = mapped(joined, cut, schema.add("_report", StringType()) if report else schema)
    back = {c: F.col(n) for c, n in inside.items()}
    if "n_chars" in back:
        back["n_chars"] = F.length(inside[text]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in back.items()], *([F.col("_report").alias(report)] if report else []))
